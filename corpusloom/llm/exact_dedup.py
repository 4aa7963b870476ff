"""Exact duplicates by content sort, with DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters (their first characters and a salt), sorted externally, and
the window's borders are full comparisons of neighbouring texts.  The salt, a hash of the key, lets the copies of one
text lie in many ranges, so a text may hold any share of the rows; the leaders of the ranges of such a text are sorted
and compared once more, and the document that stays is chosen among them.

The row with the most code points in the original text stays, then the smallest key (null keys last).

Inputs: null texts count as empty; rows that repeat a key form a group like any others and exactly one row of a group
is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import partitions, stored

_SPACE = "[ \\t-\\r]+"
_SPLITTER_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")



def exact_duplicates(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.length(text).alias("chars"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts or n)).cast("int")).withColumn("head", F.substring("norm", 1, _SPLITTER_CHARS))
    sorted_ = rows.repartitionByRange(n, "head", "salt").sortWithinPartitions("head", "salt", "norm", F.desc("chars"), F.asc_nulls_last("doc_id"))
    same = Window.partitionBy("head", "salt", "norm")
    best_first = same.orderBy(F.desc("chars"), F.asc_nulls_last("doc_id"))
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    members = stored(
        sorted_.select(
            "doc_id",
            "chars",
            "salt",
            F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256"),
            F.row_number().over(best_first).alias("place"),
            F.first("doc_id").over(whole).alias("leader"),
            F.first("chars").over(whole).alias("leader_chars"),
            F.count(F.lit(1)).over(whole).alias("members"),
        ),
        "exact-members",
    )
    # Leaders whose digest occurs in several ranges meet once more, with their whole texts, to be compared in order.
    leaders = members.filter("place = 1").select("text_sha256", "salt", "leader", "leader_chars", "members")
    spread = leaders.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("ranges")).filter("ranges > 1").select("text_sha256")
    asked = leaders.join(spread, "text_sha256", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), normalised(F.col("text")).alias("norm"))
    found = asked.hint("merge").join(texts, F.col("leader").eqNullSafe(F.col("key"))).filter(F.sha2(F.encode("norm", "utf-8"), 256) == F.col("text_sha256"))
    # A repeated key brings the same text more than once.
    found = found.select("text_sha256", "salt", "leader", "leader_chars", "members", "norm").dropDuplicates(["text_sha256", "salt"])
    met = found.withColumn("head", F.substring("norm", 1, _SPLITTER_CHARS)).repartitionByRange(n, "head").sortWithinPartitions("head", "norm")
    equal = Window.partitionBy("head", "norm").orderBy(F.desc("leader_chars"), F.asc_nulls_last("leader")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = met.select(
        "text_sha256",
        "salt",
        F.first("leader").over(equal).alias("first_leader"),
        F.first("salt").over(equal).alias("first_salt"),
        F.sum("members").over(equal).alias("total"),
        F.lit(True).alias("met"),
    )
    joined = members.join(merged, ["text_sha256", "salt"], "left")
    keep = F.when(F.col("met"), F.col("first_leader")).otherwise(F.col("leader"))
    kept = (F.col("place") == 1) & (F.col("met").isNull() | (F.col("first_salt") == F.col("salt")))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("total", "members").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat key and text one stays."""
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_corpusloom_key"), F.col("text_sha256").alias("_corpusloom_sha"))
    found = docs.join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_corpusloom_key")) & (F.sha2(F.encode(normalised(F.col("text")), "utf-8"), 256) == F.col("_corpusloom_sha")))
    # Partitioned by the key already: no further exchange of texts.
    return found.dropDuplicates(["_corpusloom_key", "_corpusloom_sha"]).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS chars, regexp_replace(t, '[ \t\n\v\f\r]+', '', 'g') AS norm FROM d),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER best = 1 AS kept
  FROM n WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w
"""

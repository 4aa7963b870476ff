"""Rules on texts and on the hosts they come from, with DataFrame operations only.

Each document is measured and judged by itself; failures are then counted per host, each host's failure rate is shrunk
towards that of all hosts by a beta prior whose strength is fitted to the spread between hosts (method of moments), and
a host whose shrunk rate passes the limit loses all its documents.

Inputs: null texts have no words and fail; a null host is no host, its documents are judged by themselves; repeated
rows are judged each; an empty table gives no rows; other columns are ignored.  Words are runs without ASCII white
space.  Window repeats are found by 64-bit hashes of three words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.6
_SYMBOLS = "[#*$%&|<>]"


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per row."""
    text = F.coalesce("text", F.lit(""))
    # Arrays are named columns, each used more than once above, so that none is computed inside a lambda again.
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).alias("host"),
        F.regexp_extract_all(text, F.lit("[^ \\t-\\r]+"), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long").alias("word_chars"),
    )
    size = F.size("words")
    windows = words.withColumn("zipped", F.arrays_zip("words", F.slice("words", F.lit(2), F.greatest(size - 1, F.lit(0))).alias("b"), F.slice("words", F.lit(3), F.greatest(size - 2, F.lit(0))).alias("c")))
    windows = windows.select(
        "doc_id",
        "host",
        size.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.filter(F.transform("zipped", lambda z, i: F.struct(F.xxhash64(z["words"], z["b"], z["c"]).alias("h"), i.alias("i"), z["c"].isNotNull().alias("full"))), lambda z: z["full"])).alias("found"),
    )
    count = F.size("found")
    paired = windows.withColumn(
        "beside",
        F.arrays_zip(
            F.col("found.h").alias("h"),
            F.col("found.i").alias("i"),
            F.concat(F.array(F.lit(None).cast("long")), F.col("found.h")).alias("before"),
            F.slice(F.col("found.h"), F.lit(2), F.greatest(count - 1, F.lit(0))).alias("after"),
        ),
    )
    twice = F.filter("beside", lambda z: z["h"].isNotNull() & (z["h"].eqNullSafe(z["before"]) | z["h"].eqNullSafe(z["after"])))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda z: F.array(z["i"], z["i"] + 1, z["i"] + 2))))
    return paired.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failed, rate: the failure rate after shrinking.  ``judged`` has host and base_failed."""
    hosts = judged.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    share = F.col("failed") / F.col("n")
    # One row: mean rate over all rows, and the variance between hosts beyond what chance within them explains.
    prior = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("t"), F.sum(F.col("n") * share * share).alias("s2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    mean = F.col("f") / F.col("t")
    chance = mean * (1 - mean)
    between = F.col("s2") - F.col("t") * mean * mean - (F.col("k") - 1) * chance
    units = F.col("t") - F.col("n2") / F.col("t")
    tau2 = F.when(units > 0, between / units)
    # Hosts that differ no more than by chance say nothing of their own: a very strong prior.
    strength = F.when((tau2 > 0) & (chance > 0), F.greatest(chance / tau2 - 1, F.lit(1.0))).otherwise(F.lit(1e9))
    prior = prior.select(mean.alias("mean"), strength.alias("strength"))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", rate.alias("rate"))  # prior is one row


def host_quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdicts per row of ``docs`` (doc_id, text and the host column).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.
    """
    judged = stored(measures(docs, host).withColumn("base_failed", base_failure()), "host-measures")
    rates = host_rates(judged).select("host", F.round("rate", 9).alias("host_rate"))
    joined = judged.join(rates, "host", "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= limit)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^ \t\n\v\f\r]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines FROM d),
x AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM x),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\v\f\r]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p ON w.r = p.r),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM j WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(failed) / sum(n) AS mean, sum(n) AS t, sum(failed * failed / n) AS s2, count(*) AS k, sum(n * n) AS n2 FROM h),
b AS (SELECT mean, mean * (1 - mean) AS chance, CASE WHEN t - n2 / t > 0 THEN (s2 - t * mean * mean - (k - 1) * mean * (1 - mean)) / (t - n2 / t) END AS tau2 FROM a),
q AS (SELECT mean, CASE WHEN tau2 > 0 AND chance > 0 THEN greatest(chance / tau2 - 1, 1.0) ELSE 1e9 END AS strength FROM b),
s AS (SELECT source, round((failed + mean * strength) / (n + strength), 9) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_rate, 0) <= {HOST_LIMIT} AS kept, host_rate
FROM j LEFT JOIN s ON j.source = s.source
"""

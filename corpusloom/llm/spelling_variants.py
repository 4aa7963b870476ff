"""Words that differ by one code point, found with asymmetric chunks, with DataFrame operations only.

A word u contributes its two disjoint chunks, the first and the last half of its code points.  One inserted, deleted or
replaced code point of u touches at most one of them, so any word v at one edit keeps the other: the first half at the
same place, or the last half moved by the difference of their lengths, which is at most one.  The other word contributes
its positional grams; of these only those that stand within one place of where a chunk of a word at most one longer or
shorter can stand are written, the others cannot meet a chunk.  Chunks and grams meet on side, length and letters; what
is left of both words beside the chunk is compared with a banded edit distance.

A chunk that many words share (a common ending) is not compared pair by pair: what is left of its words is cut into two
chunks and positional grams again, under the key found so far, until the words that meet are few or nothing is left to
cut.  Rests of one code point stay together: such words differ in one letter of the alphabet and are nearly all near.

Inputs: null texts have no words, a null key counts as the empty string in the hash; repeated rows count again; an empty
table gives no rows; very long runs are words like any others; other columns are ignored.  Of equal counts the smaller
word in code-point order is the form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SHORTEST = 6
LEAST = 5
RATIO = 5
EVERY = 199
# Chunks times grams of a key above which its words are cut once more.
PAIRS = 4096
_RUN = "[A-Za-zÀ-ÿ]"


def words(docs: DataFrame) -> DataFrame:
    """word, n: words of at least ``SHORTEST`` code points and ``LEAST`` occurrences, after the seeded deletions."""
    # Shorter runs cannot give a word: a deletion only shortens.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{_RUN}{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("key", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = lowered.select("run", F.crc32(F.encode(F.concat("key", F.lit(":"), "run"), "utf-8")).alias("h"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    changed = hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return changed.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _chunks(rows: DataFrame) -> DataFrame:
    """Both chunks of every rest: columns side, length, chunk and the new rest."""
    size = F.length("rest")
    q = _half(size)
    first = F.struct(F.lit("first").alias("side"), F.substring(F.col("rest"), F.lit(1), q).alias("chunk"), F.substring(F.col("rest"), q + 1, size).alias("left"))
    last = F.struct(F.lit("last").alias("side"), F.substring(F.col("rest"), size - q + 1, q).alias("chunk"), F.substring(F.col("rest"), F.lit(1), size - q).alias("left"))
    cut = rows.withColumn("_c", F.explode(F.array(first, last)))
    return cut.select("word", F.struct(F.col("key").alias("key"), F.col("_c.side").alias("side"), size.alias("length"), F.col("_c.chunk").alias("chunk")).alias("_key"), F.col("_c.left").alias("rest"))


def _grams(rows: DataFrame) -> DataFrame:
    """The positional grams of every rest that a chunk of a rest at most one longer or shorter can meet."""
    size = F.length("rest")
    # The rest whose chunk is met has one of three lengths; its chunk is half as long.
    cut = rows.withColumn("_l", F.explode(F.filter(F.array(size - 1, size, size + 1), lambda x: x >= 0))).withColumn("_q", _half(F.col("_l"))).filter(F.col("_q") <= size)
    q = F.col("_q")
    first = F.struct(F.lit("first").alias("side"), F.substring(F.col("rest"), F.lit(1), q).alias("chunk"), F.substring(F.col("rest"), q + 1, size).alias("left"))
    last = F.struct(F.lit("last").alias("side"), F.substring(F.col("rest"), size - q + 1, q).alias("chunk"), F.substring(F.col("rest"), F.lit(1), size - q).alias("left"))
    cut = cut.withColumn("_c", F.explode(F.array(first, last)))
    return cut.select("word", F.struct(F.col("key").alias("key"), F.col("_c.side").alias("side"), F.col("_l").alias("length"), F.col("_c.chunk").alias("chunk")).alias("_key"), F.col("_c.left").alias("rest"))


def _hashed(rows: DataFrame, role: str) -> DataFrame:
    """Rows under a key of fixed size; keys that meet by chance only cost a comparison."""
    return rows.select("word", "rest", F.xxhash64("_key").alias("key"), F.lit(role).alias("role"))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near: every ordered pair of ``vocabulary`` (word) at exactly one inserted, deleted or replaced code point."""
    start = vocabulary.select("word", F.col("word").alias("rest"), F.lit(0).cast("long").alias("key"))
    rows = _hashed(_chunks(start), "chunk").unionByName(_hashed(_grams(start), "gram"))
    found = []
    while True:
        rows = stored(rows, "spelling-keys")
        chunk, gram = (F.col("role") == r for r in ("chunk", "gram"))
        sizes = rows.groupBy("key").agg(F.count_if(chunk).alias("chunks"), F.count_if(gram).alias("grams"), F.max(F.when(chunk, F.length("rest"))).alias("longest"))
        # Chunk words of a key differ in their rests: with at most one code point left they are as few as letters.
        crowded = (F.col("chunks") * F.col("grams") > PAIRS) & (F.col("longest") > 1)
        sizes = stored(sizes.filter((F.col("chunks") > 0) & (F.col("grams") > 0)).select("key", crowded.alias("crowded")), "spelling-sizes")
        found.append(_verified(rows.join(sizes.filter("not crowded"), "key", "left_semi")))
        if sizes.filter("crowded").isEmpty():
            break
        more = rows.join(sizes.filter("crowded"), "key", "left_semi")
        rows = _hashed(_chunks(more.filter(chunk)), "chunk").unionByName(_hashed(_grams(more.filter(gram)), "gram"))
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.unionByName(other)
    return pairs.distinct()


def _verified(rows: DataFrame) -> DataFrame:
    u = rows.filter("role = 'chunk'").select("key", F.col("word").alias("word"), F.col("rest").alias("u"))
    v = rows.filter("role = 'gram'").select("key", F.col("word").alias("near"), F.col("rest").alias("v"))
    met = u.join(v, "key").filter(F.abs(F.length("u") - F.length("v")) <= 1)
    # Rests at one edit may belong to words whose keys met by chance, so the words themselves decide.
    return met.filter(F.levenshtein("u", "v", 1) == 1).filter(F.levenshtein("word", "near", 1) == 1).select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached by following word -> form; counts grow along it, so it ends."""
    step = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(step.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if step.filter("_moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    counted = stored(words(docs), "spelling-words")
    pairs = near_pairs(counted)
    rated = pairs.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = rated.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("b"))
    joined = stored(counted.join(best, "word", "left"), "spelling-best")
    followed = -F.col("b.order") >= RATIO * F.col("n")
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(followed, F.col("b.near")).alias("form"), F.when(followed, -F.col("b.order")).alias("form_n"))
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The checksum is folded byte by byte over a table made from its polynomial; near words share a word less one code point.
SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) AS r(b))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_RUN}{{{SHORTEST},}}')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) AS s FROM counted),
h AS (SELECT run, c, xor(4294967295, list_reduce([4294967295::BIGINT] || s, lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256))) AS h FROM bytes, crc),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE len(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {LEAST}),
x AS (SELECT word, n, i, word[:i] || word[i + 2:] AS less FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x AS a JOIN x AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM x AS a JOIN v ON a.less = v.word
  UNION SELECT v.word, a.word, a.n FROM x AS a JOIN v ON a.less = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
j AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {RATIO} * v.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
r(word, root) AS (SELECT word, form FROM j WHERE form IS NOT NULL UNION ALL SELECT r.word, j.form FROM r JOIN j ON j.word = r.root WHERE j.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN j ON j.word = r.root WHERE j.form IS NULL)
SELECT j.word, form, coalesce(root, j.word) AS root, n, n_near, form_n FROM j LEFT JOIN e ON e.word = j.word
"""

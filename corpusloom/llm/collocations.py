"""Collocations of two to five words per language from a weighted de Bruijn graph of word grams.

Nodes are grams of four words and edges grams of five: every place of a text gives one edge, or what is left of its piece
where the piece ends earlier (the piece-end correction).  Edges are counted once, packed per task and then range-
partitioned by sampled splitters in the order of their words, so that a hot edge is one row per task and all edges that
leave a node lie side by side.  The count of a shorter gram is the flow through it, the sum of the edges and piece ends
that start with it, read off the sorted edges in one pass; only grams cut by a border between batches are added
up afterwards.  A gram whose whole flow runs into one longer gram lies on a unary path and is compacted into it.

Grams are written as their language and words with a line feed between them; bytes up to the carriage return, which only
languages and odd words hold, are escaped, so that byte order is word order.

Inputs: null texts have no words; a null language is ``und``; repeated rows count again; an empty table gives no rows; keys
and other columns are ignored.  Very long texts are read
in parts cut between pieces; only a piece is ever held whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import partitions, stored
from .words import _spread

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
# Grams, at most, brought to the driver to choose the borders of partitions; results do not depend on them.
BORDER_SAMPLE = 20_000
_SAMPLE_SHARE = 64
_CHUNK_BYTES = 4_000_000
_OUT_ROWS = 10_000
_SEP = 10
_ESCAPE = 11
_KIND = np.full(256, 2, np.int8)
_KIND[[9, 32]] = 0
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = ".,;:!?\n\v\f\r"
_BATCH_ROWS = 16_384
_BATCH_BYTES = 4_000_000


def _escaped(value: bytes) -> bytes:
    """Bytes up to the carriage return as two bytes, in order."""
    if not any(b < 14 for b in value):
        return value
    return b"".join(bytes([_ESCAPE, b + 16]) if b < 14 else bytes([b]) for b in value)


def _plain(column: Column) -> Column:
    """Undo ``_escaped`` on a string column."""
    for b in (*range(11), 12, 13, _ESCAPE):
        column = F.replace(column, F.lit(chr(_ESCAPE) + chr(b + 16)), F.lit(chr(b)))
    return column


def _ranked(values: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Codes of binary values that sort like their escaped bytes, and these bytes."""
    coded = pc.dictionary_encode(values)
    names = [_escaped(v) for v in coded.dictionary.to_pylist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], [names[i] for i in order]


def _codes(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving dense codes from 1."""
    found, codes = np.unique(keys, return_inverse=True)
    return codes.astype(np.int64) + 1, len(found)


class Grams:
    """Distinct grams of a chunk in byte order, with their counts; bytes are only made for the grams asked for."""

    def __init__(self, names: list[bytes], begin: np.ndarray, codes: np.ndarray, lang: np.ndarray, size: np.ndarray, counts: np.ndarray):
        self.names, self.begin, self.codes, self.lang, self.size, self.counts = names, begin, codes, lang, size, counts
        self.lengths = np.array([len(v) for v in names], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.buffer = np.frombuffer(b"".join(names), np.uint8)

    def __len__(self) -> int:
        return len(self.counts)

    def one(self, i: int) -> bytes:
        return self.names[self.lang[i]] + b"".join(self.names[c] for c in self.codes[self.begin[i] : self.begin[i] + self.size[i]])

    def some(self, low: int, high: int) -> pa.Array:
        """Grams of a range: the language, then the words, each behind a separator."""
        size = self.size[low:high]
        first = np.cumsum(size + 1) - (size + 1)
        parts = np.empty(int(size.sum()) + len(size), np.int64)
        words = np.ones(len(parts), bool)
        words[first] = False
        parts[first] = self.lang[low:high]
        parts[words] = self.codes[_spread(self.begin[low:high], size)]
        data = self.buffer[_spread(self.at[parts], self.lengths[parts])]
        ends = np.cumsum(np.add.reduceat(self.lengths[parts], first))
        return pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


def chunk_grams(texts: pa.Array, langs: pa.Array) -> Grams | None:
    """The grams that start at each word of a chunk, up to five words or the end of the piece."""
    joined = np.frombuffer(b"\n".join(texts.cast(pa.large_binary()).to_pylist()) + b"\n", np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    data = _LOWER[joined]
    kind = _KIND[data]
    word = kind == 2
    edges = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(starts)
    if not n:
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    code, names = _ranked(words)
    lang_code, lang_names = _ranked(pc.fill_null(langs, "und").cast(pa.large_binary()))
    row = np.searchsorted(np.cumsum(sizes), starts, side="right")
    piece = np.cumsum(kind == 1, dtype=np.int32)[starts]
    # Number of words left in the piece, this one included.
    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True))
    left = np.minimum(last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1, LONGEST)
    code += 1
    base = len(names) + 1
    # Codes of two words, then four, then the language and five: each keeps the order, and two fit into 63 bits.
    pair, pairs = _codes(code * base + np.where(left > 1, np.append(code[1:], 0), 0))
    four, fours = _codes(pair * (pairs + 1) + np.where(left > 2, np.append(pair[2:], [0, 0])[:n], 0))
    lead, _ = _codes(lang_code[row] * (fours + 1) + four)
    del pair, four
    _, first, counts = np.unique(lead * base + np.where(left > 4, np.append(code[4:], [0] * 4)[:n], 0), return_index=True, return_counts=True)
    return Grams([bytes([_SEP]) + v for v in (*lang_names, *names)], first, code - 1 + len(lang_names), lang_code[row[first]], left[first], counts)


def _pieces(text: str) -> Iterator[str]:
    """A text cut where pieces end, into parts of some megabytes or one piece."""
    at = 0
    while len(text) - at > _CHUNK_BYTES:
        cut = max(text.rfind(mark, at, at + _CHUNK_BYTES) for mark in _MARKS)
        if cut < 0:
            cut = min((found for mark in _MARKS if (found := text.find(mark, at)) >= 0), default=-1)
            if cut < 0:
                break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of some megabytes, over the borders of batches; longer texts are cut between pieces."""
    texts: list[str] = []
    langs: list[str | None] = []
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _pieces(text or ""):
                if size + len(part) > _CHUNK_BYTES and texts:
                    yield pa.array(texts, pa.large_string()), pa.array(langs, pa.large_string())
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang)
                size += len(part)
    if texts:
        yield pa.array(texts, pa.large_string()), pa.array(langs, pa.large_string())


def _gram_rows(borders: list[bytes]):
    """Rows (part, gram, n) of all distinct grams of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _chunks(batches):
            found = chunk_grams(texts, langs)
            if found is None:
                continue
            # Grams are in order: each border is looked up in them, not the other way round.
            cuts = [bisect_right(range(len(found)), border, key=found.one) for border in borders]
            part = np.zeros(len(found) + 1, np.int32)
            np.add.at(part, cuts, 1)
            part = np.cumsum(part[:-1], dtype=np.int32)
            for at in range(0, len(found), _OUT_ROWS):
                to = min(at + _OUT_ROWS, len(found))
                yield pa.RecordBatch.from_arrays([pa.array(part[at:to]), found.some(at, to), pa.array(found.counts[at:to])], ["part", "gram", "n"])

    return run


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to some ten thousand rows or some megabytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _BATCH_ROWS or sum(b.nbytes for b in held) >= _BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _flow_rows(least: int):
    """Rows (gram, size, n) of every gram and each of its beginnings, from sorted edges.

    Grams inside a batch are whole: those below ``least`` end here.  The first and last ones of a batch may go on in
    another and are always passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wide(batches):
            n = batch.num_rows
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            split = pc.split_pattern(batch.column(0), b"\n")
            count = pc.list_value_length(split).to_numpy(zero_copy_only=False) - 1  # the part before the first separator is empty
            parts = pc.dictionary_encode(split.flatten())
            codes = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(count + 1) - (count + 1)
            rows = [[], [], []]
            new = np.zeros(n, bool)
            new[0] = True
            text_ends = None
            for k in range(1, LONGEST + 2):
                there = count >= k
                code = np.where(there, codes[np.minimum(begin + k, len(codes) - 1)], -1)
                new[1:] |= code[1:] != code[:-1]
                starts = np.flatnonzero(new)
                total = np.add.reduceat(weight, starts)
                open_ = np.zeros(len(starts), bool)
                open_[[0, -1]] = True
                picked = there[starts] & (open_ | (total >= least))
                if k == 1:
                    text_ends = pc.binary_length(parts.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                at = starts[picked]
                if not len(at):
                    continue
                size = np.zeros(len(at), np.int64)
                for j in range(1, k + 1):
                    size += text_ends[codes[begin[at] + j]]
                rows[0].append(_cut(batch.column(0), at, size))
                rows[1].append(np.full(len(at), k - 1, np.int32))
                rows[2].append(total[picked])
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows[0]), pa.array(np.concatenate(rows[1])), pa.array(np.concatenate(rows[2]))], ["gram", "size", "n"])

    return run


def _cut(grams: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` bytes of some values, without the leading separator."""
    return pa.array([g[1:s] for g, s in zip(grams.take(pa.array(at)).to_pylist(), size.tolist(), strict=True)], pa.binary())


def edges(docs: DataFrame) -> DataFrame:
    """part, gram, n: all edges and piece ends, counted per task, with the range each belongs to."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"))
    n = partitions(docs.sparkSession)
    if n > 1:
        # A sixty-fourth of the documents by hash, then one gram of each hash bucket, choose the borders.
        light = rows.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(_SAMPLE_SHARE)) == 0)
        hashed = light.mapInArrow(_gram_rows([]), "part int, gram binary, n long").select("gram", F.xxhash64("gram").alias("h"))
        sample = hashed.groupBy(F.pmod("h", F.lit(BORDER_SAMPLE))).agg(F.min_by("gram", "h").alias("gram"))
        grams = sorted(bytes(row.gram) for row in sample.collect())
        borders = sorted({grams[len(grams) * i // n] for i in range(1, n)}) if grams else []
    else:
        borders = []
    return rows.mapInArrow(_gram_rows(borders), "part int, gram binary, n long")


def flows(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, size, n: exact counts of all grams up to five words that occur ``least`` times, and per language
    (size 0, empty phrase) of all words.  Words of a phrase have one space between them."""
    sorted_ = edges(docs).repartitionById(partitions(docs.sparkSession), "part").sortWithinPartitions("gram").select("gram", "n")
    found = stored(sorted_.mapInArrow(_flow_rows(least), "gram binary, size int, n long"), "gram-flow")
    whole = found.groupBy("gram", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))
    text = F.decode("gram", "utf-8")
    lang = F.substring_index(text, "\n", 1)
    phrase = F.when(F.col("size") > 0, F.replace(F.substring(text, F.length(lang) + 2, F.length(text)), F.lit("\n"), F.lit(" "))).otherwise(F.lit(""))
    return stored(whole.select(_plain(lang).alias("lang"), _plain(phrase).alias("phrase"), "size", "n"), "gram-flows")


def _first_words(phrase: str, k: Column) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def unary(counted: DataFrame) -> DataFrame:
    """lang, phrase of grams whose whole flow runs into one gram that is a word longer, before or behind."""
    longer = counted.filter("size > 2")
    behind = longer.select("lang", _first_words("phrase", F.col("size") - 1).alias("phrase"), "n")
    before = longer.select("lang", F.substring(F.col("phrase"), F.length(F.substring_index("phrase", " ", 1)) + 2, F.length("phrase")).alias("phrase"), "n")
    most = behind.unionByName(before).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    # A gram inside a longer one occurs at least as often; equal counts mean that all of its flow goes there.
    return counted.join(most, ["lang", "phrase"]).filter("most >= n").select("lang", "phrase")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases per language of ``docs`` (text, lang).

    Returns lang, rank, phrase, a, l, r, n, score.
    """
    counted = flows(docs, least)
    total = counted.filter("size = 0").select("lang", F.col("n").alias("total"))
    grams = counted.filter("size > 0").select("lang", "phrase", "size", "n")
    kept = grams.filter("size > 1").join(unary(grams), ["lang", "phrase"], "left_anti").withColumnRenamed("n", "a")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("first", _first_words("phrase", F.col("k")))
    cut = cut.withColumn("rest", F.substring(F.col("phrase"), F.length("first") + 2, F.length("phrase")))
    left = grams.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    joined = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "total")}
    # Exact: 1000 a n and l r are decimals of 38 digits; the quotient is at most 1000 n.
    score = F.expr("cast(1000 as decimal(4,0))") * F.col("a").cast("decimal(15,0)") * F.col("total").cast("decimal(17,0)")
    scored = joined.withColumn("_up", score).withColumn("_down", wide["l"] * wide["r"]).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of a language are chosen among the best of its parts, so that no language is sorted in one task.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    parts = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words[i:i + k - 1] AS words, k FROM i, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, words, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
t AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
e AS (SELECT lang, words[1:k - 1] AS words, f FROM f WHERE k > 2 UNION ALL SELECT lang, words[2:k], f FROM f WHERE k > 2),
c AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.lang = f.lang AND e.words = f.words AND 100 * e.f >= 100 * f.f)),
u AS (SELECT lang, words, k, f, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, array_to_string(u.words, ' ') AS phrase, u.f AS a, l.f AS l, r.f AS r, n, cut, (1000 * u.f::HUGEINT * n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
  FROM u JOIN f AS l ON l.lang = u.lang AND l.words = u.words[1:cut] JOIN f AS r ON r.lang = u.lang AND r.words = u.words[cut + 1:u.k] JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM b QUALIFY rank <= {TOP}
"""

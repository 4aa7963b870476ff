"""Bytes that lie in long strings occurring more than once, by run-length indexes over the places that can hold them.

Every window of ``length`` bytes chooses one of its ``gram``-byte strings, the one of least hash (the first of equals):
equal windows choose alike.  Consecutive windows that choose the same place form a fragment, and equal windows can only
lie in fragments of one key, the hash of the chosen string.  Keys that occur once are done.  Fragments that occur twice
are repeats throughout.  The other fragments of a key are brought together, each distinct one once, and a run-length
index is built over them: their Burrows-Wheeler transform as runs, with the suffix positions and the longest common
prefixes at both ends of each run.  Between these samples a match only gets shorter by one byte per position, so the
longest match of every position with any other place streams out in text order, and windows with a match of ``length``
bytes are repeats.

A key that holds a great share of the rows is known from a sample; it is counted apart, so that no task holds all its
rows.  A key with more than ``group`` distinct fragments is counted window by window instead of indexed.  Both give the
same windows.

Inputs: null texts count as empty; texts shorter than ``length`` bytes have no windows; rows that repeat key and text are
repeats of one another; null keys are allowed; an empty table gives no rows; other columns are ignored by
``repeated_bytes`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import whole_groups
from .hashing import PrefixHash, U
from .storage import partitions, stored

LENGTH = 200
GRAM = 50
GROUP = 8192
HOT_KEYS = 10_000
_PLACE = U((1 << 24) - 1)
_PIECE = 2_000_000
_INDEX_BYTES = 1_200_000


def _choices(hashes: np.ndarray, windows: int) -> np.ndarray:
    """For each run of ``windows`` consecutive hashes the place of the least, the first of equals."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=U)
    span = 1
    while span * 2 <= windows:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if windows > span:
        least = np.minimum(least[: span - windows], least[windows - span :])
    return (least & _PLACE).astype(np.int64)


def fragments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Fragments of texts laid end to end; ``bounds`` are the ends of the texts.

    Gives per fragment the text, first and last window in the buffer, key and hash.  Equal fragments that follow one
    another (periodic text) are one row: ``n`` of them, the first of width ``w``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {"owner": none, "lo": none, "hi": none, "w": none, "n": none, "key": none, "frag": none}
    hashes = PrefixHash(data)
    grams = hashes.windows(gram)
    chosen = _choices(grams, length - gram + 1)
    owner = np.searchsorted(bounds, np.arange(len(chosen)), side="right")
    windows = np.flatnonzero(bounds[owner] >= np.arange(len(chosen)) + length)
    if not len(windows):
        return {"owner": none, "lo": none, "hi": none, "w": none, "n": none, "key": none, "frag": none}
    own, pick = owner[windows], chosen[windows]
    cut = np.flatnonzero((np.diff(pick) != 0) | (np.diff(own) != 0)) + 1
    lo, hi = windows[np.concatenate([[0], cut])], windows[np.concatenate([cut - 1, [-1]])]
    own = own[np.concatenate([[0], cut])]
    key = grams[pick[np.concatenate([[0], cut])]]
    frag = hashes.of(lo, hi + length)
    again = (key[1:] == key[:-1]) & (frag[1:] == frag[:-1]) & (own[1:] == own[:-1])
    heads = np.concatenate([[0], np.flatnonzero(~again) + 1])
    tails = np.concatenate([heads[1:] - 1, [len(lo) - 1]])
    return {"owner": own[heads], "lo": lo[heads], "hi": hi[tails], "w": (hi - lo)[heads], "n": tails - heads + 1, "key": key[heads].view(np.int64), "frag": frag[heads].view(np.int64)}


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Batches of (text number, offset, bytes); long texts in pieces that overlap by one byte less than a window."""
    rows, offsets, parts, size = [], [], [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), _PIECE):
            part = text[offset : offset + _PIECE + length - 1]
            if size and size + len(part) > _PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(number)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def _encoded(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def _fragment_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, parts in _pieces(_encoded(batch.column(2)), length):
                bounds = np.cumsum([len(p) for p in parts])
                found = fragments(np.frombuffer(b"".join(parts), np.uint8), bounds, length, gram)
                row, shift = np.array(rows)[found["owner"]], (np.array(offsets) - (bounds - [len(p) for p in parts]))[found["owner"]]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(found["key"]),
                        pa.array(found["frag"]),
                        *[pa.array(x.astype(np.int32)) for x in (found["n"], found["lo"] + shift, found["hi"] + shift, found["w"])],
                    ],
                    ["doc_id", "version", "key", "frag", "n", "lo", "hi", "w"],
                )

    return run


class RunIndex:
    """Run-length Burrows-Wheeler transform of separate strings, sampled at both ends of its runs."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        count = len(bounds)
        starts = np.concatenate([[0], bounds[:-1]])
        # One separator after each string: place i of string s is at i + s.
        owner = np.repeat(np.arange(count), bounds - starts + 1)
        n = len(owner)
        self.last = bounds[owner] + owner  # place of the separator
        symbols = np.zeros(n, np.int64)
        inside = np.arange(n) < self.last
        symbols[inside] = data.astype(np.int64) + 1
        order, levels = self._sorted(symbols, owner, count)
        before = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), -1 - owner, np.concatenate([[0], symbols[:-1]]))
        bwt = before[order]
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.run_symbols = bwt[np.concatenate([[0], change])]
        self.run_starts = np.concatenate([[0], change])
        # Suffixes at the first and last row of each run, and how far they agree with the rows beyond.
        heads, tails = self.run_starts, np.concatenate([change - 1, [n - 1]])
        self.head_places, self.tail_places = order[heads], order[tails]
        self.head_match = np.zeros(len(heads), np.int64)
        self.tail_match = np.zeros(len(tails), np.int64)
        shared = self._shared(order[heads[1:] - 1], order[heads[1:]], levels, symbols)
        self.head_match[1:], self.tail_match[:-1] = shared, shared
        self.n = n

    @staticmethod
    def _sorted(symbols: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling; suffixes equal up to their separators are ordered by string."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(8, np.int64)])
        packed, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(7):
            symbol = np.where(alive, padded[j : j + n], 0)
            packed = (packed << 9) | symbol
            alive &= symbol > 0
        key, step, levels = packed, 7, []
        while True:
            order = np.argsort(key)
            placed = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])])
            levels.append((step, rank))
            if rank[order[-1]] == n - 1:
                return order, levels
            follow = owner.astype(np.int64).copy()
            same = np.flatnonzero(owner[:-step] == owner[step:]) if step < n else np.zeros(0, np.int64)
            follow[same] = count + rank[same + step].astype(np.int64)
            key = rank.astype(np.int64) * (n + count) + follow
            step *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], symbols: np.ndarray) -> np.ndarray:
        """Common prefix of pairs of suffixes, from the ranks of the doubling steps."""
        most = np.minimum(self.last[a] - a, self.last[b] - b)
        done = np.zeros(len(a), np.int64)
        for step, rank in [*reversed(levels), levels[0]]:
            at = np.flatnonzero(done < most)
            x, y = a[at] + done[at], b[at] + done[at]
            done[at[rank[x] == rank[y]]] += step
        # Fewer than 7 symbols are left open.
        for _ in range(7):
            at = np.flatnonzero(done < most)
            at = at[symbols[a[at] + done[at]] == symbols[b[at] + done[at]]]
            done[at] += 1
        return np.minimum(done, most)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every place with any other place, in text order."""
        best = np.zeros(self.n, np.int64)
        for places, match in ((self.head_places, self.head_match), (self.tail_places, self.tail_match)):
            # Between samples the match found one place before goes on, one byte shorter.
            until = np.full(self.n, -1, np.int64)
            until[places] = places + match
            sample = np.maximum.accumulate(np.where(until >= 0, np.arange(self.n), 0))
            best = np.maximum(best, until[sample] - np.arange(self.n))
        return best


def index_repeats(strings: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per string the runs (first, last) of places where ``length`` bytes start that also start at another place."""
    sizes = np.array([len(s) for s in strings], np.int64)
    bounds = np.cumsum(sizes)
    index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), bounds)
    long = np.concatenate([[False], index.matching_statistics() >= length, [False]])
    change = np.diff(long.astype(np.int8))
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
    starts = bounds - sizes + np.arange(len(strings))
    owner = np.searchsorted(starts, first, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for s, a, b in zip(owner.tolist(), (first - starts[owner]).tolist(), (last - starts[owner]).tolist(), strict=True):
        out[s].append((a, b))
    return out


_SPAN = "doc_id long, version long, start int, end int"


def _indexed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key"]):
            data, single = table.column("data").to_pylist(), (table.column("c").to_numpy() == 1)
            lows = table.column("lo").to_numpy()
            a = 0
            sizes = np.cumsum([len(d) for d in data])
            while a < len(data):
                # Whole groups up to the size of one index.
                room = np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _INDEX_BYTES)
                later = starts[starts > a]
                b = int(later[later <= room][-1]) if (later <= room).any() else int(later[0])
                rows, first, last = [], [], []
                for i, found in enumerate(index_repeats(data[a:b], length), start=a):
                    if single[i]:
                        for x, y in found:
                            rows.append(i)
                            first.append(lows[i] + x)
                            last.append(lows[i] + y + length)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(take), table.column("version").combine_chunks().take(take), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["doc_id", "version", "start", "end"])
                a = b

    return run


def _fetched(length: int):
    """The bytes of the asked fragments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "frag", "c", "nf", "lo", "w"]
        for batch in batches:
            asked = batch.column(3)
            count = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), count)
            flat = asked.flatten()
            columns = {name: flat.field(i) for i, name in enumerate(names)}
            texts = _encoded(batch.column(2))
            data = [texts[r][lo : lo + w + length] for r, lo, w in zip(row.tolist(), columns["lo"].to_pylist(), columns["w"].to_pylist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns.values(), pa.array(data, pa.binary())], ["doc_id", "version", *names, "data"])

    return run


def _window_rows(length: int):
    """Every window of the fragments of crowded keys, with two independent hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(batch.schema.get_field_index("data")).to_pylist()):
                digests = [hashlib.blake2b(data[p : p + length], digest_size=16).digest() for p in range(len(data) - length + 1)]
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(np.full(len(pair), i))
                lo = batch.column(batch.schema.get_field_index("lo"))[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(lo + np.arange(len(pair)), pa.int32()), batch.column(batch.schema.get_field_index("c")).take(take)],
                    ["doc_id", "version", "h1", "h2", "start", "c"],
                )

    return run


def _version():
    """Tells rows that repeat a key but not the text apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _counted(rows: DataFrame, hot: DataFrame, n: int) -> DataFrame:
    """Rows whose key occurs twice or more, with c (occurrences of the fragment), nf (fragments of the key) and rep (one row per fragment)."""
    order = ["doc_id", "version", "lo"]
    cold = rows.join(hot, "key", "left_anti").repartition(n, "key")
    key, frag = Window.partitionBy("key"), Window.partitionBy("key", "frag")
    cold = cold.withColumn("c", F.sum("n").over(frag)).withColumn("rep", F.row_number().over(frag.orderBy(*order)) == 1)
    cold = cold.withColumn("total", F.sum("n").over(key)).withColumn("nf", F.sum(F.col("rep").cast("long")).over(key)).filter("total > 1").drop("total")
    # Hot keys: combined before the shuffle and joined back, so that their rows stay spread.
    warm = rows.join(hot, "key", "left_semi")
    each = warm.groupBy("key", "frag").agg(F.sum("n").alias("c"), F.min(F.struct(*order)).alias("first"))
    per_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("nf"), F.sum("c").alias("total")).filter("total > 1").drop("total")
    at = F.struct(*order)
    warm = warm.join(each, ["key", "frag"]).join(per_key, "key").withColumn("rep", at.eqNullSafe(F.col("first"))).drop("first")
    return cold.select(*rows.columns, "c", "rep", "nf").unionByName(warm.select(*rows.columns, "c", "rep", "nf"))


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, version and spans (array of start, end in bytes, may overlap) of the texts that hold repeats."""
    n = partitions(docs.sparkSession)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"), "text")
    schema = "doc_id long, version long, key long, frag long, n int, lo int, hi int, w int"
    # Found once: counting reads them several times.
    rows = stored(typed.mapInArrow(_fragment_rows(length, gram), schema), "repeat-rows")
    # At most HOT_KEYS keys, from a sample of the texts; the sample decides where rows are counted, never what is found.
    sample = typed.sample(0.01, seed=17).mapInArrow(_fragment_rows(length, gram), schema)
    seen = sample.groupBy("key").agg(F.sum("n").alias("seen")).filter("seen >= 20").orderBy(F.desc("seen"), "key").limit(HOT_KEYS).select("key")
    hot = F.broadcast(stored(seen, "repeat-hot-keys"))
    twice = stored(_counted(rows, hot, n), "repeat-fragments")

    whole = twice.filter("c > 1").select("doc_id", "version", F.col("lo").alias("start"), (F.col("hi") + length).cast("int").alias("end"))
    asked = twice.filter("nf > 1 and rep").groupBy("doc_id", "version").agg(F.collect_list(F.struct("key", "frag", F.col("c").cast("int").alias("c"), F.col("nf").cast("int").alias("nf"), "lo", "w")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "_key", "version": "_version"})
    texts = typed.join(asked, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("version") == F.col("_version")))
    # Rows that repeat key and text bring the same fragments again.
    texts = texts.dropDuplicates(["_key", "_version"]).select("doc_id", "version", "text", "asked")
    found = texts.mapInArrow(_fetched(length), "doc_id long, version long, key long, frag long, c int, nf int, lo int, w int, data binary")
    found = stored(found.repartition(n, "key").sortWithinPartitions("key"), "repeat-texts")
    near = found.filter(F.col("nf") <= group).repartition(n, "key").sortWithinPartitions("key", "frag")
    spans = near.mapInArrow(_indexed(length), _SPAN)
    crowded = found.filter(F.col("nf") > group).mapInArrow(_window_rows(length), "doc_id long, version long, h1 long, h2 long, start int, c int")
    repeated = crowded.groupBy("h1", "h2").agg(F.sum("c").alias("times")).filter("times > 1").select("h1", "h2")
    crowded = crowded.filter("c = 1").join(repeated, ["h1", "h2"], "left_semi").select("doc_id", "version", "start", (F.col("start") + length).cast("int").alias("end"))
    every = whole.unionByName(spans).unionByName(crowded)
    return every.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _kept(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in cut:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.withColumnsRenamed({"doc_id": "_corpusloom_key", "version": "_corpusloom_version", "spans": "_corpusloom_spans"})
    return docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_corpusloom_key")) & (_version() == F.col("_corpusloom_version")), "left").drop("_corpusloom_key", "_corpusloom_version")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, spans in zip(_encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            cut = _merged(spans)
            kept = _kept(data, cut)
            rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
        size, removed, count, digest = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs`` (doc_id, text)."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(typed, repeat_spans(docs, **options)).select("doc_id", "text", "_corpusloom_spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A cut may leave part of a character; such bytes go too.
        texts = [_kept(data, cut).decode("utf-8", "ignore") if (cut := _merged(spans)) else data.decode() for data, spans in zip(_encoded(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], [*batch.schema.names[2:], "_corpusloom_text"])


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns and rows, the repeats taken out of text and n_chars (if there) set to the new length."""
    joined = _with_spans(docs, repeat_spans(docs, **options))
    others = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    cut = joined.select("text", "_corpusloom_spans", *others).mapInArrow(_shortened, f"{kinds}, _corpusloom_text string").withColumnRenamed("_corpusloom_text", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)

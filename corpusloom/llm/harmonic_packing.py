"""Harmonic packing of token sequences into fixed-length sequences.

A piece of length n belongs to class k = capacity // n: k such pieces always fit one sequence.  Each worker fills the
sequences of each class with exactly k pieces, on its own.  Documents are cut until every piece fills its class's
sequences to ``fill`` at least; what whole sequences of a worker leave over (fewer than k pieces a class) is numbered
across workers and fills sequences of its class in the same way, and what the classes leave over at the very end
(less than one sequence each, whatever the input) is packed first-fit, longest piece first.

Inputs: null texts count as empty and give one piece, the end id; documents may be longer than any sequence; repeated
documents are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .words import END_ID, encoded_batches, tokenizer_path

CAPACITY = 4096
FILL = 0.98


def cut_lengths(total: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then pieces that fill the sequences of their class well."""
    full, rest = divmod(total, capacity)
    out = [capacity] * full
    while rest:
        k = capacity // rest
        if k * rest >= fill * capacity or rest <= 1:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, klass int, worker int, bin long, offset long"


class _Filler:
    """Open sequences of one worker: at most one per class."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.bins = capacity, {}, 0

    def add(self, row: tuple) -> Iterator[tuple]:
        """Take a piece; gives the pieces of a sequence as soon as it is complete."""
        k = self.capacity // row[2]
        held = self.open.setdefault(k, [])
        held.append(row)
        if len(held) == k:
            offset = 0
            for piece in held:
                yield (*piece, k, self.bins, offset)
                offset += piece[2]
            self.bins += 1
            self.open[k] = []


def _cut_and_fill(path: str, capacity: int, fill: float, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, filler = TaskContext.get().partitionId(), _Filler(capacity)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            doc, start, length, crc, total, k, number, offset = columns
            longs = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total)]
            return pa.RecordBatch.from_arrays(
                [*longs, pa.array(k, pa.int32()), pa.array([worker] * len(rows), pa.int32()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass", "worker", "bin", "offset"],
            )

        for rows, ids, ends in encoded_batches(batches, path, end=end):
            done, wide, first = [], ids.astype("<u4"), 0
            for doc, last in zip(rows.column(rows.schema.get_field_index("doc_id")).to_pylist(), ends.tolist(), strict=True):
                at = first
                for length in cut_lengths(last - first, capacity, fill):
                    done.extend(filler.add((doc, at - first, length, zlib.crc32(wide[at : at + length].data), last - first)))
                    at += length
                first = last
            yield pack(done)
        yield pack([(*piece, k, None, None) for k, held in filler.open.items() for piece in held])

    return run


def _first_fit(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        lengths = table.column("length").to_numpy()
        free, bins, offsets = np.zeros(0, np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for at, length in enumerate(lengths):  # longest first
            fits = np.flatnonzero(free >= length)
            if not len(fits):
                free, fits = np.append(free, capacity), np.array([len(free)])
            bins[at], offsets[at] = fits[0], capacity - free[fits[0]]
            free[fits[0]] -= length
        out = table.set_column(table.schema.get_field_index("bin"), "bin", pa.array(bins)).set_column(table.schema.get_field_index("offset"), "offset", pa.array(offsets))
        yield from out.combine_chunks().to_batches()

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fill: float = FILL, end: int = END_ID) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their place.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and klass.
    """
    path = tokenizer or tokenizer_path()
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(typed.mapInArrow(_cut_and_fill(path, capacity, fill, end), _PIECE), "packing-pieces")
    whole, over = pieces.filter("bin is not null"), pieces.filter("bin is null").drop("bin", "offset")

    # Number the left-over pieces of a class across workers: a worker holds fewer than k of them.
    inside = Window.partitionBy("klass", "worker").orderBy("doc_id", "start", "ids_crc32")
    counts = over.groupBy("klass", "worker").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("klass").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("klass", "worker", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    totals = counts.groupBy("klass").agg(F.sum("held").alias("pieces"))
    numbered = over.withColumn("n", F.row_number().over(inside) - 1).join(bases, ["klass", "worker"]).join(totals, "klass")
    numbered = numbered.withColumn("n", F.col("n") + F.col("base"))
    within = F.col("n") < F.floor(F.col("pieces") / F.col("klass")) * F.col("klass")
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass"]
    placed = stored(numbered.select(*kept, within.alias("within"), F.floor(F.col("n") / F.col("klass")).alias("bin"), "n"), "packing-left-over")
    before = Window.partitionBy("klass", "bin").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.filter("within").select(*kept, "bin", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))

    # Fewer than k pieces a class are left, whatever the size of the input.
    last = placed.filter("not within").select(*kept, F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    last = last.coalesce(1).sortWithinPartitions(F.desc("length"), "doc_id", "start").mapInArrow(_first_fit(capacity), last.schema)

    # Sequence ids: workers' own sequences first, then the shared ones by class, then the last.
    width = F.lit(1 << 36)
    worker_bins = whole.select(*kept, "bin", "offset", F.col("worker").cast("long").alias("owner"))
    shared_bins = shared.select(*kept, "bin", "offset", (F.lit(1 << 22) + F.col("klass")).cast("long").alias("owner"))
    last_bins = last.select(*kept, "bin", "offset", F.lit(1 << 23).cast("long").alias("owner"))
    every = worker_bins.unionByName(shared_bins).unionByName(last_bins)
    return every.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("owner") * width + F.col("bin")).alias("sequence_id"), "offset", "klass")

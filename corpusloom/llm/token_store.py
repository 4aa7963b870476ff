"""Token ids in raw shard files with a minimal perfect hash index from document keys to their place.

``shard-N.bin`` holds nothing but ids, little-endian unsigned 16 or 32 bits wide by vocabulary size, documents in
ascending key order.  ``index-M.mph`` covers the keys whose hash falls to part M: the bit arrays of a minimal perfect
hash, and per slot a fingerprint of the key, the shard, the first id and the number of ids.  A lookup hashes the key,
reads one slot and compares the fingerprint, whatever the number of documents.

Inputs: null texts count as empty (only the end id is written); an empty table gives no shards and no rows; repeated
keys are all written, next to each other, and addressed by (key, copy) with copies counted from 0; null keys come first
and are addressed like others; other columns are ignored.  Files are written under a task's own name and renamed, and a
task that runs again writes the same bytes.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix
from .storage import new_folder, partitions, stored
from .words import END_ID, encoded_batches, encoder, tokenizer_path

_LEVELS = 40
_NULL = np.uint64(0x6E756C6C6B657900)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, chunks) -> None:
    """Write under a name of this attempt, then rename: readers never see half a file."""
    files, path = _files(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(draft, f"{path}/{name}")


def key_hash(key: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """64 bits per (key, copy): distinct for copy 0 of distinct keys."""
    base = np.where(null, _NULL, key.astype(np.int64).view(np.uint64))
    return np.where(copy > 0, mix(base ^ mix(copy, 5), 1), mix(base, 2))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: each level keeps the values that are alone at their bit."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks, total = [], 0
        for words in bits:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.placed = total

    @classmethod
    def build(cls, values: np.ndarray, spread: float = 1.5) -> PerfectHash:
        sizes, bits, left = [], [], values
        while len(left) and len(sizes) < _LEVELS:
            size = (int(len(left) * spread) + 64) // 64 * 64
            at = (mix(left, 100 + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64)
            sizes.append(size)
            bits.append(words)
            left = left[~alone[at]]
        return cls(sizes, bits, np.sort(left))

    def slot(self, values: np.ndarray) -> np.ndarray:
        """A slot per value; values that were not built in get any slot or -1."""
        out = np.full(len(values), -1, np.int64)
        open_ = np.arange(len(values))
        for level, (size, words, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(open_):
                return out
            at = (mix(values[open_], 100 + level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            place = np.minimum(np.searchsorted(self.rest, values[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[place] == values[open_], self.placed + place, -1)
        return out


def _fingerprint(values: np.ndarray) -> np.ndarray:
    return (mix(values, 77) >> np.uint64(32)).astype(np.uint32)


_FIELDS = {"fingerprint": "<u4", "shard": "<i4", "first": "<i8", "length": "<i8"}


def _pack_index(values: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    if len(np.unique(values)) < len(values):
        raise ValueError("two document keys share a 64-bit hash; write them to separate stores")
    table = PerfectHash.build(values)
    slot = table.slot(values)
    out = io.BytesIO()
    head = json.dumps({"sizes": table.sizes, "rest": len(table.rest), "slots": len(values)}).encode()
    out.write(len(head).to_bytes(4, "little") + head)
    for words in [*table.bits, table.rest]:
        out.write(words.astype("<u8").tobytes())
    for name, kind in _FIELDS.items():
        placed = np.zeros(len(values), kind)
        placed[slot] = columns[name]
        out.write(placed.tobytes())
    return out.getvalue()


class IndexPart:
    """One index file in memory."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        head, at = json.loads(data[4 : 4 + size]), 4 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        bits = [take("<u8", n // 64) for n in head["sizes"]]
        self.table = PerfectHash(head["sizes"], bits, take("<u8", head["rest"]))
        self.columns = {name: take(kind, head["slots"]) for name, kind in _FIELDS.items()}

    def find(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """Place per hashed key; ``found`` is false where the fingerprint says that the key is not stored."""
        if not len(self.columns["shard"]):
            return {"found": np.zeros(len(values), bool)} | {name: np.zeros(len(values), kind) for name, kind in _FIELDS.items()}
        slot = self.table.slot(values)
        safe = np.maximum(slot, 0)
        got = {name: column[safe] for name, column in self.columns.items()}
        return got | {"found": (slot >= 0) & (got["fingerprint"] == _fingerprint(values))}


def _key_columns(batch: pa.RecordBatch) -> np.ndarray:
    key = batch.column(batch.schema.get_field_index("doc_id"))
    copy = batch.column(batch.schema.get_field_index("copy")).to_numpy(zero_copy_only=False)
    return key_hash(pc.fill_null(key, 0).to_numpy(zero_copy_only=False), pc.is_null(key).to_numpy(zero_copy_only=False), copy)


def _encode_rows(path: str, bounds: list[float], end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, ends in encoded_batches(batches, path, end=end):
            key = rows.column(rows.schema.get_field_index("doc_id"))
            shard = np.searchsorted(bounds, pc.fill_null(key, -(1 << 63)).to_numpy(zero_copy_only=False), side="right") if bounds else np.zeros(len(ends), int)
            offsets = np.concatenate([[0], ends]) * ids.itemsize
            payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([key, pa.array(shard, pa.int32()), payload.cast(pa.binary())], ["doc_id", "shard", "ids"])

    return run


def _write_shard(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last, copy, total = [], (), 0, 0
        shard = None

        def payload():
            nonlocal last, copy, total, shard
            for batch in batches:
                ids, keys = batch.column(2), batch.column(0).to_pylist()
                shard = batch.column(1)[0].as_py() if batch.num_rows else shard
                lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // width
                copies = []
                for key in keys:
                    copy = copy + 1 if last == (key,) else 0
                    last = (key,)
                    copies.append(copy)
                first = total + np.cumsum(lengths) - lengths
                total += int(lengths.sum())
                found.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies, pa.int64()), batch.column(1), pa.array(first), pa.array(lengths)], ["doc_id", "copy", "shard", "first", "length"]))
                for value in ids:
                    yield value.as_buffer()

        chunks = payload()
        head = next(chunks, None)
        if head is None:
            return

        def all_chunks():
            yield head
            yield from chunks

        _write(folder, f"shard-{shard:06d}.bin", all_chunks())
        yield from found

    return run


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        part, values = table.column(5).to_numpy(zero_copy_only=False), _key_columns(table)
        for number in np.unique(part):
            mine = part == number
            columns = {name: table.column(at).to_numpy(zero_copy_only=False)[mine] for name, at in (("shard", 2), ("first", 3), ("length", 4))}
            _write(folder, f"index-{number:06d}.mph", [_pack_index(values[mine], columns | {"fingerprint": _fingerprint(values[mine])})])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([int(mine.sum())], pa.int64())], ["part", "keys"])

    return run


def _read(folder: str, name: str) -> bytes:
    files, path = _files(folder)
    with files.open_input_file(f"{path}/{name}") as file:
        return file.read()


def _find_places(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, IndexPart] = {}
        for batch in batches:
            part, values = batch.column(2).to_numpy(zero_copy_only=False), _key_columns(batch)
            for number in np.unique(part):
                mine = part == number
                if number not in index:
                    index = {number: IndexPart(_read(folder, f"index-{number:06d}.mph"))}
                got = index[number].find(values[mine])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(mine)), batch.column(1).filter(pa.array(mine)), *[pa.array(np.where(got["found"], got[name], -1), kind) for name, kind in (("shard", pa.int32()), ("first", pa.int64()), ("length", pa.int64()))]],
                    ["doc_id", "copy", "shard", "first", "length"],
                )

    return run


def _read_payload(folder: str, kind: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        number, file = None, None
        width = np.dtype(kind).itemsize
        for batch in batches:
            sums, payloads = [], []
            for shard, first, length in zip(*[batch.column(at).to_pylist() for at in (2, 3, 4)], strict=True):
                if shard != number:
                    if file is not None:
                        file.close()
                    number, file = shard, files.open_input_file(f"{path}/shard-{shard:06d}.bin")
                raw = file.read_at(length * width, first * width)
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                sums.append(zlib.crc32(ids))
                payloads.append(ids if with_ids else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(payloads, pa.binary())], [*batch.schema.names, "ids_crc32", "ids"])
        if file is not None:
            file.close()

    return run


class TokenStore:
    """A written store: folder, id width, number of index parts and the table of entries."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, parts: int, entries: DataFrame):
        self.spark, self.folder, self.kind, self.parts, self.entries = spark, folder, kind, parts, entries

    def part(self):
        return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(self.parts)).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy → shard, first, length through the index; keys that are not stored are left out."""
        routed = keys.select("doc_id", F.col("copy").cast("long").alias("copy"), self.part().alias("part"))
        dealt = routed.repartitionById(self.parts, F.col("part")).sortWithinPartitions("part")
        # A part without entries has no file: its keys cannot be stored.
        known = self.entries.select(self.part().alias("part")).distinct()
        found = dealt.join(known, "part", "left_semi").select("doc_id", "copy", "part").sortWithinPartitions("part")
        return found.mapInArrow(_find_places(self.folder), "doc_id long, copy long, shard int, first long, length long").filter("shard >= 0")

    def read(self, keys: DataFrame, with_ids: bool = True) -> DataFrame:
        """Keyed access for a table of keys: place, checksum and (if asked) the ids as little-endian 32-bit integers."""
        places = self.lookup(keys).repartition(partitions(self.spark), "shard").sortWithinPartitions("shard", "first")
        return places.mapInArrow(_read_payload(self.folder, self.kind, with_ids), "doc_id long, copy long, shard int, first long, length long, ids_crc32 long, ids binary")

    def get(self, doc_id: int | None, copy: int = 0) -> list[int] | None:
        """Ids of one document on the driver: one index slot and one range of a shard."""
        keys = self.spark.createDataFrame([(doc_id, copy)], "doc_id long, copy long")
        found = self.read(keys).select("ids").take(1)
        return np.frombuffer(bytes(found[0]["ids"]), "<u4").tolist() if found else None


def write_token_store(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end: int = END_ID, shards: int | None = None) -> TokenStore:
    """Encode ``docs`` (doc_id, text) and write shards and index below ``folder`` (a fresh shared one by default)."""
    spark = docs.sparkSession
    path, n = tokenizer or tokenizer_path(), shards or partitions(spark)
    folder = folder or new_folder(spark, "token-store")
    if "://" not in folder:  # a plain path, or Hadoop's short form
        folder = f"file://{folder.removeprefix('file:')}"
    kind = encoder(path).dtype.str
    # Splitters from the keys alone, so that the texts are encoded once; as many as there are shards.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []))
    rows = docs.mapInArrow(_encode_rows(path, bounds, end), "doc_id long, shard int, ids binary")
    ordered = rows.repartitionById(n, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    entries = stored(ordered.mapInArrow(_write_shard(folder, np.dtype(kind).itemsize), "doc_id long, copy long, shard int, first long, length long"), "token-entries")
    store = TokenStore(spark, folder, kind, n, entries)
    parts = entries.withColumn("part", store.part()).repartitionById(n, F.col("part"))
    stored(parts.mapInArrow(_write_index(folder), "part int, keys long"), "token-index-parts")
    return store


def token_directory(docs: DataFrame, **options) -> DataFrame:
    """Write the store, then read every document back through the index.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32, copy and shard.
    """
    store = write_token_store(docs, **options)
    # One row per shard.
    sizes = store.entries.groupBy("shard").agg(F.sum("length").alias("tokens")).withColumnRenamed("shard", "earlier")
    shards = store.entries.select("shard").distinct()
    bases = shards.join(sizes, F.col("earlier") < F.col("shard"), "left").groupBy("shard").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("base"))
    read = store.read(store.entries.select("doc_id", "copy"), with_ids=False)
    return read.join(bases, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32", "copy", "shard")

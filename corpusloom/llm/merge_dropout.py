"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

The pieces and scores of a public model are used; nothing is trained.  A text is cut before each run of spaces, as no
piece spans such a place.  Every cut part starts as characters (bytes where a character has no piece) and an agenda of
neighbouring pairs that form a piece; the pair of best score merges first, the left one of equals.  A candidate, given by
where its two sides begin and end, is skipped when a hash of seed, document, position, part and candidate falls below the rate: every
occurrence has its own draws.  Occurrences of a part share a segmentation only where their draws agree on every candidate
that it met: first the one that skips nothing, then one for each set of skips among its candidates; others are segmented
on their own.  ``variants`` > 0 bounds the different draws of a part instead; 0, the default, does not.

The space is written as U+2581 and a text begins with one more, as the model expects; a U+2581 of the text itself is
written as bytes, so that decoding gives back every text exactly.

Inputs: null texts count as empty (no pieces); null keys are hashed as 0; repeated rows are encoded alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PrefixHash, mix
from .words import _spread, tokenizer_path

MODEL = "piece_bpe_32k.model"
RATE = 0.1
VARIANTS = 0
_SPACE = "▁"
_NONE = np.int64(1 << 62)
_WORD = (1 << 64) - 1
_CHUNK_BYTES = 2_000_000
_RUN_BYTES = 1_000_000
_SHARED_BYTES = 32
# Pieces of a part above which its agenda is a heap: the same merges, in time that grows with n log n.
_LONG = 2048


class Pieces:
    """Pieces of a model: pairs that merge, pieces of characters, and the bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        ids = {names[i]: i for i in plain}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1 and name != _SPACE:
                self.char[ord(name)] = i
        self.char[ord(" ")] = ids[_SPACE]
        raw = [names[i].replace(_SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        # Merging order: by score, best first.
        order = np.argsort([-model.get_score(i) for i in range(n)], kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.by_rank = order.astype(np.int32)
        pairs = {}
        for name, i in ids.items():
            if _SPACE in name.strip(_SPACE) or (_SPACE in name and not name.startswith(_SPACE)):
                raise ValueError(f"piece {name!r} spans a cut before spaces")
            for at in range(1, len(name)):
                left, right = ids.get(name[:at]), ids.get(name[at:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = {key: int(self.rank[i]) for key, i in pairs.items()}
        self.keys = np.full(1 << 21, -1, np.int64)
        self.merged = np.zeros(1 << 21, np.int64)
        for key, i in pairs.items():
            at = int(self._home(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.merged[at] = key, self.rank[i]

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two pieces form, or -1."""
        keys = left.astype(np.int64) << 20 | right
        at, out = self._home(keys), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out


def _candidate(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | right.astype(np.uint64), 31)


def _drawn(part: np.ndarray, candidate: np.ndarray, rate: float) -> np.ndarray:
    return (mix(part ^ candidate, 32) >> np.uint64(11)).astype(np.float64) < rate * (1 << 53)


def skipped(part: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Whether candidates are dropped: ``part`` is the keyed hash of the part, the others are places in it."""
    return _drawn(part, _candidate(left, middle, right), rate)


def _mixed(x: int, seed: int) -> int:
    """``mix`` of one number."""
    x = (x + seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & _WORD
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _WORD
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _WORD
    return x ^ (x >> 32)


def _merge_long(pieces: Pieces, symbol: list[int], agenda: list[int], keyed: int, rate: float, met: list[tuple[int, bool]] | None) -> list[int]:
    """All merges of one part from its first agenda (rank << 32 | place; ``_NONE`` where there is no pair): its pieces, -1 where merged away."""
    n, limit, none = len(symbol), rate * (1 << 53), int(_NONE)
    following, previous, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [entry for entry in agenda if entry < none]
    heapify(heap)
    by_rank = pieces.by_rank.tolist()

    def offer(at: int) -> None:
        agenda[at] = none
        other = following[at]
        if other >= n:
            return
        rank = pieces.pairs.get(symbol[at] << 20 | symbol[other])
        if rank is None:
            return
        if rate > 0 or met is not None:
            candidate = _mixed(at << 42 | other << 21 | end[other], 31)
            skip = (_mixed(keyed ^ candidate, 32) >> 11) < limit
            if met is not None:
                met.append((candidate, skip))
            if skip:
                return
        agenda[at] = entry = rank << 32 | at
        heappush(heap, entry)

    while heap:
        entry = heappop(heap)
        at = entry & 0xFFFFFFFF
        # Entries that were replaced or taken off since are left in the heap.
        if agenda[at] != entry:
            continue
        other = following[at]
        beyond = following[other]
        symbol[at], symbol[other] = by_rank[entry >> 32], -1
        agenda[other] = none
        following[at], end[at] = beyond, end[other]
        if beyond < n:
            previous[beyond] = at
        offer(at)
        if previous[at] >= 0:
            offer(previous[at])
    return symbol


def segment(pieces: Pieces, parts: list[bytes], keyed: np.ndarray, rate: float, met: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all parts one after the other, and their number per part.  ``keyed``: hash of each part with its draw.

    ``met`` takes the candidates that were looked at, as part numbers, hashes and whether each was skipped.
    """
    points = np.frombuffer(b"".join(parts).decode().encode("utf-32-le"), "<u4").astype(np.int64)
    chars = np.array([len(p.decode()) for p in parts], np.int64)
    owner = np.repeat(np.arange(len(parts)), chars)
    symbol = pieces.char[points]
    if (symbol < 0).any():
        # Characters without a piece become their bytes.
        size = np.where(symbol >= 0, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        raw = "".join(map(chr, points[symbol < 0].tolist())).encode()
        out = np.repeat(symbol, size)
        out[out < 0] = pieces.byte[np.frombuffer(raw, np.uint8)]
        symbol, owner = out, np.repeat(owner, size)
    n = len(symbol)
    count = np.bincount(owner, minlength=len(parts))
    start = np.cumsum(count) - count
    local = np.arange(n) - start[owner]
    following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = (start + count - 1)[count > 0]
    following[last] = -1
    previous[start[count > 0]] = -1
    end = np.arange(1, n + 1) - start[owner]  # end of the symbol that begins here
    agenda = np.full(n, _NONE)

    def offer(at: np.ndarray) -> None:
        """Put the pairs that begin at these places on the agenda, or take them off."""
        agenda[at] = _NONE
        at = at[following[at] >= 0]
        other = following[at]
        rank = pieces.merge_rank(symbol[at], symbol[other])
        at, other, rank = at[rank >= 0], other[rank >= 0], rank[rank >= 0]
        if rate > 0 or met is not None:
            candidate = _candidate(local[at], local[other], end[other])
            skip = _drawn(keyed[owner[at]], candidate, rate)
            if met is not None:
                met.append((owner[at], candidate, skip))
            at, rank = at[~skip], rank[~skip]
        agenda[at] = (rank << 32) | at

    offer(np.arange(n))
    bounds = np.append(start, n)
    for k in np.flatnonzero(count > _LONG).tolist():
        low, high = int(start[k]), int(start[k] + count[k])
        first = np.where(agenda[low:high] < _NONE, agenda[low:high] - low, _NONE)
        looked: list[tuple[int, bool]] | None = None if met is None else []
        symbol[low:high] = _merge_long(pieces, symbol[low:high].tolist(), first.tolist(), int(keyed[k]), rate, looked)
        if looked:
            met.append((np.full(len(looked), k), np.array([c for c, _ in looked], np.uint64), np.array([skip for _, skip in looked], bool)))
    active = np.flatnonzero((count > 1) & (count <= _LONG))
    place = _spread(start[active], count[active])
    while len(active):
        width = bounds[active + 1] - bounds[active]
        best = np.minimum.reduceat(agenda[place], np.cumsum(width) - width)
        go = best < _NONE
        at = (best[go] & np.int64(0xFFFFFFFF)).astype(np.int64)
        if len(at) < 0.8 * len(active):
            active = active[go]
            place = _spread(start[active], count[active])
        if not len(at):
            break
        other = following[at]
        beyond = following[other]
        symbol[at] = pieces.by_rank[(best[go] >> np.int64(32)).astype(np.int64)]
        symbol[other] = -1
        agenda[other] = _NONE
        following[at] = beyond
        end[at] = end[other]
        previous[beyond[beyond >= 0]] = at[beyond >= 0]
        offer(at)
        before = previous[at]
        offer(before[before >= 0])
    alive = symbol >= 0
    return symbol[alive], np.bincount(owner[alive], minlength=len(parts))


class _Runs:
    """Segmentations one after the other."""

    def __init__(self, pieces: Pieces, rate: float):
        self.pieces, self.rate, self.n = pieces, rate, 0
        self.ids, self.count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def add(self, parts: list[bytes], keyed: np.ndarray, rate: float, met: list[tuple] | None = None) -> np.ndarray:
        """Numbers of the new segmentations."""
        first, ends = self.n, np.cumsum([len(p) for p in parts])
        at = 0
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _RUN_BYTES, side="right")))
            found: list[tuple] | None = None if met is None else []
            ids, count = segment(self.pieces, parts[at:to], keyed[at:to], rate, found)
            self.ids.append(ids)
            self.count.append(count)
            if met is not None:
                met += [(owner + at, candidate, skip) for owner, candidate, skip in found]
            at = to
        self.n += len(parts)
        return np.arange(first, self.n)

    def differing(self, met: list[tuple], n: int, group: np.ndarray, keyed: np.ndarray) -> np.ndarray:
        """For occurrences with the draws ``keyed``, a hash of the candidates met in their group's run that they draw otherwise; 0 if none."""
        owner, candidate, skip = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.argsort(owner, kind="stable")
        candidate, skip = candidate[order], skip[order]
        size = np.bincount(owner, minlength=n)
        start = np.cumsum(size) - size
        many = size[group]
        which = _spread(start[group], many)
        other = _drawn(np.repeat(keyed, many), candidate[which], self.rate) != skip[which]
        # A sum only groups; whether any differs is counted.
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(other, candidate[which], np.uint64(0)))])
            ends = np.cumsum(many)
            out = sums[ends] - sums[ends - many]
        counts = np.concatenate([[0], np.cumsum(other)])
        return np.where(counts[ends] > counts[ends - many], np.maximum(out, np.uint64(1)), np.uint64(0))


def _segment_occurrences(pieces: Pieces, names: list[bytes], codes: np.ndarray, keyed: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the segmentation of each occurrence of a part, and pieces and sizes of the segmentations."""
    runs, answer = _Runs(pieces, rate), np.full(len(codes), -1, np.int64)
    if rate <= 0:
        answer = runs.add(names, np.zeros(len(names), np.uint64), 0.0)[codes]
        return answer, np.concatenate(runs.ids), np.concatenate(runs.count)
    # A part that stands once or is long hardly ever agrees with another draw.
    shared = (np.bincount(codes, minlength=len(names)) > 1) & (np.array([len(p) for p in names], np.int64) <= _SHARED_BYTES)
    rest = np.flatnonzero(shared[codes])
    if len(rest):
        kinds = np.flatnonzero(shared)
        met: list[tuple] = []
        made = runs.add([names[i] for i in kinds.tolist()], np.zeros(len(kinds), np.uint64), 0.0, met)
        group = (np.cumsum(shared) - 1)[codes[rest]]
        differs = runs.differing(met, len(kinds), group, keyed[rest])
        answer[rest[differs == 0]] = made[group[differs == 0]]
        rest, differs = rest[differs > 0], differs[differs > 0]
        # Of occurrences with the same skips, the first is segmented with its own draws; others take that if they agree all along.
        _, lead, group, size = np.unique(mix(differs ^ mix(codes[rest], 36), 37), return_index=True, return_inverse=True, return_counts=True)
        leads = np.flatnonzero(size > 1)
        if len(leads):
            met = []
            chosen = rest[lead[leads]]
            made = runs.add([names[i] for i in codes[chosen].tolist()], keyed[chosen], rate, met)
            among = np.full(len(size), -1)
            among[leads] = np.arange(len(leads))
            member = np.flatnonzero(among[group] >= 0)
            inside = among[group[member]]
            same = codes[rest[member]] == codes[chosen[inside]]
            member, inside = member[same], inside[same]
            agree = runs.differing(met, len(leads), inside, keyed[rest[member]]) == 0
            answer[rest[member[agree]]] = made[inside[agree]]
    alone = np.flatnonzero(answer < 0)
    answer[alone] = runs.add([names[i] for i in codes[alone].tolist()], keyed[alone], rate)
    return answer, np.concatenate(runs.ids), np.concatenate(runs.count)


def encode_texts(pieces: Pieces, texts: list[bytes], keys: np.ndarray, seed: int, rate: float, variants: int = VARIANTS) -> Iterator[np.ndarray]:
    """Piece ids of each text."""
    data = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_start = np.cumsum(sizes) - sizes
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[text_start] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(data))
    listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    coded = pc.dictionary_encode(listed)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.searchsorted(text_start, starts, side="right") - 1
    draw = mix(mix(keys[owner], seed) ^ mix(starts - text_start[owner], 33), 34)
    if variants > 0:
        draw %= np.uint64(variants)
    names = coded.dictionary.to_pylist()
    joined = np.frombuffer(b"".join(names), np.uint8)
    length = np.array([len(p) for p in names], np.int64)
    hashed = PrefixHash(joined).of(np.cumsum(length) - length, np.cumsum(length))
    at, ids, count = _segment_occurrences(pieces, names, codes, mix(hashed[codes] ^ mix(draw, seed), 35), rate)
    first = np.cumsum(count) - count
    flat = ids[_spread(first[at], count[at])].astype(pieces.dtype)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=count[at], minlength=len(texts)))]).astype(np.int64)
    for i, text in enumerate(texts):
        # An empty text has no pieces, not even the space a text begins with.
        yield flat[bounds[i] : bounds[i + 1]] if text else flat[:0]


def decode_ids(pieces: Pieces, ids: np.ndarray) -> bytes:
    ids = ids.astype(np.int64)
    return pieces.bytes[_spread(pieces.starts[ids], pieces.lengths[ids])].tobytes()[1:] if len(ids) else b""


_models: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _encode(path: str, seed: int, rate: float, variants: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").cast(pa.binary()).to_pylist()
            keys = pc.fill_null(batch.column(batch.schema.get_field_index("doc_id")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, ends = 0, np.cumsum([len(t) for t in texts])
            rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK_BYTES, side="right")))
                ids = [x.tobytes() for x in encode_texts(model, texts[at:to], keys[at:to], seed, rate, variants)]
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], pa.array(ids, pa.binary())], [*[batch.schema.names[i] for i in rest], "ids"])
                at = to

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for batch in batches:
            ids = [np.frombuffer(x, model.dtype) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([decode_ids(model, x).decode() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "n_pieces", "ids_crc32", "decoded"])

    return run


def encode_pieces(docs: DataFrame, seed: int = 0, rate: float = RATE, variants: int = VARIANTS, model: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned integers, 16 bits wide for up to 65,536 pieces) per row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(model or tokenizer_path(MODEL), seed, rate, variants), "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with n_pieces, ids_crc32 (of the ids as 32-bit integers) and decoded."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model or tokenizer_path(MODEL)), "doc_id long, ids binary, n_pieces long, ids_crc32 long, decoded string")


def dropout_round_trip(docs: DataFrame, seed: int = 0, rate: float = RATE, variants: int = VARIANTS, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 and lossless: each text encoded, decoded from its ids and compared."""
    path = model or tokenizer_path(MODEL)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"), "text")
    encode, decode = _encode(path, seed, rate, variants), _decode(path)
    # One after the other in one worker, which holds the model once.
    decoded = rows.mapInArrow(lambda batches: decode(encode(batches)), "doc_id long, text_sha256 string, ids binary, n_pieces long, ids_crc32 long, decoded string")
    digest = F.sha2(F.encode("decoded", "utf-8"), 256)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", digest.alias("decoded_sha256"), (digest == F.col("text_sha256")).alias("lossless"))

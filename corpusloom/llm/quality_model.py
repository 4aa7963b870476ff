"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are the shares of its hashed grams: runs of letters, digits or signs (a run of capitals counts as one
gram, whatever its letters), and pairs of neighbouring words (a word followed by itself counts as one gram).  A score is
a sparse dot product of shares and weights through the logistic function.

Training reads at most ``max_rows`` labelled rows, those whose key hashes lowest, and runs in one task over their hashed
grams only; scoring reads every row.  Inputs: null texts count as empty, empty texts get the score of no grams; null
labels are no labels; several labels of a document are several examples; without any label every score is 0.5; repeated
rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PrefixHash, U, mix, word_spans

BITS = 18
MAX_ROWS = 6000
THRESHOLD = 0.7
_SCALE = 8.0
_CHUNK_BYTES = 2_000_000
_SAME, _CAPITALS = np.uint64(0x5AE5AE5AE), np.uint64(0xCAB17A15)

_CLASS = np.full(256, 3, np.int8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER, _UPPER = np.zeros(256, np.int32), np.zeros(256, np.int32)
_LOWER[97:123], _UPPER[65:91] = 1, 1


def _grams(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of a buffer of texts, and the text it belongs to; ``bounds`` are the ends of the texts."""
    hashes = PrefixHash(data)
    kind = _CLASS[data]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1])
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    runs = hashes.of(starts, ends)
    lower, upper = np.concatenate([[0], np.cumsum(_LOWER[data])]), np.concatenate([[0], np.cumsum(_UPPER[data])])
    runs = np.where((lower[ends] == lower[starts]) & (upper[ends] - upper[starts] > 1), _CAPITALS, runs)
    left, right = word_spans(data)
    words, owner = hashes.of(left, right), np.searchsorted(bounds, left, side="right")
    inside = owner[1:] == owner[:-1]
    first, second = words[:-1][inside], words[1:][inside]
    pairs = np.where(first == second, _SAME, mix(first ^ mix(second, 3), 4))
    shift = U(64 - bits)
    buckets = np.concatenate([mix(runs, 5) >> shift, mix(pairs, 6) >> shift]).astype(np.int64)
    return buckets, np.concatenate([np.searchsorted(bounds, starts, side="right"), owner[:-1][inside]])


def _per_text(texts: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of consecutive texts: their number, the buckets of all their grams, and the text of each gram."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _CHUNK_BYTES, side="right")))
        data = np.frombuffer(("\n".join(texts.slice(at, to - at).to_pylist()) + "\n").encode(), np.uint8)
        yield to - at, *_grams(data, np.cumsum(sizes[at:to] + 1), bits)
        at = to


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, buckets, text in _per_text(batch.column(0), bits):
                order = np.argsort(text, kind="stable")
                buckets, cut = buckets[order], np.searchsorted(text[order], np.arange(n + 1))
                rows = [buckets[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, n), batch.column(2).slice(at, n), pa.array(rows, pa.binary())], ["label", "turn", "grams"])
                at += n

    return run


class FollowTheLeader:
    """Per-coordinate FTRL-proximal updates of a logistic regression; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def _train(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for label, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, count = np.unique(np.frombuffer(grams, "<u4"), return_counts=True)
                share = _SCALE * count / max(1, count.sum())
                examples.append((np.append(found.astype(np.int64), 1 << bits), np.append(share, 1.0), label))
        model = FollowTheLeader(1 << bits)
        for _ in range(epochs):
            for at, x, label in examples:
                model.update(at, x, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["weights"])

    return run


def held_out(key: str = "doc_id"):
    """Rows whose label is never learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Weights from at most ``max_rows`` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    turn = F.xxhash64("doc_id")
    chosen = usable.select(F.col("doc_id").alias("_key"), F.col("quality").cast("int").alias("label"), turn.alias("turn")).orderBy("turn", "_key", "label").limit(max_rows)
    # At most max_rows rows, so that no text is moved to find the few that are learnt from.
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_key")).select("text", "label", "turn")
    grams = rows.mapInArrow(_feature_rows(bits), "label int, turn long, grams binary")
    # A key that repeats in the documents may bring more rows than were chosen.
    learnt = grams.orderBy("turn", "label", "grams").limit(max_rows).coalesce(1).mapInArrow(_train(bits, epochs), "weights binary")
    return np.frombuffer(bytes(learnt.head()["weights"]), "<f4")


def _score(weights, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, "<f4").astype(np.float64)
        for batch in batches:
            text, scores = batch.column(batch.schema.get_field_index("text")), []
            for n, buckets, owner in _per_text(text, bits):
                total = np.bincount(owner, weights=w[buckets], minlength=n)[:n]
                count = np.bincount(owner, minlength=n)[:n]
                scores.append(1.0 / (1.0 + np.exp(-np.clip(w[-1] + _SCALE * total / np.maximum(count, 1), -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names, "_score"])

    return run


def score_quality(docs: DataFrame, weights: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with all their columns and two more, which take the place of any of these names."""
    docs = docs.drop(score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4").tobytes())  # 4 bytes times 2**bits, whatever the input
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    scored = docs.mapInArrow(_score(shared, bits), f"{columns}, `{score}` double")
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learnt from ``labels`` outside the held-out fold."""
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    scored = score_quality(docs, train_quality(docs, labels), threshold=threshold, score="_corpusloom_score", predicted="_corpusloom_kept")
    return scored.filter("_corpusloom_kept = 1").select(*docs.columns)

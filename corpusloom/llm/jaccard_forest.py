"""Near duplicates by Jaccard similarity of word n-grams, found with a MinHash LSH forest and verified exactly.

Texts of equal n-gram sets are one node.  Every node has a label in each tree, a sequence of minima; sorting labels makes
a prefix trie, and two nodes meet in a tree where they share a prefix.  Prefixes are shortened from the whole label until
a pair at the threshold is met in some tree with the target probability.  Nodes that meet are compared by whole
signatures, those that may be similar are brought together, cut into blocks of bounded size, and all pairs of blocks
are verified on the n-gram sets themselves.  Pairs are never written: a block gives, per node, the number of
its links and one link to the smallest node it is linked with in the block.

Inputs: words are runs without ASCII white space; a text of fewer words than n is one gram of all its words; texts without
words (null, empty) are linked to nothing; repeated rows count as copies; null keys take part, a class is named by its
smallest key that is not null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, local_roots, whole_groups
from .components import components
from .hashing import PrefixHash, mix, word_spans
from .storage import partitions, stored

WORDS = 5
THRESHOLD = 0.8
TREES = 24
LABEL = 6
RECALL = 0.9999
# Signature agreement below which a pair is not verified: more than five standard deviations under the threshold.
MARGIN = 0.2
BLOCK = 512
_CHUNK_BYTES = 2_000_000


def prefix_length(trees: int, label: int, threshold: float, recall: float) -> int:
    """The longest prefix by which a pair at the threshold is met in some tree with probability ``recall``."""
    for depth in range(label, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def _minima_parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = (mix(np.arange(n), 11) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    return a, (mix(np.arange(n), 12) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gram_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _CHUNK_BYTES, side="right")))
        data = np.frombuffer(("\n".join(texts.slice(at, to - at).to_pylist()) + "\n").encode(), np.uint8)
        left, right = word_spans(data)
        hashed = PrefixHash(data).of(left, right)
        grams = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
        for j in range(words):
            grams = mix(grams ^ hashed[j : len(hashed) - words + 1 + j], 20 + j)
        cut = np.searchsorted(left, np.concatenate([[0], np.cumsum(sizes[at:to] + 1)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                few = np.zeros(1, np.uint64)
                for j in range(a, b):
                    few = mix(few ^ hashed[j], 40 + b - a)
                yield few
            else:
                yield np.zeros(0, np.uint64)
        at = to


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signature_rows(words: int, trees: int, label: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _minima_parameters(trees * label)
        for batch in batches:
            sets = list(gram_sets(batch.column(1), words))
            counts = np.array([len(s) for s in sets], np.int64)
            filled = np.flatnonzero(counts)
            minima = np.zeros((len(sets), trees * label), np.uint32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            flat = (flat >> np.uint64(32)).astype(np.uint32)
            if len(filled):
                starts = (np.cumsum(counts) - counts)[filled]
                for k in range(trees * label):
                    minima[filled, k] = np.minimum.reduceat(flat * a[k] + b[k], starts)
            labels = minima.reshape(len(sets), trees, label)
            keys = np.zeros((len(sets), trees), np.uint64)
            for k in range(depth):
                keys = mix(keys ^ labels[:, :, k], 60 + k)
            keys = mix(keys ^ np.arange(trees, dtype=np.uint64)[None, :], 59).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array(counts),
                    pa.array(list(keys), pa.list_(pa.int64())) if len(sets) else pa.array([], pa.list_(pa.int64())),
                    pa.array([row.tobytes() for row in (minima >> np.uint32(24)).astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "node", "grams", "keys", "signature"],
            )

    return run


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _meeting_links(width: int, least: float):
    """Links between nodes of a bucket whose signatures agree enough, thinned to one link per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "_i", "_j"]):
            nodes = np.array(table.column("node").to_pylist(), dtype=object)
            signature = _bytes_matrix(table.column("signature"), width)
            own = table.column("_own").to_numpy()
            cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
            sizes = np.diff(starts)
            left, right = [], []
            for size in (2, 3):  # nearly all groups: all of one size at once
                first = starts[:-1][(sizes == size) & ~cross[starts[:-1]]]
                for x in range(size):
                    for y in range(x + 1, size):
                        agree = (signature[first + x] == signature[first + y]).mean(axis=1) >= least
                        left.append(first[agree] + x)
                        right.append(first[agree] + y)
            for at in np.flatnonzero((sizes > 3) | (cross[starts[:-1]] & (sizes > 1))):
                a, b = starts[at], starts[at + 1]
                part = signature[a:b]
                agree = np.zeros((b - a, b - a), np.int16)
                for k in range(width):
                    agree += part[:, k][:, None] == part[:, k][None, :]
                linked = agree >= least * width
                if cross[a]:
                    linked &= own[a:b][:, None] != own[a:b][None, :]
                root = local_roots(linked)
                moved = np.flatnonzero(root != np.arange(b - a))
                left.append(a + root[moved])
                right.append(a + moved)
            left, right = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[left].tolist(), pa.binary()), pa.array(nodes[right].tolist(), pa.binary())], ["a", "b"])

    return run


def _set_rows(words: int):
    """Rows of the wanted nodes with their sets; a row whose text is not the node's (a repeated key) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in gram_sets(batch.column(0), words)]
            same = pa.array([_digest(s) == node for s, node in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], [*batch.schema.names[1:], "set"])
            yield out.filter(same)

    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    if n <= 4:
        out = np.diag([len(s) for s in sets]).astype(np.int64)
        for x in range(n):
            for y in range(x + 1, n):
                out[x, y] = out[y, x] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    out, step = np.zeros((n, n), np.float64), 8192
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, step):
        a, b = np.searchsorted(gram, [low, low + step])
        part = np.zeros((n, step), np.float32)
        part[row[a:b], gram[a:b] - low] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _verified(threshold: float):
    """Per node of a pair of blocks: the number of documents it is linked with there, and the smallest node among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["root", "_i", "_j"]):
            nodes, packed = table.column("node").to_pylist(), table.column("set").to_pylist()
            own, copies = table.column("_own").to_numpy(), table.column("copies").to_numpy()
            cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
            found, roots, links = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                # A repeated key may have brought a node more than once.
                at = np.array(sorted({nodes[i]: i for i in range(a, b)}.values(), key=lambda i: nodes[i]))
                if len(at) < 2:
                    continue
                shared = _shared_counts([np.frombuffer(packed[i], np.uint64) for i in at])
                size = np.diag(shared)
                linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                np.fill_diagonal(linked, False)
                if cross[a]:
                    linked &= own[at][:, None] != own[at][None, :]
                root = local_roots(linked)
                some = np.flatnonzero(linked.any(axis=1))
                found += [nodes[at[i]] for i in some]
                roots += [nodes[at[root[i]]] for i in some]
                links += (linked[some] @ copies[at]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(roots, pa.binary()), pa.array(links, pa.int64())], ["node", "near", "links"])

    return run


def jaccard_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Returns doc_id, class_id (smallest key of the documents connected by links), n_links (documents at the threshold or
    above, equal ones included) and n_grams.
    """
    n = partitions(docs.sparkSession)
    depth, width = prefix_length(trees, label, threshold, recall), trees * label
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(typed.mapInArrow(_signature_rows(words, trees, label, depth), "doc_id long, node binary, grams long, keys array<long>, signature binary"), "forest-rows")
    some = rows.filter("grams > 0")
    nodes = some.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    labels = some.select("node", "keys", "signature").dropDuplicates(["node"])

    # Buckets of two nodes or more.
    meets = labels.select("node", F.explode("keys").alias("key"))
    sizes = meets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = meets.join(sizes, "key").join(labels.select("node", "signature"), "node")
    dealt = block_pairs(met, "key", "size", "node", 2 * block).select("key", "_i", "_j", "_own", "node", "signature")
    dealt = dealt.repartition(n, "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "signature")
    near = components(dealt.mapInArrow(_meeting_links(width, threshold - MARGIN), "a binary, b binary"))

    # What may be similar is brought together with its sets and verified.
    near = stored(near.join(nodes, "node"), "forest-near")
    asked = near.join(near.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    # Both sides are sorted by key at any size: what is asked for grows with the input.
    texts = typed.withColumnRenamed("doc_id", "_key").join(asked.hint("merge"), F.col("_key").eqNullSafe(F.col("first_doc")))
    kinds = "node binary, root binary, copies long, size long"
    sets = texts.select("text", "node", "root", "copies", "size").mapInArrow(_set_rows(words), f"{kinds}, set binary")
    pairs = block_pairs(sets, "root", "size", "node", block).select("root", "_i", "_j", "_own", "node", "copies", "set")
    pairs = pairs.repartition(n, "root", "_i", "_j").sortWithinPartitions("root", "_i", "_j")
    verified = stored(pairs.mapInArrow(_verified(threshold), "node binary, near binary, links long"), "forest-links")
    joined = components(verified.select(F.col("node").alias("a"), F.col("near").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))

    placed = nodes.join(joined, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    placed = placed.join(names, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "node", "grams").join(placed, "node", "left")
    alone = F.col("grams") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("grams").alias("n_grams"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key names their class; rows that repeat a key stay or go together."""
    classes = jaccard_classes(docs, **options)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_corpusloom_key")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_corpusloom_key")), "left_semi")

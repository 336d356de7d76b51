"""Near-duplicate join on word shingles: MinHash LSH forest, then exact verification.

1. Texts with the same words are one node. A node has a signature of ``TREES`` trees, each a sequence of minima of
   ``DEPTH`` hash functions over its shingles of five words (of all words, if fewer).
2. In each tree, signatures are sorted by prefix. Nodes with an equal prefix are candidates. The prefix starts at the
   full depth and is shortened until the recall of pairs at the threshold, 1 - (1 - s^k)^TREES, reaches the target.
3. Candidates that hang together form families; a family's nodes come together with their texts. Families with many
   shingles are dealt to blocks, and each pair of blocks is looked at once.
4. Jaccard similarities of all pairs within a family are computed exactly inside the task. Only counts and a spanning set
   of links leave it.

Defined cases: null texts and texts without words have no shingles, no links and a class of their own; equal texts are
copies of one another and count as links; repeated rows are copies; null ids take part and come back as null, and a class
is named by the least id of its documents that is not null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import regions
from tallyhouse.llm.components import components
from tallyhouse.llm.shipping import ship
from tallyhouse.llm.words import ALPHANUMERIC, IN_ALPHANUMERIC, Words, alphanumeric_words, mix, prefix_hash, row_blocks, span_hash, text_bytes
from tallyhouse.session import stage

SHINGLE = 5
SIMILARITY = 0.8
TREES, DEPTH = 20, 6
TARGET_RECALL = 0.9999

#: A text without any has no words.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Shingles and texts of one block of a family; two blocks meet in a task.
BLOCK_SHINGLES = 1 << 20
BLOCK_TEXTS = 500

#: Bytes of words, A-Z lower-cased; blanks elsewhere.
_WORDS_ONLY = np.where(IN_ALPHANUMERIC, ALPHANUMERIC, ord(" ")).astype(np.uint8).tobytes()

_FACTORS = np.random.default_rng(514).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix, from the full depth down, at which pairs of that similarity meet often enough."""
    for k in range(DEPTH, 0, -1):
        if 1 - (1 - similarity**k) ** trees >= target:
            return k
    return 1


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and each row's first; a row of fewer words has one shingle of all."""
    counts = np.diff(words.first)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    start = words.first[row] + np.arange(first[-1]) - first[row]
    end = np.minimum(start + size, words.first[row + 1])
    return span_hash(prefix_hash(words.hash), start, end), first


SIGNATURE_SCHEMA = "doc_id long, row_hash long, node binary, n int, prefixes array<long>"


def _signatures(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in row_blocks(offsets):
                words = alphanumeric_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes, first = shingles(words)
                some = np.flatnonzero(np.diff(first))
                minima = np.zeros((len(some), TREES, k), np.uint64)
                for tree in range(TREES):
                    for level in range(k):
                        drawn = (hashes * _FACTORS[tree * DEPTH + level]) >> np.uint64(32)
                        if len(some):
                            minima[:, tree, level] = np.minimum.reduceat(drawn, first[some])
                prefix = np.full((len(some), TREES), 0, np.uint64)
                for level in range(k):
                    prefix = mix(prefix * np.uint64(0x100000001B3) + minima[:, :, level] + np.uint64(1))
                raw = data[offsets[a] : offsets[b]].tobytes().translate(_WORDS_ONLY)
                bounds = offsets[a : b + 1] - offsets[a]
                nodes = [None] * (b - a)
                lists = [None] * (b - a)
                for at, row in enumerate(some.tolist()):
                    spoken = b" ".join(raw[bounds[row] : bounds[row + 1]].split())
                    nodes[row] = hashlib.blake2b(spoken, digest_size=16).digest()
                    lists[row] = prefix[at].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(nodes, pa.binary()),
                        pa.array(np.diff(first).astype(np.int32)),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row_hash", "node", "n", "prefixes"],
                )

    return sign


def _candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) from each node to the least one with the same prefix in a tree."""
    in_trees = nodes.select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = (
        in_trees.groupBy("tree", "prefix")
        .agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("k"))
        .filter(F.col("k") > 1)
        .drop("k")
    )
    # read back, so that the join's own exchange lets hot prefixes be split
    return in_trees.join(stage(shared, "prefixes"), ["tree", "prefix"]).select(F.col("node").alias("a"), F.col("least").alias("b"))


def _family_blocks(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of families of two or more, with each pair of blocks (left, right) that they belong to."""
    member = nodes.join(roots, "node").withColumnRenamed("root", "family")
    sizes = member.groupBy("family").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    # read back, so that the join's own exchange lets large families be split
    sizes = stage(sizes.select("family", blocks.alias("blocks")), "sizes")
    placed = member.join(sizes, "family").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("*", other).select(
        "node", "copies", "doc_id", "row_hash", "family", "block",
        F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
    )


LINK_SCHEMA = "node binary, linked long, least binary"


class _Group:
    """The texts of two blocks of a family."""

    def __init__(self, key):
        self.key, self.nodes, self.copies, self.blocks, self.sets = key, [], [], [], []

    def add(self, node: bytes, copies: int, block: int, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        hashes, _ = shingles(alphanumeric_words(data, np.array([0, len(data)])))
        self.nodes.append(node)
        self.copies.append(copies)
        self.blocks.append(block)
        self.sets.append(np.unique(hashes))

    def links(self) -> Iterator[tuple[bytes, int, bytes]]:
        """Of each node: copies of the texts that it is similar to here, and the least node that these links lead to."""
        n = len(self.sets)
        sizes = np.array([len(s) for s in self.sets], np.int64)
        block = np.array(self.blocks)
        _, left, right = self.key
        wanted = np.ones((n, n), bool) if left == right else block[:, None] != block[None, :]
        np.fill_diagonal(wanted, False)
        # sizes alone rule out pairs of very different ones
        wanted &= 10 * np.minimum(sizes[:, None], sizes[None, :]) >= 8 * np.maximum(sizes[:, None], sizes[None, :])
        common = self._common(wanted)
        similar = wanted & (9 * common >= 4 * (sizes[:, None] + sizes[None, :]))
        linked = similar @ np.array(self.copies, np.int64)
        order = np.argsort(np.array(self.nodes, object))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        root = rank.copy()
        a, b = np.nonzero(np.triu(similar))
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            if (before == root).all():
                break
        for k in np.flatnonzero(linked).tolist():
            yield self.nodes[k], int(linked[k]), self.nodes[order[root[k]]]

    def _common(self, wanted: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of wanted pairs."""
        n = len(self.sets)
        common = np.zeros((n, n), np.int64)
        a, b = np.nonzero(np.triu(wanted))
        if not len(a):
            return common
        every = np.concatenate(self.sets)
        _, place, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        if len(shared) * float(n) * n / 2e10 < len(a) * 3e-5:
            column = np.full(len(times), -1)
            column[shared] = np.arange(len(shared))
            row = np.repeat(np.arange(n), [len(s) for s in self.sets])
            at = column[place]
            row, at = row[at >= 0], at[at >= 0]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            total = np.zeros((n, n), np.float32)
            for first in range(0, len(shared), 2048):
                low, high = np.searchsorted(at, [first, first + 2048])
                part = np.zeros((n, 2048), np.float32)
                part[row[low:high], at[low:high] - first] = 1
                total += part @ part.T
            return np.rint(total).astype(np.int64)
        for i, j in zip(a.tolist(), b.tolist()):
            short, long = sorted((self.sets[i], self.sets[j]), key=len)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            common[i, j] = common[j, i] = int((long[at] == short).sum())
        return common


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by family and pair of blocks."""

    def table(group: _Group) -> pa.RecordBatch:
        columns = list(zip(*group.links())) or [()] * 3
        kinds = [pa.binary(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["node", "linked", "least"])

    group = None
    for batch in batches:
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            row = {name: c[k].as_py() for name, c in columns.items()}
            key = (row["family"], row["left"], row["right"])
            if group is None or group.key != key:
                if group is not None:
                    yield table(group)
                group = _Group(key)
            if group.nodes and group.nodes[-1] == row["node"]:
                continue  # identical rows give a node's text several times
            group.add(row["node"], row["copies"], row["block"], regions.unpacked(row["z"], row["size"]))
    if group is not None:
        yield table(group)


def similar_classes(docs: DataFrame, target: float = TARGET_RECALL) -> DataFrame:
    """Per row: doc_id, row_hash, class_id, n_links and n_copies (documents of the same words, itself included).

    ``n_links`` counts the other documents with a similarity of at least 0.8; ``class_id`` is the least id of the
    documents that links lead to; ``keeper`` marks the rows equal to the one that stands for the class.
    """
    ship(docs.sparkSession)
    texts = regions.keyed(docs)
    signed = stage(texts.mapInArrow(_signatures(prefix_length(target=target)), SIGNATURE_SCHEMA), "signatures")
    nodes = stage(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("doc_id", "row_hash")).alias("at"),
            F.min(F.when(F.col("doc_id") != regions.NO_ID, F.col("doc_id"))).alias("least_id"),
            F.first("n").alias("n"),
            F.first("prefixes").alias("prefixes"),
        )
        .select("node", "copies", "at.*", "least_id", "n", "prefixes"),
        "nodes",
    )
    roots = components(_candidates(nodes))
    placed = _family_blocks(nodes.drop("prefixes", "least_id"), roots)
    grouped = regions.packed(texts).join(placed, regions.KEY).select(
        "family", "left", "right", "block", "node", "copies", "z", "size"
    )
    keys = ["family", "left", "right"]
    sorted_blocks = grouped.repartition(*keys).sortWithinPartitions(*keys, "node")
    links = stage(sorted_blocks.mapInArrow(_verify, LINK_SCHEMA), "links")

    verified = components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    in_class = nodes.select("node", "copies", "least_id", "doc_id", "row_hash").join(verified, "node", "left")
    in_class = in_class.withColumn("root", F.coalesce("root", "node"))
    named = in_class.groupBy("root").agg(
        F.min("least_id").alias("class_id"), F.min(F.struct("doc_id", "row_hash")).alias("keeper")
    )
    known = in_class.join(stage(named, "named"), "root").join(linked, "node", "left").select(
        "node", "copies", "class_id", "keeper", F.coalesce("linked", F.lit(0)).alias("linked")
    )
    own = F.col("node").isNull()
    doc_id = F.when(F.col("doc_id") != regions.NO_ID, F.col("doc_id"))
    return signed.select("doc_id", "row_hash", "node").join(known, "node", "left").select(
        doc_id.alias("doc_id"),
        "row_hash",
        F.when(own, doc_id).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(0)).otherwise(F.col("linked") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (own | (F.col("keeper") == F.struct("doc_id", "row_hash"))).alias("keeper"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; those without words all stay."""
    hashed = docs.withColumn("__row_hash", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    keepers = similar_classes(docs).filter("keeper").select("doc_id", F.col("row_hash").alias("__row_hash"))
    counted = keepers.groupBy("doc_id", "__row_hash").agg(F.count(F.lit(1)).alias("__k"))
    wanted = stage(
        counted.select(F.col("doc_id").alias("__doc_id"), F.col("__row_hash").alias("__wanted"), "__k"), "keepers"
    )
    kept = hashed.join(
        wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__row_hash") == F.col("__wanted"))
    )
    # identical rows stand for a class together; those without words all stay
    repeated = (F.col("__k") > 1) & F.coalesce("text", F.lit("")).rlike(ANY_WORD)
    if not wanted.filter("__k > 1").isEmpty():
        kept = kept.filter(~repeated).unionAll(kept.filter(repeated).dropDuplicates(["doc_id", "__row_hash"]))
    return kept.select(*[f"`{c}`" for c in docs.columns])

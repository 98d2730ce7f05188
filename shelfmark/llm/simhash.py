"""SimHash near-duplicates by a Gray-ordered hierarchical index (operator 10).

A fingerprint is 64 bits over word shingles. Two fingerprints that differ in at most
`radius` bits agree on one of `radius + 1` blocks of bits, so every distinct fingerprint
enters that many nodes; a node is the (mask, pattern) of the bits that its members share.
Members of a node are sorted by Gray rank, so neighbours share bits: leaves of neighbours,
and upper nodes over the leaves, keep the bits that all below them share as (mask,
pattern). Pairs of nodes are followed from the top; each level adds the differences on the
bits that are new there, and a pair is left out with all below it as soon as the sum
exceeds `radius`. A node with too many members for one task is cut into tiles of Gray
neighbours; pairs of tiles whose shared bits allow a link are compared, each in a task of
its own. What comes out is one star per cluster and node, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, materialise, packed, utf8, whole_text

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HASH_ROWS = 1 << 15
#: Members of a leaf, children of an upper node, and pairs of leaves compared at once.
_LEAF, _FAN, _PAIRS = 16, 8, 1 << 12
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the XXH64 bits (seed 42) of a text's word shingles; zero without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        begin, end = starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASH_ROWS):
        part = hashes[i : i + _HASH_ROWS].astype(hashes.dtype.newbyteorder(">"))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp): one row per document; th is the hash that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(2))
            raw = body.tobytes()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "th", "fp"])

    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("th"), whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of the `radius + 1` blocks of bits of which two fingerprints within `radius` bits share one."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _gray_rank(bits):
    for by in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, by))
    return bits


class _Groups:
    """Labels of joined rows; a label is the least row of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            open_ = low != high
            if not open_.any():
                return
            np.minimum.at(self.label, high[open_], low[open_])
            while True:  # labels point to roots
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            a, b = a[open_], b[open_]


def _stars(fps: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, first fingerprint of its cluster) for those with a partner in their node; rows come by node, in Gray order."""
    edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.concatenate([edges, [len(fps)]]))
    groups = _Groups(len(fps))
    step = 1
    left = np.flatnonzero(np.repeat(size <= 4 * _LEAF, size))
    while len(left):
        left = left[left + step < len(fps)]
        left = left[node[left + step] == node[left]]
        near = np.bitwise_count(fps[left] ^ fps[left + step]) <= radius
        groups.join(left[near], left[near] + step)
        step += 1
    linked = np.flatnonzero(groups.label != np.arange(len(fps)))
    found = [(fps[linked], fps[groups.label[linked]])]
    for start, count in zip(edges[size > 4 * _LEAF].tolist(), size[size > 4 * _LEAF].tolist(), strict=True):
        own = fps[start : start + count]
        label = _tree_groups(own, radius)
        linked = np.flatnonzero(label != np.arange(count))
        found.append((own[linked], own[label[linked]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tree_groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the fingerprints of one node, in Gray order, by its tree of shared bit patterns."""
    ones, some = fps, fps
    levels = []
    fan = _LEAF
    while not levels or len(levels[-1][0]) > 1:
        cuts = np.arange(0, len(ones), fan)
        ones, some = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(some, cuts)
        levels.append((ones, ~(ones ^ some)))
        fan = _FAN
    first = second = np.zeros(1, np.int64)
    apart, seen = np.zeros(1, np.int64), np.zeros(1, np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        if depth < len(levels) - 1:
            kids = np.arange(_FAN)
            a = (first[:, None, None] * _FAN + kids[None, :, None] + 0 * kids[None, None, :]).ravel()
            b = (second[:, None, None] * _FAN + 0 * kids[None, :, None] + kids[None, None, :]).ravel()
            apart, seen = np.repeat(apart, _FAN * _FAN), np.repeat(seen, _FAN * _FAN)
            there = (a <= b) & (b < len(pattern))
            first, second, apart, seen = a[there], b[there], apart[there], seen[there]
        both = mask[first] & mask[second]
        apart = apart + np.bitwise_count((pattern[first] ^ pattern[second]) & both & ~seen)
        near = apart <= radius
        first, second, apart, seen = first[near], second[near], apart[near], both[near]
    groups = _Groups(len(fps))
    inside = np.arange(_LEAF)
    for at in range(0, len(first), _PAIRS):
        a = (first[at : at + _PAIRS, None] * _LEAF + inside)[:, :, None]
        b = (second[at : at + _PAIRS, None] * _LEAF + inside)[:, None, :]
        last = len(fps) - 1
        near = (np.bitwise_count(fps[np.minimum(a, last)] ^ fps[np.minimum(b, last)]) <= radius) & (a < b) & (b <= last)
        pair, i, j = np.nonzero(near)
        groups.join(a[pair, i, 0], b[pair, 0, j])
    return groups.label


def _node_links(radius: int):
    """Edges (a, b) of rows (fp, mask, pattern) that come by node, in Gray order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.uint64)] * 3
        for batch in batches:
            kept = [np.concatenate([old, batch.column(i).to_numpy().view(np.uint64)]) for i, old in enumerate(kept)]
            yield from whole(kept, last=False)
            kept = rest(kept)
        yield from whole(kept, last=True)

    def begin_of_last(rows: list[np.ndarray]) -> int:
        """The last node may go on in the next batch."""
        changes = np.flatnonzero((rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
        return int(changes[-1]) + 1 if len(changes) else 0

    def rest(rows: list[np.ndarray]) -> list[np.ndarray]:
        return [x[begin_of_last(rows) :] for x in rows]

    def whole(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        cut = len(rows[0]) if last else begin_of_last(rows)
        if not cut:
            return
        fps, mask, pattern = (x[:cut] for x in rows)
        node = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))])
        a, b = _stars(fps, node, radius)
        if len(a):
            yield _edges(a, b)

    return run


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def links(distinct: DataFrame, radius: int = 2, largest_node: int = 1 << 15) -> DataFrame:
    """Edges (a, b), b the lesser, that connect all fingerprints within `radius` bits, for any radius from 0 to 63.

    distinct has one column fp without repeats. A node of more than `largest_node`
    fingerprints is not taken into one task but compared by pairs of tiles.
    """
    masks = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(radius)])).alias("mask")
    members = distinct.select("fp", masks).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), _gray_rank(F.col("fp")).alias("rank"))
    # a table of its own, so that the joins below can split a hot node
    large = materialise(members.groupBy("mask", "pattern").count().where(F.col("count") > largest_node).select("mask", "pattern"), "large")
    if large.isEmpty():
        return _inside(members, radius).distinct()
    crowded = materialise(_tiled(members.join(large, ["mask", "pattern"], "left_semi"), largest_node), "tiled")
    return _inside(members.join(large, ["mask", "pattern"], "left_anti"), radius).unionByName(_inside(_tile_pairs(crowded, radius), radius)).distinct()


def _inside(members: DataFrame, radius: int) -> DataFrame:
    """Edges inside each (mask, pattern)."""
    dealt = members.select("fp", "mask", "pattern", "rank").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
    return dealt.mapInArrow(_node_links(radius), "a long, b long")


def _tiled(members: DataFrame, largest_node: int) -> DataFrame:
    """The members with the `tile` of their node: at most `largest_node` neighbours by Gray rank. No task takes a whole node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, size = TaskContext.get().partitionId() << 40, -1, 0
        held: tuple | None = None
        for batch in batches:
            mask, pattern = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            tiles = []
            for node in zip(mask, pattern, strict=True):
                if node != held or size == largest_node:
                    held, number, size = node, number + 1, 0
                size += 1
                tiles.append(place + number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles, pa.int64())], [*batch.schema.names, "tile"])

    dealt = members.select("fp", "mask", "pattern", "rank").repartitionByRange("mask", "pattern", "rank").sortWithinPartitions("mask", "pattern", "rank")
    return dealt.mapInArrow(run, "fp long, mask long, pattern long, rank long, tile long")


def _tile_pairs(crowded: DataFrame, radius: int) -> DataFrame:
    """The members of every pair of tiles of a node (with itself, too) whose shared bits differ in `radius` places at most; mask is the pair's number."""
    shared = crowded.groupBy("mask", "pattern", "tile").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
    tiles = materialise(shared.withColumn("same", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some")))).drop("some"), "tiles")
    other = tiles.select("mask", "pattern", *[F.col(c).alias(f"o_{c}") for c in ("tile", "ones", "same")])
    apart = F.bit_count(F.col("ones").bitwiseXOR(F.col("o_ones")).bitwiseAND(F.col("same")).bitwiseAND(F.col("o_same")))
    near = tiles.join(other, ["mask", "pattern"]).where("tile <= o_tile").where(apart <= radius)
    pairs = materialise(near.select(F.explode(F.array_distinct(F.array("tile", "o_tile"))).alias("tile"), F.xxhash64("tile", "o_tile").alias("one"), F.xxhash64("o_tile", "tile", F.lit(1)).alias("two")), "pairs")
    return crowded.select("fp", "rank", "tile").join(pairs, "tile").select("fp", F.col("one").alias("mask"), F.col("two").alias("pattern"), "rank")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node of each connected component, by alternating large and small stars until nothing moves.

    What an aggregation gives is written before it is joined, so that Spark can split the
    rows of a hub there.
    """
    now = materialise(edges.select("a", "b"), "star")
    before = _sum(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialise(small, "star")
        discard(now, least, large, low)
        now, moved = after, _sum(after)
        if moved == before:
            break
        before = moved
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, largest_node: int = 1 << 15) -> DataFrame:
    """Near-duplicate class of every document: (doc_id, th, fp, root, component_id, component_size).

    component_id is the smallest doc_id that a chain of links reaches (null ids are
    passed over; null if no other is there). Null and empty texts have fingerprint zero
    and link like others; rows that repeat a doc_id stay separate rows of one class.
    """
    rows = materialise(fingerprints(docs, shingle), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    roots = components(links(distinct.select("fp"), radius, largest_node))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.sum("n").alias("component_size"))
    by_fp = placed.select("fp", "root").join(classes, "root")
    return rows.join(by_fp, "fp").select("doc_id", "th", "fp", "root", "component_id", "component_size")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents with one of each near-duplicate class left: the one of the smallest doc_id, then text hash.

    Of rows that are equal in doc_id and text one stays. Columns are those of the input.
    """
    return keep_chosen(docs, near_duplicates(docs, shingle, radius))


def keep_chosen(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents with the first of each class left; classes has (doc_id, th, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    chosen = classes.groupBy("root").agg(F.min(order).alias("k"))
    chosen = chosen.select(F.col("k.doc_id").alias("k_id"), F.col("k.th").alias("k_th"))
    repeated = classes.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th"))
    kept = packed(docs).join(chosen, same, "left_semi")
    twice = kept.join(repeated, same, "left_semi").dropDuplicates(["id", "th"])
    return kept.join(repeated, same, "left_anti").unionByName(twice).select("row.*")


def op10_simhash_gray_index(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")

"""Operator 3, SimHash near-duplicates: vantage-point trees over Hamming distance.

Method: two fingerprints of 64 bits that differ in at most 3 differ in at most 1 in one of their halves,
so each half has a vantage-point tree with radius 1.  A node of the tree holds a vantage point and a
distance; a fingerprint goes to the side it lies on, and as a guest also to the other side where the
triangle inequality can't rule out a partner there.  The leaves are the shards: inside one, fingerprints
are ordered by the distance to a vantage point and only compared within the triangle bound, exactly, over
all 64 bits.  A shard gives the links of a spanning forest, not all pairs; components are then found over
the links.  Equal fingerprints are one node, so copies never meet each other.

The tree is built from a bounded sample of fingerprints; it only decides where comparisons take place.
A shard that holds too many is compared block against block, so no task holds more than two blocks.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other; rows with a null doc_id take part, and a component of such rows alone has a null component_id;
repeated rows are one node; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import connected_components
from quarry.staging import stage

BITS = 3
SHINGLE = 3
#: Fingerprints that the trees are built from, about (twice as many at most): those of least hash.
SAMPLE = 65_536
#: Fingerprints meant for a leaf, and those compared at a time in one that has more.
LEAF, BLOCK = 1_000, 16_384


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)].astype(">u8")
        votes += np.unpackbits(some.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "__fp") -> DataFrame:
    """``docs`` with the signed fingerprint of each whole text."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for t in texts.to_pylist()], type=pa.int64())

    return docs.withColumn(into, prints(F.col(f"`{text}`").cast("string")))


def hex_fingerprint(column: str = "__fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _half(fps: np.ndarray, half: int) -> np.ndarray:
    return (fps.astype(np.int64).view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """A tree over 32-bit points as rows (vantage, distance, near child, far child); a negative child -1-k is leaf k.

    A node's vantage is one of its points, the distance splits them in two as evenly as can be.
    """
    nodes: list[list[int]] = []
    n_leaves = 0
    enough = max(4, -(-len(sample) // max(1, leaves)))
    stack = [(np.unique(sample), -1, 0)]
    while stack:
        points, parent, side = stack.pop()
        me = None
        if len(points) > enough:
            vantage = int(points[len(points) // 2])
            away = np.bitwise_count(points ^ np.uint32(vantage)).astype(np.int64)
            below = np.cumsum(np.bincount(away, minlength=33))
            cut = int(np.argmin(np.abs(below - len(points) / 2)))
            if 0 < below[cut] < len(points):
                me = len(nodes)
                nodes.append([vantage, cut, 0, 0])
                stack += [(points[away <= cut], me, 2), (points[away > cut], me, 3)]
        if me is None:
            me = -1 - n_leaves
            n_leaves += 1
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, tree: list[tuple[int, int, int, int]], radius: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether the leaf is its own): its own leaf and all that may hold a partner within ``radius``."""
    out = []
    stack = [(0 if tree else -1, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while stack:
        node, at, own = stack.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, np.full(len(at), -1 - node), own))
            continue
        vantage, cut, near, far = tree[node]
        away = np.bitwise_count(points[at] ^ np.uint32(vantage)).astype(np.int64)
        stack.append((near, at[away - radius <= cut], (own & (away <= cut))[away - radius <= cut]))
        stack.append((far, at[away + radius > cut], (own & (away > cut))[away + radius > cut]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k]; ``label`` holds each element's root."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not (label[label] == label).all():
            label[:] = label[label]


def forest(fps: np.ndarray, own: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span what is connected by pairs within ``bits`` of which one lies in its own shard."""
    fps, first = np.unique(fps.astype(np.int64).view(np.uint64), return_index=True)
    own = own[first]
    if len(fps) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    away = np.bitwise_count(fps ^ fps[len(fps) // 2]).astype(np.int64)
    order = np.argsort(away, kind="stable")
    fps, own, away = fps[order], own[order], away[order]
    label = np.arange(len(fps))
    for k in range(0, len(fps), 256):
        rows = slice(k, min(k + 256, len(fps)))
        upto = int(np.searchsorted(away, away[rows.stop - 1] + bits, side="right"))
        for c in range(k, upto, 4096):
            cols = slice(c, min(c + 4096, upto))
            near = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= bits
            i, j = np.nonzero(near)
            i, j = i + k, j + c
            real = (i < j) & (own[i] | own[j])
            if real.any():
                _unite(label, i[real], j[real])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[label[linked]].view(np.int64)


def links(distinct: DataFrame, bits: int = BITS, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (column ``fp``) that connect all pairs within ``bits``."""
    spark = distinct.sparkSession
    n = distinct.count()
    # about ``sample`` of them by their hash: what reaches the driver doesn't grow with the partitions
    below = int(2**64 * min(1.0, sample / max(1, n))) - 2**63 - 1
    drawn = np.sort(distinct.where(F.xxhash64("fp") <= F.lit(below)).limit(2 * sample).toPandas()["fp"].to_numpy(dtype=np.int64))
    leaves = max(1, n // leaf)
    trees = [build_tree(_half(drawn, half), leaves) for half in (0, 1)]

    def shards(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                at, where, own = route(_half(fps, half), tree, bits // 2)
                yield pa.record_batch([pa.array(where * 2 + half, type=pa.int64()), pa.array(fps[at]), pa.array(own)], names=["shard", "fp", "own"])

    routed = stage(distinct.select("fp").mapInArrow(shards, "shard bigint, fp bigint, own boolean"), "vp-shards")
    blocks = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    # at most two shards for each fingerprint of the sample
    dealt = routed.join(F.broadcast(blocks), "shard").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shard", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "fp", "own")

    def compare(table):
        a, b = forest(table.column("fp").to_numpy(), table.column("own").to_numpy(zero_copy_only=False), bits)
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return dealt.groupBy("shard", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(printed: DataFrame, fp: str = "__fp", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``printed`` (with a fingerprint column, staged: it is read twice) with component_id, the least doc_id reachable."""
    by_fp = stage(printed.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(f"`{doc_id}`").alias("least")), "fingerprints")
    members = stage(connected_components(links(by_fp, bits)), "fp-components")
    least = members.join(by_fp, members["node"] == by_fp["fp"]).groupBy("component").agg(F.min("least").alias("__least"))
    named = members.join(least, "component").select("node", "__least")
    classes = by_fp.join(named, by_fp["fp"] == named["node"], "left").select(F.col("fp").alias("__node"), F.coalesce("__least", "least").alias("component_id"))
    classes = stage(classes, "fp-classes")  # so that the join below has plain shuffles, which Spark splits for a hot fingerprint
    kept = [F.col(f"`{c}`") for c in printed.columns if c != "component_id"]
    return printed.select(*kept).join(classes, F.col(f"`{fp}`") == F.col("__node"), "left").select(*kept, "component_id")

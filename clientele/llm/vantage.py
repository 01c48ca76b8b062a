"""Vantage-point trees over 64-bit fingerprints: all links within a Hamming distance.

Distances between whole fingerprints crowd around 32, so a tree over all bits would send nearly
every point to both sides of every boundary. The bits are therefore cut into parts: two
fingerprints at most ``radius`` apart are at most ``radius // parts`` apart in one of them, and
there is a tree for each part that measures distance in its bits only. At a node with vantage
point v and median m, points within m go inside, the others outside, and outside points up to m +
r go inside as well: by the triangle inequality no other pair can cross the boundary. The top of
each tree is grown from a bounded sample and decides only the shards; a task grows the rest of its
shard and compares whole fingerprints in the leaves. The sample changes the work, never the links.

A shard above ``MAX_SHARD_ROWS`` (many points that agree in a part's bits) is dealt out as pairs of
blocks, so no task grows with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from clientele.llm.common import stage

RADIUS = 4
PARTS = 3
SHARD_ROWS = 16_384  # aim, before overlap
MAX_SHARDS = 16_384  # a part; also bounds the sample
SAMPLE_A_SHARD = 32
MAX_SHARD_ROWS = 131_072
_LEAF = 384


def part_masks(parts: int = PARTS) -> list[np.uint64]:
    """The bits of each part, spread evenly over the 64."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [np.uint64(sum(1 << b for b in range(lo, hi))) for lo, hi in zip(edges, edges[1:])]


def _boundary(points: np.ndarray, mask: np.uint64, rng: np.random.Generator):
    """A vantage point and a radius that cut the points most evenly, or None."""
    best = None
    for v in points[rng.integers(0, len(points), 4)] & mask:
        d = np.bitwise_count((points & mask) ^ v)
        for m in {int(np.median(d)), int(np.median(d)) - 1}:
            inner = int((d <= m).sum())
            side = min(inner, len(points) - inner)
            if side and (best is None or side > best[0]):
                best = (side, v, m)
    return best and best[1:]


class Tree:
    """The top of a tree: nodes in arrays, leaves numbered."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, leaves: int, seed: int = 7):
        self.mask, self.radius, self.leaves = mask, radius, 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, leaves, rng)

    def _grow(self, points, leaves, rng):
        cut = _boundary(points, self.mask, rng) if leaves > 1 and len(points) > 3 else None
        if cut is None:
            self.leaves += 1
            return self.leaves - 1
        v, m = cut
        inner = np.bitwise_count((points & self.mask) ^ v) <= m
        return v, m, self._grow(points[inner], leaves // 2, rng), self._grow(points[~inner], leaves // 2, rng)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of every place a point goes to."""
        rows, homes = [], []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if isinstance(node, int):
                rows.append(idx)
                homes.append(np.full(len(idx), node, np.int32))
                continue
            v, m, inside, outside = node
            d = np.bitwise_count((points[idx] & self.mask) ^ v)
            todo += [(inside, idx[d <= m + self.radius]), (outside, idx[d > m])]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(rows), np.concatenate(homes)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of ``n`` nodes, by label passing."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)  # hook the roots together
        np.minimum.at(label, before[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    return label


def _scan(points: np.ndarray, idx: np.ndarray, radius: int, out: list) -> None:
    """Walk components by comparing each reached point with those not yet reached."""
    left = idx
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            p = queue.pop()
            near = np.bitwise_count(points[left] ^ points[p]) <= radius
            if near.any():
                reached = left[near]
                out.append((np.full(len(reached), p), reached))
                queue.extend(reached.tolist())
                left = left[~near]


def links(points: np.ndarray, mask: np.uint64, bound: int, radius: int = RADIUS,
          others: tuple[np.uint64, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join, component by component, all points within ``radius``.

    Finds every link between points at most ``bound`` apart in the bits of ``mask``. Points that
    those bits cannot part go down trees over the bits of ``others``.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rng = np.random.default_rng(11)
    wide = radius // len(others) if others else 0
    todo = [(np.arange(len(points)), mask, bound, tuple(others), False)]
    while todo:
        idx, bits, r, rest, stuck = todo.pop()
        if len(idx) < 2:
            continue
        if len(idx) <= _LEAF:
            d = np.bitwise_count(points[idx][:, None] ^ points[idx][None, :]) <= radius
            i, j = np.nonzero(np.triu(d, 1))
            if len(i):
                label = _settle(len(idx), i, j)
                own = np.flatnonzero(label != np.arange(len(idx)))
                out.append((idx[label[own]], idx[own]))
            continue
        cut = None if stuck else _boundary(points[idx], bits, rng)
        if cut is not None:
            v, m = cut
            d = np.bitwise_count((points[idx] & bits) ^ v)
            inner, outer = idx[d <= m + r], idx[d > m]
            if len(inner) + len(outer) < 1.9 * len(idx) and max(len(inner), len(outer)) < 0.95 * len(idx):
                todo += [(inner, bits, r, rest, False), (outer, bits, r, rest, False)]
                continue
        if rest:
            todo += [(idx, other, wide, (), False) for other in rest]
        else:
            _scan(points, idx, radius, out)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _unsigned(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


def near_links(prints: DataFrame, col: str, radius: int = RADIUS, parts: int = PARTS,
               shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): edges that connect exactly what chains of links within ``radius`` connect.

    ``prints`` has one row per different fingerprint (long) in ``col``; nulls link nothing. A shard
    gives at most one edge per point, from the smallest of its component there.
    """
    spark = prints.sparkSession
    prints = prints.select(F.col(col).alias("fp")).where("fp is not null")
    n = prints.count()
    masks, bound = part_masks(parts), radius // parts
    leaves = 1
    while leaves < MAX_SHARDS and leaves * shard_rows < n:
        leaves *= 2
    # By hash, so the same whatever the partitions; about SAMPLE_A_SHARD a shard, fewer than twice as many.
    step = max(1, n // (leaves * SAMPLE_A_SHARD))
    points = np.sort(_unsigned([r[0] for r in prints.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).collect()]))
    sent = spark.sparkContext.broadcast(
        [Tree(points, m, bound, leaves) if len(points) else None for m in masks])

    def deal(frames):
        trees = sent.value
        for pdf in frames:
            own = _unsigned(pdf["fp"].to_numpy())
            for part, tree in enumerate(trees):
                idx, leaf = tree.route(own)
                yield pd.DataFrame({"part": np.int32(part), "leaf": leaf, "fp": own[idx].view(np.int64)})

    routed = stage(prints.mapInPandas(deal, "part int, leaf int, fp long"), "shards")
    sizes = routed.groupBy("part", "leaf").count().where(F.col("count") > MAX_SHARD_ROWS)
    # A large shard: rows of blocks i and j meet in task (i, j); a row goes to all pairs of its block.
    blocks = F.ceil(F.col("count") / F.lit(MAX_SHARD_ROWS // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    large = (routed.join(F.broadcast(sizes.withColumn("blocks", blocks).drop("count")), ["part", "leaf"])
             .withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("part", "leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"))
    small = (routed.join(F.broadcast(sizes), ["part", "leaf"], "left_anti")
             .select("part", "leaf", F.lit(-1).alias("i"), F.lit(-1).alias("j"), "fp"))

    def link(key, pdf):
        part = int(key[0])
        own = np.unique(_unsigned(pdf["fp"].to_numpy()))
        rest = tuple(m for k, m in enumerate(masks) if k != part)
        a, b = links(own, masks[part], bound, radius, rest)
        label = _settle(len(own), a, b)
        moved = np.flatnonzero(label != np.arange(len(own)))
        return pd.DataFrame({"a": own[label[moved]].view(np.int64), "b": own[moved].view(np.int64)})

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return small.union(large).groupBy("part", "leaf", "i", "j").applyInPandas(link, schema)

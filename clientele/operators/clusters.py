"""K-means customer clusters and the elbow table.

All starts and all numbers of clusters advance together: a round is one pass over the table that
assigns each point in every model and sums the points of every centre. A task returns one row per
centre, whatever its rows are; the driver holds only the centres.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from clientele.operators.features import minmax_scale
from clientele.session import stage

METRICS = ("recency", "frequency", "monetary")


def scaled_features(rfm: DataFrame, columns: Sequence[str] = METRICS) -> DataFrame:
    """The columns scaled to 0…1 as one vector; a stage, because every iteration reads it."""
    rfm = stage(rfm, "rfm")
    scaled = minmax_scale(rfm, columns, suffix="_scaled")
    names = [f"{c}_scaled" for c in columns]
    made = VectorAssembler(inputCols=names, outputCol="features").transform(scaled).drop(*names)
    return stage(made.repartition(_tasks(rfm, rfm.count())), "clusters")


#: Points, about, that first centres are drawn from; they are chosen by hash and only shape the start.
START_ROWS = 4_000
TOLERANCE = 1e-4
#: Points, about, that make a task of a round worth its start.
ROUND_ROWS = 20_000


@dataclass(frozen=True)
class Clusters:
    centres: np.ndarray
    cost: float
    rounds: int


def _first_centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is drawn with the squared distance to the nearest one so far."""
    chosen = [points[rng.integers(len(points))]]
    near = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        at = rng.choice(len(points), p=near / total) if total > 0 else rng.integers(len(points))
        chosen.append(points[at])
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _pass(data: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(points per centre, sums of points per centre, cost) of each model, in one pass over ``data``.

    ``data`` has a double column per coordinate and nothing else.
    """
    d = next(iter(models.values())).shape[1]
    keys = sorted(models)
    bounds = np.cumsum([0, *[len(models[m]) for m in keys]])
    shared = data.sparkSession.sparkContext.broadcast(np.concatenate([models[m] for m in keys]))
    sums = [f"s{i}" for i in range(d)]

    def run(batches):
        every = shared.value
        squares = (every * every).sum(axis=1)
        n, total, cost = np.zeros(len(every)), np.zeros((len(every), d)), np.zeros(len(every))
        for batch in batches:
            whole = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for first in range(0, len(whole), 8192):
                x = whole[first:first + 8192]
                gap = squares - 2.0 * (x @ every.T)
                own = (x * x).sum(axis=1)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    at = gap[:, a:b].argmin(axis=1)
                    n[a:b] += np.bincount(at, minlength=b - a)
                    for i in range(d):
                        total[a:b, i] += np.bincount(at, x[:, i], b - a)
                    cost[a:b] += np.bincount(at, np.maximum(gap[np.arange(len(x)), a + at] + own, 0.0), b - a)
        columns = [np.arange(len(every), dtype=np.int32), n, *total.T, cost]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["centre", "n", *sums, "cost"])

    made = data.mapInArrow(run, "centre int, n double, " + ", ".join(f"{c} double" for c in sums) + ", cost double")
    rows = made.groupBy("centre").agg(*[F.sum(c).alias(c) for c in ("n", *sums, "cost")]).toPandas().sort_values("centre")
    n, total, cost = rows["n"].to_numpy(), rows[sums].to_numpy(), rows["cost"].to_numpy()
    shared.unpersist()
    return {m: (n[a:b], total[a:b], float(cost[a:b].sum())) for m, a, b in zip(keys, bounds[:-1], bounds[1:])}


def _tasks(df: DataFrame, rows: int) -> int:
    return max(1, min(-(-rows // ROUND_ROWS), 4 * df.sparkSession.sparkContext.defaultParallelism))


def _coordinates(data: DataFrame, rows: int, d: int) -> DataFrame:
    """A double column per coordinate, written in enough files that every core works in every round."""
    x = vector_to_array("features")
    return stage(data.select(*[x[i].alias(f"x{i}") for i in range(d)]).repartition(_tasks(data, rows)), "points")


def fit_clusters(data: DataFrame, ks: Sequence[int], starts: int = 10, max_iter: int = 300,
                 seed: int = 10) -> dict[int, Clusters]:
    """For each k the model with the lowest cost of several starts, all advanced together.

    ``data`` has the vector ``features``. A model rests once no centre moves more than TOLERANCE; a
    centre that loses its points stays where it is. The cost belongs to the centres returned.
    """
    rows = data.count()
    if not rows:
        raise ValueError("no points to cluster")
    mark = F.xxhash64("features").bitwiseAND(F.lit((1 << 53) - 1))
    share = min(1.0, START_ROWS / rows)
    some = data if share == 1.0 else data.where(mark < F.lit(int(share * (1 << 53))))
    drawn = some.select(vector_to_array("features").alias("x")).toPandas()["x"]
    if not len(drawn):  # all rows are copies of a few points that the hash left out
        drawn = data.select(vector_to_array("features").alias("x")).limit(1).toPandas()["x"]
    points = np.array(sorted(map(tuple, drawn)))
    runs = [(k, s) for k in ks for s in range(starts)]
    data = _coordinates(data, rows, points.shape[1])
    centres = {i: _first_centres(points, k, np.random.default_rng([seed, k, s])) for i, (k, s) in enumerate(runs)}
    moving, done = dict(centres), {}
    for step in range(1, max_iter + 2):
        for i, (n, total, cost) in _pass(data, moving).items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[i])
            rest = np.abs(new - centres[i]).max() <= TOLERANCE
            if rest or step > max_iter:
                done[i] = Clusters(centres[i], cost, step)
            centres[i] = new
        moving = {i: centres[i] for i in moving if i not in done}
        if not moving:
            break
    best: dict[int, Clusters] = {}
    for i, (k, _) in enumerate(runs):
        if k not in best or done[i].cost < best[k].cost:
            best[k] = done[i]
    return best


def assign(data: DataFrame, centres: np.ndarray, out: str = "cluster_no") -> DataFrame:
    """``data`` with the number of the nearest centre, the first one among equals."""
    x = vector_to_array("features")
    gaps = []
    for i, c in enumerate(centres.tolist()):
        gap = F.lit(0.0)
        for j, v in enumerate(c):
            gap = gap + (x[j] - F.lit(v)) * (x[j] - F.lit(v))
        gaps.append(F.struct(gap.alias("gap"), F.lit(i).alias("i")))
    return data.withColumn(out, F.array_min(F.array(*gaps))["i"])


def cluster_customers(rfm: DataFrame, k: int = 4, starts: int = 10,
                      columns: Sequence[str] = METRICS) -> DataFrame:
    data = scaled_features(rfm, columns)
    return assign(data, fit_clusters(data, [k], starts)[k].centres).drop("features")


def cluster_profile(clustered: DataFrame, columns: Sequence[str] = METRICS) -> DataFrame:
    return clustered.groupBy("cluster_no").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])


def elbow(rfm: DataFrame, most: int = 10, starts: int = 10,
          columns: Sequence[str] = METRICS) -> DataFrame:
    """(k, wcss) for k = 1…most; one cluster is the spread around the mean, a plain aggregate."""
    data = scaled_features(rfm, columns)
    x = vector_to_array("features")
    spread = data.agg(*[F.var_pop(x[i]).alias(f"v{i}") for i in range(len(columns))],
                      F.count("*").alias("n")).first()
    rows = [(1, float(spread["n"] * sum(spread[f"v{i}"] for i in range(len(columns)))))]
    if most > 1:
        rows += [(k, m.cost) for k, m in fit_clusters(data, range(2, most + 1), starts).items()]
    return rfm.sparkSession.createDataFrame(rows, "k long, wcss double")

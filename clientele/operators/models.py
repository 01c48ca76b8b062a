"""Churn classifiers on pyspark.ml: fitting, cross-validation, grid search, importance, voting."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from clientele.operators import all_row_fits, fit_search
from clientele.operators.features import slice_features
from clientele.operators.fit_search import Run
from clientele.operators.lifetime import minimise
from clientele.operators.metrics import class_metrics, soft_vote
from clientele.operators.neighbours import vote_of_nearest
from clientele.session import staged

Scorer = Callable[[DataFrame], DataFrame]  # adds the column "prob"
SEED = 10
IMPORTANCE_FLOOR = 1.0
# Labelled rows up to which every task holds the whole nearest-neighbour model.
KNN_ROWS = 100_000
# Projected values up to which the kernel machine keeps them all, and rows that a task projects at a time.
PROJECTED = 32_000_000
STEP_ROWS = 1_000
# Rows a partition has at least when a learner of Spark is fitted, and rows up to which the folds are fitted together.
PART_ROWS = 20_000
TOGETHER_ROWS = 1_000_000


@dataclass(frozen=True)
class Fitted:
    score: Scorer
    importances: np.ndarray | None = None


@dataclass(frozen=True)
class Learner:
    """A classifier by name; ``params`` override its defaults."""

    name: str
    fit: Callable[..., Fitted]
    params: dict = field(default_factory=dict)
    members: tuple[Learner, ...] = ()

    def with_params(self, **params) -> Learner:
        return replace(self, params={**self.params, **params})

    def __call__(self, train: DataFrame) -> Fitted:
        return self.fit(train, **self.params)


def _probability(model) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn("prob", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction")
    return score


def _tree_model(estimator) -> Callable[[DataFrame], Fitted]:
    def fit(train: DataFrame) -> Fitted:
        model = estimator.fit(train)
        return Fitted(_probability(model), model.featureImportances.toArray())
    return fit


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 100) -> Fitted:
    n = train.count()
    return Fitted(_probability(LogisticRegression(
        regParam=1.0 / (max(n, 1) * c), maxIter=max_iter, standardization=False).fit(train)))


def fit_cart(train: DataFrame, max_depth: int = 10, min_rows: int = 2) -> Fitted:
    return _tree_model(DecisionTreeClassifier(
        maxDepth=max_depth, minInstancesPerNode=min_rows, seed=SEED))(train)


def fit_forest(train: DataFrame, trees: int = 100, max_depth: int = 10, min_rows: int = 1,
               features: str = "sqrt") -> Fitted:
    return _tree_model(RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_rows,
        featureSubsetStrategy=str(features), seed=SEED))(train)


def fit_boosted(train: DataFrame, rounds: int = 100, rate: float = 0.1, max_depth: int = 3,
                features: str = "all", rows: float = 1.0, min_rows: int = 1) -> Fitted:
    return _tree_model(GBTClassifier(
        maxIter=rounds, stepSize=rate, maxDepth=max_depth, featureSubsetStrategy=str(features),
        subsamplingRate=rows, minInstancesPerNode=min_rows, seed=SEED))(train)


def fit_kernel_svm(train: DataFrame, components: int = 200, gamma: float | None = None,
                   reg: float = 1e-4, max_iter: int = 50) -> Fitted:
    """RBF-kernel machine through random Fourier features (Rahimi & Recht 2007) and a linear SVM.

    ``gamma`` defaults to 1 / (number of features · variance of all feature values). More than ``PROJECTED``
    values are not kept but projected again for each step.
    """
    d = len(train.first()["features"])
    if gamma is None:
        x = F.explode(vector_to_array("features")).alias("x")
        variance = train.select(x).agg(F.var_pop("x")).first()[0]
        gamma = 1.0 / (d * variance) if variance else 1.0 / d
    rng = np.random.default_rng(SEED)
    w = rng.normal(scale=math.sqrt(2.0 * gamma), size=(d, components))
    b = rng.uniform(0.0, 2.0 * math.pi, components)
    if train.count() * components > PROJECTED:
        return _fit_projected(train, w, b, reg, max_iter)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        z = np.cos(np.vstack(x.to_numpy()) @ w + b) * math.sqrt(2.0 / components)
        return pd.Series(list(z))

    def projected(df: DataFrame) -> DataFrame:
        return df.withColumn("_rff", array_to_vector(project(vector_to_array("features"))))

    model = LinearSVC(featuresCol="_rff", regParam=reg, maxIter=max_iter,
                      standardization=False).fit(projected(train))

    def score(df: DataFrame) -> DataFrame:
        margin = vector_to_array("rawPrediction")[1]
        return (model.transform(projected(df))
                .withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
                .drop("_rff", "rawPrediction", "prediction"))
    return Fitted(score)


def _fit_projected(train: DataFrame, w: np.ndarray, b: np.ndarray, reg: float, max_iter: int) -> Fitted:
    """The linear machine on projected rows: mean hinge loss + reg / 2 · squared weights, whose sums are a job a step."""
    components = len(b)

    def project(x: np.ndarray) -> np.ndarray:
        return np.cos((x @ w + b).astype(np.float32)) * np.float32(math.sqrt(2.0 / components))

    def pack(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "label": [batch.column(1).to_numpy().astype(float).tobytes()]})

    rows = (train.select(vector_to_array("features"), F.col("label").cast("double")).mapInArrow(pack, "x binary, label binary")
            .rdd.map(lambda r: (np.frombuffer(r[0]).reshape(-1, len(w)), np.frombuffer(r[1])))
            .persist(StorageLevel.MEMORY_AND_DISK))

    def evaluate(at: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(blocks):
            total = np.zeros(components + 3)  # gradient of the weights, of the constant, loss, rows
            for x, y in ((x[i:i + STEP_ROWS], y[i:i + STEP_ROWS]) for x, y in blocks for i in range(0, len(y), STEP_ROWS)):
                z, side = project(x), np.where(y > 0.5, 1.0, -1.0)
                short = 1.0 - side * (z @ at[:-1].astype(np.float32) + at[-1])
                active = short > 0
                pull = np.where(active, -side, 0.0)
                total[:components] += pull.astype(np.float32) @ z
                total[components:] += pull.sum(), short[active].sum(), len(y)
            yield total

        parts = rows.mapPartitions(sums)
        own = parts.treeReduce(np.add) if parts.getNumPartitions() > 64 else parts.reduce(np.add)
        n, weights = own[-1], at[:-1]
        return (own[-2] / n + reg / 2.0 * float(weights @ weights),
                own[:-2] / n + np.append(reg * weights, 0.0))

    try:
        found, _ = minimise(evaluate, np.zeros(components + 1), max_steps=max_iter)
    finally:
        rows.unpersist()

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        out = [project(np.vstack(x.iloc[i:i + STEP_ROWS].to_numpy())).astype(float) @ found[:-1] + found[-1]
               for i in range(0, len(x), STEP_ROWS)]
        return pd.Series(1.0 / (1.0 + np.exp(-np.concatenate(out))) if out else np.zeros(0))

    return Fitted(lambda df: df.withColumn("prob", probability(vector_to_array("features"))))


def fit_knn(train: DataFrame, k: int = 5, fit_rows: int | None = None) -> Fitted:
    """Share of the label among the ``k`` nearest training rows.

    All training rows are the model, unless a trial run asks for about ``fit_rows`` of them, chosen by hash. Up to
    ``KNN_ROWS`` go to every task, and rows are scored against all of them in blocks of bounded size; more are dealt
    into cells (``neighbours``). Ties in distance go to the earlier rows of the hash's order.
    """
    x, n = vector_to_array("features"), train.count()
    kept = train.select(x.alias("x"), "label").withColumn("h", F.xxhash64("x", "label"))
    if fit_rows:
        kept = kept.where(F.pmod(F.col("h"), F.lit(max(1, n // fit_rows))) == 0)
    if n > KNN_ROWS and not fit_rows:
        def far(df: DataFrame) -> DataFrame:
            rows = df.withColumn("_x", vector_to_array("features"))
            return rows.join(vote_of_nearest(kept, rows.select(F.col("_x").alias("x")), k).withColumnRenamed("x", "_x"),
                             "_x", "left").drop("_x")
        return Fitted(far)
    kept = kept.orderBy("h").collect()
    points = np.array([r["x"] for r in kept])
    labels = np.array([float(r["label"]) for r in kept])
    near = min(k, len(kept))
    squares = (points * points).sum(axis=1) if len(kept) else None
    model = train.sparkSession.sparkContext.broadcast((points, labels, squares))

    @F.pandas_udf("double")
    def share(rows: pd.Series) -> pd.Series:
        points, labels, squares = model.value
        out = np.full(len(rows), np.nan)
        for at in range(0, len(rows), 256):
            z = np.vstack(rows.iloc[at:at + 256].to_numpy())
            gap = squares - 2.0 * z @ points.T  # the row's own square shifts all alike
            edge = np.partition(gap, near - 1, axis=1)[:, near - 1:near]
            inside = gap <= edge
            share = np.where(inside, labels, 0.0).sum(axis=1) / near
            tied = np.flatnonzero(inside.sum(axis=1) > near)  # further rows at the last distance
            share[tied] = labels[np.argsort(gap[tied], axis=1, kind="stable")[:, :near]].mean(axis=1)
            out[at:at + 256] = share
        return pd.Series(out)

    if not near:
        return Fitted(lambda df: df.withColumn("prob", F.lit(None).cast("double")))
    return Fitted(lambda df: df.withColumn("prob", share(vector_to_array("features"))))


def fit_adaboost(train: DataFrame, rounds: int = 50) -> Fitted:
    """AdaBoost (SAMME) over depth-1 trees.

    A stump is a comparison, so the weights of every round are one expression over the cached
    features: nothing is chained from round to round and no lineage builds up.
    """
    x = vector_to_array("features")
    data = train.withColumn("_x", x).persist()
    stumps: list[tuple[float, int, float, float, float]] = []

    def vote(i: int, cut: float, low: float, high: float) -> Column:
        return F.when(F.col("_x")[i] <= F.lit(cut), F.lit(low)).otherwise(F.lit(high))

    def total(term: Callable[..., Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(s[0]) * term(*s[1:]) for s in stumps], F.lit(0.0))

    try:
        for _ in range(rounds):
            miss = lambda *s: (vote(*s) != F.col("label")).cast("double")
            weighted = data.withColumn("_w", F.exp(total(miss)))
            model = DecisionTreeClassifier(maxDepth=1, weightCol="_w", seed=SEED).fit(weighted)
            root = model._java_obj.rootNode()
            if model.numNodes > 1:
                split = root.split()
                stump = (split.featureIndex(), split.threshold(), root.leftChild().prediction(),
                         root.rightChild().prediction())
            else:  # both sides vote alike: a constant, which still shifts the weights
                stump = (0, math.inf, root.prediction(), root.prediction())
            wrong, whole = weighted.agg(F.sum(F.col("_w") * miss(*stump)), F.sum("_w")).first()
            error = min(max(wrong / whole, 1e-10), 1.0 - 1e-10)
            if error >= 0.5:
                break
            stumps.append((math.log((1.0 - error) / error), *stump))
            if error <= 1e-10:
                break
    finally:
        data.unpersist()

    def score(df: DataFrame) -> DataFrame:
        margin = total(lambda *s: F.lit(2.0) * vote(*s) - F.lit(1.0))
        return (df.withColumn("_x", x)
                .withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).drop("_x"))
    return Fitted(score)


LOGISTIC = Learner("LR", fit_logistic)
KERNEL_SVM = Learner("SVC", fit_kernel_svm)
CART = Learner("CART", fit_cart)
KNN = Learner("KNN", fit_knn)
FOREST = Learner("RF", fit_forest)
ADABOOST = Learner("Adaboost", fit_adaboost)
GBM = Learner("GBM", fit_boosted)
# Boosting presets in place of native libraries that Spark does not ship: usual defaults of each.
XGB = Learner("XGBoost", fit_boosted, {"rate": 0.3, "max_depth": 6})
LGBM = Learner("LightGBM", fit_boosted, {"rate": 0.1, "max_depth": 5})
CATBOOST = Learner("CatBoost", fit_boosted, {"rate": 0.03, "max_depth": 6, "rounds": 200})
LEARNERS = (LOGISTIC, KNN, KERNEL_SVM, CART, FOREST, ADABOOST, GBM, XGB, LGBM, CATBOOST)

# The parameter grids to search.
GRIDS = {
    "CART": {"max_depth": [12, 14], "min_rows": [5, 10, 15]},
    "XGBoost": {"rate": [0.1, 0.001], "rounds": [100, 1000], "features": ["0.5", "0.7", "1.0"]},
    "LightGBM": {"rate": [0.01, 0.1], "rounds": [500, 750], "features": ["0.5", "0.7"]},
    "RF": {"features": ["7", "auto"], "min_rows": [8, 15], "trees": [500, 750]},
    "CatBoost": {"rounds": [200, 500], "rate": [0.01, 0.1], "max_depth": [3, 6]},
}


def cross_validate(df: DataFrame, learner: Learner, folds: Sequence[int], fold: str = "fold",
                   parallelism: int = 5) -> DataFrame:
    """Metrics per fold; each row is scored by the model that did not see its fold, but all the others."""
    n = df.count()
    known = df.coalesce(-(-n // PART_ROWS) or 1)

    def one(f: int) -> DataFrame:
        fitted = learner(known.where(F.col(fold) != f))
        return fitted.score(df.where(F.col(fold) == f)).select(fold, "label", "prob")

    # Large fits use all cores by themselves, and what they keep should not be there five times.
    pool = ThreadPool(min(parallelism, len(folds)) if n <= TOGETHER_ROWS else 1)
    try:
        scored = reduce(DataFrame.unionByName, pool.map(
            inheritable_thread_target(df.sparkSession)(one), folds))
    finally:
        pool.close()
    return class_metrics(scored, "label", "prob", fold, folds)


def _runs(learners: Sequence[Learner]) -> list[Run]:
    return [Run(m.name, tuple(m.params.items())) for m in learners]


def _is_grown(learner: Learner) -> bool:
    """Whether ``fit_search`` grows this learner's trees with all of its parameters."""
    return learner.name in fit_search.PRESETS and set(learner.params) <= set(fit_search.PRESETS[learner.name])


def _is_tree(learner: Learner) -> bool:
    """Whether ``fit_search`` fits this learner, or all members of the vote."""
    return learner.name in fit_search.PRESETS or bool(learner.members) and all(_is_grown(v) for v in learner.members)


def compare_models(df: DataFrame, learners: Sequence[Learner], folds: Sequence[int]) -> DataFrame:
    """(model, fold, metrics) for every learner; ``df`` has features, label and fold.

    Every fit sees all rows of the other folds. The fits of all tree learners and folds run side by side
    (``fit_search``), those of a vote of trees as well, the others one by one.
    """
    df = staged(df, "folds")
    data = all_row_fits.fit_data(df) if any(_is_tree(m) for m in learners) else None
    trees = [m for m in learners if m.name in fit_search.PRESETS]
    votes = [m for m in learners if _is_tree(m) and m not in trees]
    tables = [cross_validate(df, m, folds).withColumn("model", F.lit(m.name)) for m in learners if not _is_tree(m)]
    for m in votes:
        rated = fit_search.rated_vote(df, _runs(m.members), folds, data)
        tables.append(rated.withColumn("model", F.lit(m.name)).drop("run", "n_rows"))
    if trees:
        rated = fit_search.rated_runs(df, _runs(trees), folds, data)
        names = F.array(*[F.lit(m.name) for m in trees])
        tables.append(rated.withColumn("model", names[F.col("run")]).drop("run", "n_rows"))
    return reduce(DataFrame.unionByName, tables)


def tune(df: DataFrame, searches: dict[str, dict[str, list]], folds: Sequence[int], metric: str = "auc") -> DataFrame:
    """(model, params, n_rows, mean metrics, is_default, best) of tree learners, before and after tuning.

    Every combination of each grid and the learner with its defaults is cross-validated; all fits run
    side by side on all rows of the other folds, and values of the axis of steps share one fit. ``best`` marks the combination with
    the highest ``metric``, the first one among equals.
    """
    df = staged(df, "folds")
    runs: list[Run] = []
    for model, axes in searches.items():
        runs += [Run(model), *fit_search.grid(model, axes)]
    rated = fit_search.rated_runs(df, runs, folds, all_row_fits.fit_data(df))
    means = rated.groupBy("run").agg(F.sum("n_rows").alias("n_rows"), *[
        F.avg(m).alias(m) for m in ("auc", "accuracy", "f1", "precision", "recall")])
    rows = {r["run"]: r for r in means.collect()}  # a row per combination
    tried = {m: [i for i, r in enumerate(runs) if r.model == m and r.params] for m in searches}
    best = {max(own, key=lambda i: (rows[i][metric] is not None, rows[i][metric] or 0.0, -i)) for own in tried.values() if own}
    names = ("auc", "accuracy", "f1", "precision", "recall")
    return df.sparkSession.createDataFrame(
        [(r.model, r.text(), rows[i]["n_rows"], *[rows[i][m] for m in names], not r.params, i in best)
         for i, r in enumerate(runs)],
        "model string, params string, n_rows long, " + ", ".join(f"{m} double" for m in names)
        + ", is_default boolean, best boolean")


def grid_search(df: DataFrame, learner: Learner, grid: dict[str, list], folds: Sequence[int],
                metric: str = "auc") -> tuple[Learner, DataFrame]:
    """The learner with the best mean metric, and the score of every combination."""
    combinations = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    tried = [learner.with_params(**c) for c in combinations]
    if learner.name in fit_search.PRESETS:
        df = staged(df, "folds")
        rated = fit_search.rated_runs(df, _runs(tried), folds, all_row_fits.fit_data(df))
        found = rated.groupBy("run").agg(F.avg(metric).alias("s")).collect()
        scores = [r["s"] for r in sorted(found, key=lambda r: r["run"])]
    else:
        df = staged(df, "folds")
        scores = [cross_validate(df, m, folds).agg(F.avg(metric)).first()[0] for m in tried]
    best = max(range(len(tried)), key=lambda i: (scores[i] is not None, scores[i], -i))
    table = df.sparkSession.createDataFrame(
        [(learner.name, str(c), scores[i], i == best) for i, c in enumerate(combinations)],
        "model string, params string, score double, best boolean")
    return tried[best], table


def importance_rows(df: DataFrame, learners: Sequence[Learner], names: Sequence[str],
                    folds: Sequence[int]) -> DataFrame:
    """(model, auc, feature, importance) of tree learners; ``auc`` is the mean over folds."""
    df = staged(df, "folds")
    data, runs = all_row_fits.fit_data(df), _runs(learners)
    scores = fit_search.rated_runs(df, runs, folds, data)
    auc = {r["run"]: r["auc"] for r in scores.groupBy("run").agg(F.avg("auc").alias("auc")).collect()}
    rows = [(m.name, auc[i], n, float(w)) for i, (m, own) in enumerate(zip(
        learners, fit_search.importances(df, runs, len(names), data))) for n, w in zip(names, own)]
    return df.sparkSession.createDataFrame(
        rows, "model string, auc double, feature string, importance double")


def compare_selected(df: DataFrame, learners: Sequence[Learner], selected: Sequence[str],
                     folds: Sequence[int]) -> DataFrame:
    """``compare_models`` on all features and on the ``selected`` ones; (features, n_features, …)."""
    df = staged(df, "folds")
    few = slice_features(df, selected)
    sizes = [len(d.first()["features"]) for d in (df, few)]
    return reduce(DataFrame.unionByName, [
        compare_models(d, learners, folds).withColumns({"features": F.lit(kind), "n_features": F.lit(n)})
        for kind, d, n in zip(("all", "selected"), (df, few), sizes)])


def hybrid_importance(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Importance weighted by AUC, scaled to 0…1 per model, averaged over the models in percent."""
    weighted = rows.withColumn("weighted", 100.0 * F.col("auc") * F.col("importance"))
    wide = weighted.groupBy("feature").pivot("model", list(models)).agg(F.avg("weighted"))
    bounds = wide.agg(*[f(F.col(f"`{m}`")).alias(f"{n}_{i}") for i, m in enumerate(models)
                        for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = wide.select("feature", *[
        ((F.col(f"`{m}`") - F.lit(bounds[f"lo_{i}"]))
         / F.lit((bounds[f"hi_{i}"] - bounds[f"lo_{i}"]) or 1.0)).alias(m)
        for i, m in enumerate(models) if bounds[f"lo_{i}"] is not None])
    present = [m for m in scaled.columns if m != "feature"]
    mean = reduce(lambda a, b: a + b, [F.col(f"`{m}`") for m in present]) / F.lit(float(len(present)))
    return scaled.withColumn("avg_importance", mean * 100.0)


def select_features(importance: DataFrame, at_least: float = IMPORTANCE_FLOOR) -> list[str]:
    """Names of the features whose average importance reaches the floor."""
    return [r[0] for r in importance.where(F.col("avg_importance") >= at_least)
            .select("feature").orderBy("feature").collect()]


def vote_scorer(fitted: Sequence[Fitted]) -> Scorer:
    """Soft voting over fitted models: each scores the same frame in turn, then the mean."""
    def score(df: DataFrame) -> DataFrame:
        names = []
        for i, f in enumerate(fitted):
            df = f.score(df).withColumnRenamed("prob", f"_p{i}")
            names.append(f"_p{i}")
        return soft_vote(df, names).drop(*names)
    return score


def voting(learners: Sequence[Learner]) -> Learner:
    """Soft voting; boosting and forests are fitted together on all rows (``all_row_fits``), others one by one."""
    def fit(train: DataFrame) -> Fitted:
        if not all(_is_grown(m) and fit_search.PRESETS[m.name]["kind"] in ("boost", "forest") for m in learners):
            return Fitted(vote_scorer([m(train) for m in learners]))
        prob = all_row_fits.fit_vote(train, _runs(learners))
        return Fitted(lambda df: soft_vote(df.withColumn("_p", prob), ["_p"]).drop("_p"))
    return Learner("Voting", fit, members=tuple(learners))

"""From order lines to scored churn: features, noise, encoding, ensemble, probability bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clientele.operators import features, models, profiling, sampling
from clientele.operators.customers import churn_lines
from clientele.operators.metrics import score_rows
from clientele.session import scratch, stage

# Identifiers and raw texts or times never become features.
NOT_FEATURES = ("customer_id", "order_id", "product_id", "line_number", "invoice", "order_ts",
                "ship_ts", "city", "churn")
ALWAYS_NUMERIC = ("tax_ratio",)
# Columns that stay beside the features.
KEPT = ("customer_id", "order_id", "line_number", "value")


def churn_frame(lines: DataFrame, noise: Sequence[tuple[int, float, int | None]] = (),
                seed: int = 10) -> DataFrame:
    """Order lines with customer features, churn label, place segment and optional label noise.

    Only the written result stays; the steps before it are deleted.
    """
    def made() -> DataFrame:
        with scratch(lines.sparkSession):
            return stage(features.with_city_segment(churn_lines(stage(lines, "lines"))), "churn", outlive=True)

    if not noise:
        return made()
    with scratch(lines.sparkSession):
        return stage(sampling.label_noise(made(), noise, seed), "noisy", outlive=True)


def model_rows(lines: DataFrame, noise: Sequence[tuple[int, float, int | None]] = (),
               drop: Sequence[str] = features.LEAKING) -> tuple[DataFrame, list[str]]:
    """``model_frame`` of ``churn_frame``, of which only the former stays."""
    with scratch(lines.sparkSession):
        return model_frame(churn_frame(lines, noise), drop, outlive=True)


def model_frame(frame: DataFrame, drop: Sequence[str] = features.LEAKING,
                keep: Sequence[str] = KEPT, outlive: bool = False
                ) -> tuple[DataFrame, list[str]]:
    """Encode and scale what remains after ``drop`` and assemble it; also the feature names."""
    kept = {k: f"_keep_{k}" for k in keep}
    usable = [c for c in frame.columns if c not in (*NOT_FEATURES, *drop)]
    base = frame.select(*usable, F.col("churn"), *[F.col(k).alias(v) for k, v in kept.items()])
    roles = profiling.column_roles(base.select(*usable))
    categories = [c for c in roles["categorical"] if c not in ALWAYS_NUMERIC]
    numbers = [c for c in usable if c in roles["numeric"] or c in ALWAYS_NUMERIC]
    encoded = features.dummies(base, categories) if categories else base
    scaled = features.robust_scale(encoded, numbers)
    names = numbers + [c for c in scaled.columns
                       if c not in (*numbers, "churn", *kept.values(), *roles["cardinal"])]
    out = features.assemble(scaled, names, "churn", keep=list(kept.values()))
    return stage(out.withColumnsRenamed({v: k for k, v in kept.items()}), "model", outlive), names


def kept_folds(folded: DataFrame) -> DataFrame:
    """Rows with their folds as a table that outlives the frame they were made from."""
    return stage(folded, "folds", outlive=True)


def train_and_score(data: DataFrame, learner: models.Learner, test_size: float = 0.3,
                    group: str | None = None, seed: int = 10) -> DataFrame:
    """Fit on the training side, score every row, and mark the side it was on.

    ``group`` keeps the rows of a customer on one side; without it the split is by row.
    """
    key = [group] if group else [c for c in data.columns if c != "features"]
    marked = sampling.hash_split(data, test_size, seed, key)
    fitted = learner(marked.where("not is_test").select("features", "label"))
    return stage(score_rows(fitted.score(marked)).drop("features"), "scored")

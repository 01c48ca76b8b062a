"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A target of r times the source's words gives every document
floor(r) certain copies; what is left is a fixed-size sample of the source. A document's inclusion
odds grow a little with its length; it is ranked by random odds divided by inclusion odds, and the
sample is the start of that order up to the words that are left. The cut is found by counting words
in 2^10 slices of the order, then in 2^10 slices of the slice that holds it, so no source is ever
sorted in one task. The gap that remains, less than one document, goes to a few of the other
documents: three times the largest that fits, then the one nearest to what is left if that makes it
smaller.

The decision is a row per source: documents are compared with their source's cut where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.llm.common import fresh, ordered_totals, stage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 1729
_FILLS = 3
_SLICES = 10  # bits of each of the two slicings


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _draw(docs_id: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """A uniform number in (0, 1) and a tie-breaker, from the row's id and text."""
    mark = F.xxhash64(docs_id, F.coalesce(text, F.lit("")))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), mark), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return uniform, mark


def _place(uniform: Column, size: Column) -> Column:
    """Random odds over inclusion odds, as a number between 0 and 1.

    Inclusion is f (1 + (1 - f) t), with t between -1 and 1 the centred logarithm of the size: the
    expected words stay f times the source's.
    """
    tilt = F.when(F.col("spread") > 0, (_log(size) - F.col("middle")) / F.col("spread")).otherwise(F.lit(0.0))
    p = F.col("part") * (1 + (1 - F.col("part")) * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tilt)))
    odds = (uniform / (1 - uniform)) * ((1 - p) / p)
    return F.when(p >= 1, F.lit(0.0)).otherwise(odds / (1 + odds))


def _log(size: Column) -> Column:
    return F.round(F.log1p(size.cast("double")) * 1e6).cast("long")  # whole numbers add up exactly


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source, total) with ``target``: weights in turn by code point, null last.

    The weights share the sum of all totals. A target stops at ``max_copies`` times its source,
    and the excess goes to the others by weight until none is above: sources are capped in order of
    max_copies * total / weight, so the cut is a prefix of that order.
    """
    ranked = ordered_totals(sources, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1).cast("long")},
                            "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("weight", weight).withColumn("cap", F.col("total") * float(max_copies))
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    run = ordered_totals(ranked, [F.col("ratio"), F.col("rank")], {
        "cap_before": F.col("cap"), "weight_before": F.col("weight")}, "caps")
    words, weight = run.agg(F.sum("total").cast("double"), F.sum("weight")).first()
    run = run.withColumn("level", (F.lit(words) - F.col("cap_before")) / (F.lit(weight) - F.col("weight_before")))
    fill = run.where("ratio > level").agg(F.min(F.struct("ratio", "rank", "level"))["level"]).first()[0]
    target = F.col("cap") if fill is None else F.least(F.col("cap"), F.lit(fill) * F.col("weight"))
    return run.select("source", "total", "weight", "low", "high", "moment", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """A row per source: its words, target, certain copies and the cut of its order."""
    uniform, mark = _draw(F.col(id_col), F.col(text_col), seed)
    sized = stage(docs.select(F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"),
                              uniform.alias("uniform"), mark.alias("mark")), "sized")
    log = _log(F.col("size"))
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("total"), F.min(log).alias("low"), F.max(log).alias("high"),
        F.sum(F.col("size").cast("decimal(38,0)") * log).alias("moment"))
    ratio = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    middle = F.when(F.col("total") > 0, F.col("moment").cast("double") / F.col("total")).otherwise(F.lit(0.0))
    aims = stage(targets(sources, weights, max_copies).withColumns({
        "copies": F.floor(ratio).cast("long"), "part": ratio - F.floor(ratio), "middle": middle,
        "need": F.col("target") - F.floor(ratio) * F.col("total"),
    }).withColumn("spread", F.greatest(F.col("high") - F.col("middle"), F.col("middle") - F.col("low")))
        .drop("low", "high", "moment"), "aims")

    aim = aims.where("need > 0 and part > 0").select(F.col("source").alias("s"), "part", "middle", "spread", "need")
    rows = (sized.where("size > 0").join(aim, F.col("source").eqNullSafe(F.col("s")))
            .select("s", "need", "size", "mark", _place(F.col("uniform"), F.col("size")).alias("place")))
    rows = stage(rows, "places")

    def crossing(rows: DataFrame, bits: int, need: Column) -> DataFrame:
        slices = rows.groupBy("s", F.floor(F.col("place") * float(1 << bits)).alias("slice")).agg(
            F.sum("size").alias("words"), F.max(need).alias("need"))
        so_far = F.coalesce(F.sum("words").over(
            Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (slices.withColumn("before", so_far).where("before <= need and need < before + words")
                .select(F.col("s").alias("cs"), F.col("slice").alias("at"), (F.col("need") - F.col("before")).alias("rest")))

    def inside(rows: DataFrame, cut: DataFrame, bits: int) -> DataFrame:
        mine = F.floor(F.col("place") * float(1 << bits))
        return (rows.join(cut, F.col("s").eqNullSafe(F.col("cs")) & (mine == F.col("at")))
                .select("s", "size", "mark", "place", F.col("rest").alias("need")))

    one = stage(crossing(rows, _SLICES, F.col("need")), "slices")
    within = stage(inside(rows, one, _SLICES), "within")
    two = stage(crossing(within, 2 * _SLICES, F.col("need")), "slices")
    last = (inside(within, two, 2 * _SLICES).groupBy("s", "place", "mark")
            .agg(F.sum("size").alias("words"), F.max("need").alias("need")))
    running = F.sum("words").over(Window.partitionBy("s").orderBy("place", "mark"))
    taken = last.withColumn("upto", running).where("upto <= need").groupBy("s").agg(
        F.max(F.struct("place", "mark")).alias("last"))
    edge = two.select(F.col("cs").alias("s"), (F.col("at") / float(1 << 2 * _SLICES)).alias("edge"))
    cut = stage(edge.join(taken.withColumnRenamed("s", "ts"), F.col("s").eqNullSafe(F.col("ts")), "left").select(
        F.col("s").alias("cut_source"), F.coalesce(F.col("last.place"), F.col("edge")).alias("cut_place"),
        F.coalesce(F.col("last.mark"), F.lit(-(1 << 63)).cast("long")).alias("cut_mark")), "cut")

    # Sources without a cut need all their words once more.
    marked = rows.join(cut, F.col("s").eqNullSafe(F.col("cut_source")), "left")
    got = marked.groupBy("s").agg(F.sum(F.when(_before_cut(F.col("place"), F.col("mark")), F.col("size"))
                                        .otherwise(F.lit(0))).alias("got"))
    got = got.withColumnRenamed("s", "gs")
    open_ = stage(marked.where(~_before_cut(F.col("place"), F.col("mark"))).select("s", "size", "place", "mark"), "open")
    state = stage(marked.groupBy("s").agg(F.max("need").alias("need")).join(got, F.col("s").eqNullSafe(F.col("gs")))
                  .select(F.col("gs").alias("fill_source"), (F.col("need") - F.col("got")).alias("gap"),
                          F.array().cast("array<bigint>").alias("tried"),
                          F.array().cast("array<bigint>").alias("fill")), "gaps")
    for last_round in [False] * _FILLS + [True]:
        near = open_.join(state, F.col("s").eqNullSafe(F.col("fill_source"))).where(
            ~F.array_contains("tried", F.col("mark")))
        off = F.abs(F.col("gap") - F.col("size"))
        near = near.where(off < F.col("gap") if last_round else F.col("size") <= F.col("gap"))
        one = near.groupBy("s").agg(F.min(F.struct(off.alias("off"), "place", "mark"))["mark"].alias("one"))
        # Rows that repeat id and text come together: what counts is their sum.
        whole = (open_.join(one.withColumnRenamed("s", "one_source"),
                            F.col("s").eqNullSafe(F.col("one_source")) & (F.col("mark") == F.col("one")))
                 .groupBy("one_source", "one").agg(F.sum("size").alias("words")))
        fits = F.coalesce(F.abs(F.col("gap") - F.col("words")) < F.col("gap"), F.lit(False))
        state = stage(state.join(whole, F.col("fill_source").eqNullSafe(F.col("one_source")), "left").select(
            "fill_source", F.when(fits, F.col("gap") - F.col("words")).otherwise(F.col("gap")).alias("gap"),
            F.when(F.col("one").isNull(), F.col("tried")).otherwise(F.array_append("tried", F.col("one"))).alias("tried"),
            F.when(fits, F.array_append("fill", F.col("one"))).otherwise(F.col("fill")).alias("fill")), "gaps")
    return stage(
        aims.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .join(state, F.col("source").eqNullSafe(F.col("fill_source")), "left")
        .select(F.col("source").alias("p_source"), "total", "target", "copies", "part", "middle", "spread", "need",
                "cut_place", "cut_mark", "fill"), "plan")


def _before_cut(place: Column, mark: Column) -> Column:
    cut = F.col("cut_place")
    return cut.isNull() | (place < cut) | ((place == cut) & (mark <= F.col("cut_mark")))


def allocate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: int = SEED, **options) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target, copies and taken; also the names of these columns.

    Null and empty texts have size 0 and are not taken; null sources are one source; rows that
    repeat id and text share their draw, so all or none are sampled. No rows give no rows. The
    result depends on ids, texts and the seed only, not on the partitions.
    """
    planned = plan(docs, id_col, text_col, source_col, seed=seed, **options)
    names = {c: fresh(f"mix_{c}", docs.columns) for c in ("size", "source_size", "target", "copies", "taken")}
    row = fresh("_row", docs.columns)
    uniform, mark = _draw(F.col(id_col), F.col(text_col), seed)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(row), F.col(source_col).alias("d_source"),
                         _size(F.col(text_col)).alias("size"), uniform.alias("uniform"), mark.alias("mark"))
    joined = packed.join(planned, F.col("d_source").eqNullSafe(F.col("p_source")))
    place = _place(F.col("uniform"), F.col("size"))
    sampled = (F.col("size") > 0) & (F.col("need") > 0) & (F.col("part") > 0) & (
        _before_cut(place, F.col("mark")) | F.coalesce(F.array_contains("fill", F.col("mark")), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("copies") + sampled.cast("long")).otherwise(F.lit(0).cast("long"))
    out = joined.withColumn("n", copies).select(
        f"{row}.*", F.col("size").alias(names["size"]), F.col("total").alias(names["source_size"]),
        F.col("target").alias(names["target"]), F.col("n").alias(names["copies"]),
        (F.col("n") * F.col("size")).alias(names["taken"]))
    return out, names


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, columns as in ``docs``."""
    out, names = allocate(docs, **options)
    again = fresh("_again", out.columns)
    times = F.sequence(F.lit(1).cast("long"), F.col(names["copies"]))
    return out.where(F.col(names["copies"]) > 0).withColumn(again, F.explode(times)).select(*docs.columns)

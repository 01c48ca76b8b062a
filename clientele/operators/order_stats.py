"""Exact order statistics over whole columns: quantiles, equal-frequency bins and ranks.

The built-in exact ``percentile`` keeps every distinct value of the column in one task, and a
global ``row_number`` moves the table into one task. Neither works on a large table, so:

* ``select_positions`` narrows an interval around each wanted position with approximate
  quantiles and exact counts until the interval is small enough for one task. The approximation
  only chooses where to cut; every count is exact, so the result is exact whatever its error.
* ``range_split`` cuts a table into ordered pieces for rank and running-total work, by the value and
  then by a second column, so a frequent value fills several pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from clientele.functions.scalars import col, interpolate
from clientele.session import stage

# Distinct values one task sorts in the last step of a selection. Small, because narrowing by
# counting is cheaper than moving values.
SELECT_ROWS = 50_000
# Rows one ordered piece may have.
TASK_ROWS = 2_000_000


@dataclass(frozen=True)
class OrderStat:
    """The value at a position, with the number of smaller and of equal values."""

    value: object
    less: int
    equal: int


@dataclass(frozen=True)
class _Span:
    """Values strictly between ``lo`` and ``hi`` (None is open), ``before`` of them smaller."""

    lo: object
    hi: object
    before: int
    count: int


def _is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _inside(x: Column, span: _Span) -> Column:
    keep = x.isNotNull()
    if span.lo is not None:
        keep = keep & (x > F.lit(span.lo))
    if span.hi is not None:
        keep = keep & (x < F.lit(span.hi))
    return keep


def _normalised(df: DataFrame, cols: dict[str, Column]) -> tuple[DataFrame, dict[str, bool]]:
    """Project the requested columns as LONG or DOUBLE, NaN as NULL."""
    narrow = df.select(*[c.alias(n) for n, c in cols.items()])
    integral = {f.name: _is_integral(f.dataType) for f in narrow.schema}
    out = []
    for n, is_int in integral.items():
        v = F.col(f"`{n}`")
        d = v.cast("double")
        out.append((v.cast("long") if is_int else F.when(~F.isnan(d), d)).alias(n))
    return narrow.select(*out), integral


def select_positions(
    df: DataFrame,
    cols: dict[str, str | Column],
    wanted: Callable[[str, int], Iterable[int]],
    task_rows: int = SELECT_ROWS,
    sizes: dict[str, int] | None = None,
) -> tuple[dict[str, int], dict[str, dict[int, OrderStat]]]:
    """Values at 1-based positions of the sorted non-null values of several columns.

    ``wanted(name, n)`` returns the positions for a column with ``n`` values; ``sizes`` gives the
    n where they are known. Returns them and, per column, position to ``OrderStat``. All columns share the same passes; the
    driver receives one row per position.
    """
    names = list(cols)
    safe = {n: f"c{i}" for i, n in enumerate(names)}
    data, integral = _normalised(df, {safe[n]: col(cols[n]) for n in names})
    x = {n: F.col(safe[n]) for n in names}

    n_values = dict(sizes or {})
    if any(n not in n_values for n in names):
        totals = data.agg(*[F.count(x[n]).alias(safe[n]) for n in names]).first()
        n_values = {n: totals[safe[n]] for n in names}
    open_spans: dict[tuple[str, _Span], set[int]] = {}
    for n in names:
        want = {p for p in wanted(n, n_values[n]) if 1 <= p <= n_values[n]}
        if want:
            open_spans[n, _Span(None, None, 0, n_values[n])] = want

    found: dict[str, dict[int, OrderStat]] = {n: {} for n in names}
    while any(s.count > task_rows for _, s in open_spans):
        open_spans = _narrow(data, x, open_spans, found, task_rows)
    if open_spans:
        _finish(data, x, {n: integral[safe[n]] for n in names}, open_spans, found)
    return n_values, found


def _narrow(data, x, spans, found, task_rows):
    """One round: bracket every wanted position and count exactly around the brackets."""
    accuracy = 20_000
    keep = {k: v for k, v in spans.items() if k[1].count <= task_rows}
    large = [(n, s, sorted(ps)) for (n, s), ps in spans.items() if s.count > task_rows]

    slack = 2.0 / accuracy
    exprs = []
    for i, (n, s, ps) in enumerate(large):
        probs = []
        for p in ps:
            at = (p - s.before) / s.count
            probs += [max(0.0, at - slack), min(1.0, at + slack)]
        value = F.when(_inside(x[n], s), x[n])
        exprs += [F.percentile_approx(value, probs, accuracy).alias(f"e{i}"),
                  F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    edges_row = data.agg(*exprs).first()

    exprs, cuts = [], []
    for i, (n, s, ps) in enumerate(large):
        edges = sorted(_edges(edges_row[f"e{i}"], edges_row[f"lo{i}"], edges_row[f"hi{i}"]))
        cuts.append(edges)
        inside = _inside(x[n], s)
        for j, e in enumerate(edges):
            exprs.append(F.count_if(inside & (x[n] < F.lit(e))).alias(f"l{i}_{j}"))
            exprs.append(F.count_if(inside & (x[n] == F.lit(e))).alias(f"q{i}_{j}"))
    counts = data.agg(*exprs).first()

    out = dict(keep)
    for i, (n, s, ps) in enumerate(large):
        pieces = []  # alternating open gaps and single values, in order
        lo, start = s.lo, 0
        for j, e in enumerate(cuts[i]):
            less, equal = counts[f"l{i}_{j}"], counts[f"q{i}_{j}"]
            pieces.append(_Span(lo, e, s.before + start, less - start))
            pieces.append(OrderStat(e, s.before + less, equal))
            lo, start = e, less + equal
        pieces.append(_Span(lo, s.hi, s.before + start, s.count - start))
        for p in ps:
            for piece in pieces:
                if isinstance(piece, OrderStat):
                    if piece.less < p <= piece.less + piece.equal:
                        found[n][p] = piece
                elif piece.before < p <= piece.before + piece.count:
                    out.setdefault((n, piece), set()).add(p)
    return out


def _edges(sketch, lo, hi) -> set:
    """Where to cut a span: at the sketch's values, which are values of the column.

    The sketch computes in doubles, so a LONG beyond 2^53 comes back rounded, perhaps outside the
    span. Such a span is also cut at both ends and in its middle: it halves in every round.
    """
    if isinstance(lo, int) and max(abs(lo), abs(hi)) >= 1 << 53:
        return {e for e in map(int, sketch) if lo <= e <= hi} | {lo, hi, (lo + hi) // 2}
    return set(sketch)


def _finish(data, x, integral, spans, found):
    """Rank the distinct values of the remaining small spans and pick the positions."""
    keyed = list(spans.items())
    entries = []
    for i, ((n, s), _) in enumerate(keyed):
        as_long = x[n] if integral[n] else F.lit(None).cast("long")
        as_double = F.lit(None).cast("double") if integral[n] else x[n]
        entries.append(F.when(_inside(x[n], s), F.struct(
            F.lit(i).alias("span"), as_long.alias("i"), as_double.alias("d"))))
    values = (data.select(F.explode(F.array_compact(F.array(*entries))).alias("v"))
              .select("v.*").groupBy("span", "i", "d").agg(F.count("*").alias("n")))
    running = Window.partitionBy("span").orderBy("i", "d").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("upto", F.sum("n").over(running))

    pick = None
    for i, ((_, s), ps) in enumerate(keyed):
        local = F.array(*[F.lit(p - s.before).cast("long") for p in sorted(ps)])
        pick = (F if pick is None else pick).when(F.col("span") == i, local)
    hit = ranked.withColumn("want", pick).where(F.exists(
        "want", lambda p: (p > F.col("upto") - F.col("n")) & (p <= F.col("upto"))))
    for row in hit.select("span", "i", "d", "n", "upto").collect():
        (n, s), ps = keyed[row["span"]]
        value = row["i"] if integral[n] else row["d"]
        stat = OrderStat(value, s.before + row["upto"] - row["n"], row["n"])
        for p in ps:
            if stat.less < p <= stat.less + stat.equal:
                found[n][p] = stat


# --- quantiles -------------------------------------------------------------------------------

def quantile_positions(n: int, probs: Sequence[float]) -> list[int]:
    """The positions that quantiles of n values lie between."""
    heights = [(n - 1) * p + 1 for p in probs]
    return [f(h) for h in heights for f in (math.floor, math.ceil)]


def quantiles_at(n: int, stats: dict[int, OrderStat], probs: Sequence[float]) -> list[float | None]:
    """Quantiles by linear interpolation between the selected values."""
    out = []
    for p in probs:
        h = (n - 1) * p + 1
        lo = math.floor(h)
        out.append(interpolate(float(stats[lo].value), float(stats[math.ceil(h)].value), h - lo)
                   if n else None)
    return out


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[str | Column, Sequence[float]]],
    task_rows: int = SELECT_ROWS,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, NULL and NaN skipped; None for an empty column.

    ``wanted`` maps a result name to (column, probabilities). Like ``approxQuantile`` this runs
    when called and returns plain numbers, so callers can use them as literals.
    """
    n_values, found = select_positions(
        df, {k: c for k, (c, _) in wanted.items()},
        lambda name, n: quantile_positions(n, wanted[name][1]), task_rows)
    return {k: quantiles_at(n_values[k], found[k], probs) for k, (_, probs) in wanted.items()}


def edge_probs(q: int) -> list[float]:
    return [i / q for i in range(q + 1)]


def unique_edges(name: str, edges: Sequence[float | None], duplicates: str = "raise") -> list[float]:
    """Sorted bin edges. Equal edges make a bin empty: an error unless ``duplicates="drop"``."""
    unique = sorted({e for e in edges if e is not None})
    if unique and len(unique) < len(edges) and duplicates != "drop":
        raise ValueError(f"bin edges of {name} are not unique: {edges}")
    return unique


def quantile_edges(df: DataFrame, wanted: dict[str, tuple[str | Column, int]],
                   duplicates: str = "raise",
                   task_rows: int = SELECT_ROWS) -> dict[str, list[float]]:
    """Edges of ``q`` equal-frequency bins, minimum and maximum included."""
    got = exact_quantiles(df, {k: (c, edge_probs(q)) for k, (c, q) in wanted.items()}, task_rows)
    return {name: unique_edges(name, edges, duplicates) for name, edges in got.items()}


def bin_of(value: str | Column, edges: Sequence[float]) -> Column:
    """Bin 1, 2, … of a value: right-closed bins, the lowest value in bin 1, NULL stays NULL."""
    v = col(value).cast("double")
    if not edges:  # no values at all
        return F.lit(None).cast("long")
    number = F.lit(1).cast("long")
    for e in edges[1:-1]:
        number = number + (v > F.lit(float(e))).cast("long")
    outside = (v < F.lit(float(edges[0]))) | (v > F.lit(float(edges[-1]))) | F.isnan(v)
    return F.when(v.isNotNull() & ~outside, number)


def qcut(df: DataFrame, value: str, q: int, out: str, labels: Sequence | None = None,
         duplicates: str = "raise", task_rows: int = SELECT_ROWS) -> DataFrame:
    """Equal-frequency bins of a column, as numbers 1…q or as the given labels."""
    edges = quantile_edges(df, {value: (value, q)}, duplicates, task_rows)[value]
    number = bin_of(value, edges)
    return df.withColumn(out, number if labels is None else label_of(number, labels))


def label_of(number: Column, labels: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number.cast("int"))


# --- ordinal rank ----------------------------------------------------------------------------

def cut_positions(n: int, q: int) -> list[int]:
    """The last rank in each of the first q−1 equal-frequency bins of the ranks 1…n."""
    return [math.floor(1 + (n - 1) * k / q) for k in range(1, q)] if n else []


def rank_cuts(df: DataFrame, value: str, key: str, q: int, task_rows: int = SELECT_ROWS,
              selected: tuple[int, dict[int, OrderStat]] | None = None
              ) -> list[tuple[object, object]]:
    """The last (value, key) of each of the first q−1 equal-frequency bins of the ordinal rank.

    The rank orders by value and breaks ties by key. Binning it needs no rank per row: the
    boundary pairs are enough, and they are q−1 selections. ``selected`` passes the row count and
    the values at the cut positions when the caller has selected them already.
    """
    paired = df.where(F.col(value).isNotNull())
    if selected is None:
        n_values, found = select_positions(
            paired, {"v": value}, lambda _, n: cut_positions(n, q), task_rows)
        selected = n_values["v"], found["v"]
    n, at = selected
    wanted = cut_positions(n, q)
    ties: dict[object, list[int]] = {}
    for p in wanted:
        ties.setdefault(at[p].value, []).append(p - at[p].less)
    names = {f"k{i}": v for i, v in enumerate(ties)}
    sizes = {k: next(at[p].equal for p in wanted if at[p].value == v) for k, v in names.items()}
    _, keys = select_positions(
        paired, {k: F.when(F.col(value) == F.lit(v), F.col(key)) for k, v in names.items()},
        lambda name, _: ties[names[name]], task_rows, sizes)
    by_value = {v: keys[k] for k, v in names.items()}
    return [(at[p].value, by_value[at[p].value][p - at[p].less].value) for p in wanted]


def rank_bin(value: str, key: str, cuts: Sequence[tuple[object, object]]) -> Column:
    """Bin 1…q of the ordinal rank from its boundary pairs."""
    v, k = F.col(value), F.col(key)
    number = F.lit(1).cast("long")
    for cv, ck in cuts:
        after = (v > F.lit(cv)) | ((v == F.lit(cv)) & (k > F.lit(ck)))
        number = number + after.cast("long")
    return F.when(v.isNotNull(), number)


def range_split(df: DataFrame, value: str, key: str | None = None,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``_piece``: ordered pieces of about equal size, written once so that they stay as they are.

    The pieces are ranges of (value, key), found and compared in the columns' own types: a value that
    would fill several pieces is cut at quantiles of the key among its own rows. Rows that agree in
    both share a piece. Rows with a NULL value are dropped.
    """
    df = df.where(F.col(value).isNotNull())
    pieces = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / task_rows))
    ranged = df.repartitionByRange(pieces, *[F.col(c).asc_nulls_first() for c in (value, key) if c])
    return stage(ranged.withColumn("_piece", F.spark_partition_id()), "ranged")


def _running_offsets(split: DataFrame, weights: Sequence[Column],
                     names: Sequence[str]) -> DataFrame:
    """Totals of all earlier pieces, per piece: a row each, so one task can run over them."""
    sums = split.groupBy("_piece").agg(*[F.sum(w).alias(n) for w, n in zip(weights, names)])
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_piece", *[
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names])


def rank_first(df: DataFrame, value: str, key: str, out: str,
               task_rows: int = TASK_ROWS) -> DataFrame:
    """Ordinal rank 1…n by value, ties by key, over the whole table without a single task."""
    split = range_split(df, value, key, task_rows)
    offsets = _running_offsets(split, [F.lit(1)], ["n"])
    inside = Window.partitionBy("_piece").orderBy(value, key)
    return (split.withColumn("_row", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_piece")  # a row per piece
            .withColumn(out, (F.col("_off_n") + F.col("_row")).cast("long"))
            .drop("_piece", "_row", "_off_n"))


def running_totals(df: DataFrame, value: str, weights: Sequence[str],
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """For a table with one row per distinct value: totals over all smaller values.

    Adds ``below_<weight>`` for each weight column.
    """
    split = range_split(df, value, None, task_rows)
    offsets = _running_offsets(split, [F.col(w) for w in weights], weights)
    earlier = Window.partitionBy("_piece").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    with_rows = split.withColumns({
        f"_here_{w}": F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w in weights})
    return (with_rows.join(F.broadcast(offsets), "_piece")
            .withColumns({f"below_{w}": F.col(f"_here_{w}") + F.col(f"_off_{w}")
                          for w in weights})
            .drop("_piece", *[f"_here_{w}" for w in weights],
                  *[f"_off_{w}" for w in weights]))

"""Exact percentiles of whole columns, without gathering their distinct values in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A sketch is off by at most 1 / ACCURACY of all values; a bracket is MARGIN times as wide on either side.
ACCURACY, MARGIN = 10_000, 4
#: Values up to which all of a column are counted in one aggregate.
WHOLE = 1 << 20


def quantiles(df: DataFrame, columns: Mapping[str, Column], points: Sequence[float], accuracy: int = ACCURACY, whole: int = WHOLE, count: int | None = None) -> DataFrame:
    """One row, with an array of the points' percentiles for each named column (linear between ranks).

    Up to `whole` values (count says how many there are at most, else they are counted) come from
    one aggregate. Beyond, a sketch brackets each point, one aggregate counts what lies below each
    bracket, and only values inside, about 2 * MARGIN / accuracy of the column a point, become
    rows, equal ones merged; the same again within a bracket while it holds more than `whole`
    different values. Nulls are no values; NaN counts as infinite. Without values the array holds nulls.
    """
    names = [*columns]
    values = df.select(*(F.when(F.isnan(x.cast("double")), float("inf")).otherwise(x.cast("double")).alias(c) for c, x in columns.items()))
    if count is None:
        count = max(values.agg(*map(F.count, names)).first())
    if count <= whole:
        return values.agg(*(_or_nulls(F.percentile(c, F.array(*map(F.lit, points))), points).alias(c) for c in names))
    brackets = [(c, p, -math.inf, math.inf) for c in names for p in points]
    found: dict[tuple[str, float], float | None] = {}
    while brackets:
        brackets = _narrowed(values, brackets, accuracy, whole, found)
    made = [F.array(*(F.lit(found[c, p]).cast("double") for p in points)).alias(c) for c in names]
    return df.sparkSession.range(1).select(*made)


def _or_nulls(q: Column, points: Sequence[float]) -> Column:
    return F.coalesce(q, F.array(*(F.lit(None).cast("double") for _ in points)))


Bracket = tuple[str, float, float, float]


def _narrowed(values: DataFrame, brackets: list[Bracket], accuracy: int, whole: int, found: dict[tuple[str, float], float | None]) -> list[Bracket]:
    """Narrower brackets (column, point, least, greatest value), and into `found` the points whose values are settled."""
    inside = [F.col(c).between(low, high) for c, _, low, high in brackets]
    counts = [f for (c, _, low, _), own in zip(brackets, inside, strict=True) for f in (F.count(c), F.count_if(F.col(c) < low), F.count_if(own))]
    first = values.agg(*(f.alias(f"c{i}") for i, f in enumerate(counts))).first()
    sketched, margin = [], MARGIN / accuracy
    for k, ((c, p, _, _), own) in enumerate(zip(brackets, inside, strict=True)):
        n, below, held = first[3 * k : 3 * k + 3]
        at = (p * (n - 1) - below) / max(held - 1, 1)
        wide = margin + 2 / max(held - 1, 1)  # of few values at least the neighbours
        ends = [min(max(e, 0.0), 1.0) for e in (at - wide, at + wide)]
        sketched.append(F.percentile_approx(F.when(own, F.col(c)), F.array(*map(F.lit, ends)), accuracy).alias(f"s{k}"))
    ends = values.agg(*sketched).first()
    tried = [(c, p, *(e or (low, high))) for (c, p, low, high), e in zip(brackets, ends, strict=True)]
    checked = values.agg(*(f.alias(f"{n}{k}") for k, (c, _, low, high) in enumerate(tried) for n, f in (("b", F.count_if(F.col(c) < low)), ("i", F.approx_count_distinct(F.when(F.col(c).between(low, high), F.col(c))))))).first()

    settled, going = [], []
    for k, bracket in enumerate(tried):
        c, p, low, high = bracket
        if not first[3 * k]:
            found[c, p] = None
        elif checked[f"i{k}"] > whole and (low, high) != brackets[k][2:]:
            going.append(bracket)
        else:
            settled.append((k, bracket, p * (first[3 * k] - 1) - checked[f"b{k}"]))
    if settled:
        cells = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col(c).between(low, high), F.col(c)).alias("x")) for k, (c, _, low, high), _ in settled))
        rows = values.select(F.inline(F.filter(cells, lambda s: s["x"].isNotNull()))).groupBy("k", "x").agg(F.count("*").alias("n"))
        ranks = F.element_at(F.create_map(*(F.lit(v) for k, _, at in settled for v in (k, float(at)))), F.col("k"))
        end = F.sum("n").over(Window.partitionBy("k").orderBy("x"))
        rows = rows.withColumns({"end": end, "rank": ranks}).withColumn("start", F.col("end") - F.col("n"))
        at = lambda r: F.min(F.when((r >= F.col("start")) & (r < F.col("end")), F.col("x")))
        for r in rows.groupBy("k").agg(_between(F.first("rank"), at(F.floor("rank")), at(F.ceil("rank"))).alias("value")).collect():  # a row a bracket
            found[tried[r.k][0], tried[r.k][1]] = r.value
    return going


def _between(rank: Column, low: Column, high: Column) -> Column:
    unknown = rank.isNotNull() & (low.isNull() | high.isNull())
    mixed = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
    outside = F.raise_error(F.lit("a percentile lies outside its bracket: take a larger accuracy")).cast("double")
    return F.when(unknown, outside).when(low == high, low).otherwise(mixed)

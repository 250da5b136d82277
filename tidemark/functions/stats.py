"""Statistics of samples: exact aggregates in Spark, and the closed forms that work on their few results."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import _placed, running_totals

EPSILON = 1e-6


def zero_rate(c: str) -> Column:
    """A-08: the share of zeros among values that are not null; NaN is no zero."""
    return F.avg(F.when(F.col(c) == 0, 1.0).when(F.col(c).isNotNull(), 0.0))


def quantile(c: str | Column, q: float | Sequence[float]) -> Column:
    """A-10: exact, with linear interpolation."""
    return F.percentile(F.col(c) if isinstance(c, str) else c, list(q) if not isinstance(q, float | int) else q)


def quantiles(df: DataFrame, values: Mapping[str, Column], points: Sequence[float], few: int = 1_000_000) -> dict[str, list[float] | None]:
    """A-10: exact quantiles of several columns, with linear interpolation, nulls left out; None without values.

    Spark's own aggregate holds all distinct values of a column in one task, so it is used only where an estimate shows at most `few` of
    them. Beyond that, values are counted, range-partitioned and numbered by running totals, and only the rows at the wanted ranks are
    read. Both ways give the same numbers.
    """
    names, points = list(values), list(points)
    if not names:
        return {}
    rows = df.select(*(values[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)))
    columns = rows.columns
    if max(rows.agg(*(F.approx_count_distinct(c) for c in columns)).first()) <= few:
        return dict(zip(names, rows.agg(*(F.percentile(c, points) for c in columns)).first(), strict=True))
    per = rows.unpivot([], columns, "name", "value").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    placed = _placed(per, [F.col("name"), F.col("value")])
    totals = placed.groupBy("name", "_part").agg(F.sum("n").alias("t"))
    starts = totals.select("name", "_part", F.coalesce(F.sum("t").over(Window.partitionBy("name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    sizes = {r["name"]: r["n"] for r in totals.groupBy("name").agg(F.sum("t").alias("n")).collect()}  # one row for each column
    wanted = sorted({(c, k) for c, n in sizes.items() for q in points for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    if not wanted:
        return dict.fromkeys(names)
    at = df.sparkSession.createDataFrame(wanted, "name string, rank long")  # two ranks for each point
    last = placed.withColumn("last", F.sum("n").over(Window.partitionBy("name", "_part").orderBy("_place"))).join(F.broadcast(starts), ["name", "_part"]).select("name", "value", (F.col("last") + F.col("s")).alias("last"), "n")
    found = {(r["name"], r["rank"]): r["value"] for r in last.join(F.broadcast(at), "name").filter("rank >= last - n and rank < last").collect()}

    def between(c: str, q: float) -> float:
        p = q * (sizes[c] - 1)
        low, high = math.floor(p), math.ceil(p)
        return found[c, low] if low == high else (high - p) * found[c, low] + (p - low) * found[c, high]

    return {n: [between(c, q) for q in points] if c in sizes else None for n, c in zip(names, columns, strict=True)}


def rows_per_day(df: DataFrame, timestamp_col: str) -> DataFrame:
    """A-06: day, n for each day from the first to the last, 0 where there is none."""
    per = df.filter(F.col(timestamp_col).isNotNull()).groupBy(F.to_date(timestamp_col).alias("day")).agg(F.count("*").alias("n"))
    days = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sampling_interval(df: DataFrame, timestamp_col: str, order_by: str, max_rows: int = 2000) -> DataFrame:
    """A-07, Q-23: seconds: the most frequent gap, to a tenth of a second, among the first max_rows rows by order_by; ties go to the one
    seen first in time order. No row if there is no gap."""
    some = df.filter(F.col(timestamp_col).isNotNull()).orderBy(order_by).limit(max_rows)
    w = Window.partitionBy(F.lit(0)).orderBy(timestamp_col)  # max_rows rows at most
    us = F.unix_micros(F.col(timestamp_col).cast("timestamp"))
    gaps = some.select(F.round((us - F.lag(us).over(w)) / 1e6, 1).alias("seconds"), F.row_number().over(w).alias("r")).filter("seconds is not null")
    return gaps.groupBy("seconds").agg(F.count("*").alias("n"), F.min("r").alias("r")).orderBy(F.desc("n"), "r").limit(1).select("seconds")


def daypart_medians(df: DataFrame, feature_cols: Sequence[str], timestamp_col: str, tz: str = "Europe/Berlin", work_start: int = 8, work_end: int = 18, weekdays_only: bool = False) -> DataFrame:
    """A-05, Q-14: local date and part of day (night, working) with the median of each feature, NaN left out. Times without zone are
    UTC. Also period (date_part), weekday (Monday: 0) and, as timestamp, noon UTC of the date."""
    local = F.from_utc_timestamp(F.col(timestamp_col).cast("timestamp"), tz)
    part = F.when((F.hour("_local") >= work_start) & (F.hour("_local") < work_end), "working").otherwise("night")
    rows = df.withColumn("_local", local).select(F.to_date("_local").alias("date"), part.alias("daypart"), *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in feature_cols))
    if weekdays_only:
        rows = rows.filter(F.weekday("date") < 5)
    out = rows.groupBy("date", "daypart").agg(*(F.median(c).alias(c) for c in feature_cols))
    return out.withColumns({"weekday": F.weekday("date"), "period": F.concat_ws("_", F.col("date").cast("string"), "daypart"), "timestamp": F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")})


def ks_and_wasserstein(df: DataFrame, value: str, is_reference: str) -> DataFrame:
    """E-06, T-06: ks, wasserstein, n_ref, n_test of two samples in one column, told apart by a boolean; rows that are not finite are
    left out. Null without rows on both sides."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(F.col(value).cast("double").alias("x"), F.when(F.col(is_reference), 1).otherwise(0).alias("a"), F.when(F.col(is_reference), 0).otherwise(1).alias("b"))
    n = rows.agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_test"))
    steps = running_totals(rows, "x", {"ca": "a", "cb": "b"}, following="next")
    both = steps.crossJoin(F.broadcast(n))  # one row of totals
    gap = F.abs(F.col("ca") / F.col("n_ref") - F.col("cb") / F.col("n_test"))
    return both.filter("n_ref > 0 and n_test > 0").agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next") - F.col("x"))).alias("wasserstein"), F.first("n_ref").alias("n_ref"), F.first("n_test").alias("n_test"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """The two-sided p-value of a two-sample statistic: exact by counting lattice paths where both samples have at most 10,000 values, else
    by the limit law."""
    if not n or not m or math.isnan(d):
        return float("nan")
    if max(n, m) <= 10_000:
        bound = round(d * n * m) - 0.5
        j = np.arange(m + 1)
        before = np.zeros(0)  # of each diagonal i + j, the shares of paths that stay inside, by j
        for s in range(n + m + 1):
            low, high = max(0, s - n), min(m, s)
            js = j[low : high + 1]
            here = np.zeros(m + 1)
            if s == 0:
                here[0] = 1.0
            else:
                here[js] = before[js] * (s - js) / s  # the last step came from the first sample
                here[js[js > 0]] += before[js[js > 0] - 1] * js[js > 0] / s
            here[js[np.abs((s - js) * m - js * n) > bound]] = 0.0
            before = here
        return float(min(1.0, max(0.0, 1.0 - before[m])))
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def psi_bins(n_ref: int, most: int = 5, per_bin: int = 5) -> int:
    """T-03."""
    return max(2, min(most, n_ref // per_bin))


def psi(df: DataFrame, value: str, is_reference: str, n_bins: int, eps: float = EPSILON) -> DataFrame:
    """T-04: psi and n_bins of two samples in one column. Bins are the reference's distinct quantiles; the last one includes its upper
    edge, as the outer edges are widened to hold both samples."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(F.col(value).cast("double").alias("x"), F.col(is_reference).alias("r"))
    points = [i / n_bins for i in range(n_bins + 1)]
    edges = sorted(set(quantiles(rows.filter("r"), {"x": F.col("x")}, points)["x"] or []))
    facts = rows.agg(F.count_if("r").alias("n"), F.count_if(~F.col("r")).alias("m")).withColumn("e", F.lit(edges).cast("array<double>"))
    inner = F.slice("e", 2, F.greatest(F.lit(0), F.size("e") - 2))
    bin_of = F.aggregate(inner, F.lit(0), lambda a, b: a + F.when(F.col("x") >= b, 1).otherwise(0))
    counted = rows.crossJoin(F.broadcast(facts)).groupBy(bin_of.alias("bin")).agg(F.count_if("r").alias("cr"), F.count_if(~F.col("r")).alias("cc"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("e").alias("e"))
    all_bins = counted.agg(F.collect_list(F.struct("bin", "cr", "cc")).alias("b"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("e").alias("e"))  # n_bins entries at most
    empty = F.size("e") - 1 - F.size("b")  # bins without any row count eps on both sides, and add nothing
    share = lambda c, n: F.greatest(c / F.greatest(n, F.lit(1)), F.lit(eps))
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + (share(x["cc"], F.col("m")) - share(x["cr"], F.col("n"))) * F.log(share(x["cc"], F.col("m")) / share(x["cr"], F.col("n"))))
    ok = (F.col("n") >= 2) & (F.col("m") >= 2)
    return all_bins.select(F.when(ok, F.when(F.size("e") < 2, 0.0).otherwise(total + F.lit(0.0) * empty)).alias("psi"), F.when(ok, F.size("e") - 1).otherwise(n_bins).alias("n_bins"))


def _finite(df: DataFrame, group: str, value: str, is_reference: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), F.col(is_reference).alias("r"))


def ks_by_group(df: DataFrame, group: str, value: str, is_reference: str) -> DataFrame:
    """T-06: group, ks: as ks_and_wasserstein, for many groups of few rows at once (a window for each group)."""
    per = _finite(df, group, value, is_reference).groupBy("g", "x").agg(F.count_if("r").alias("a"), F.count_if(~F.col("r")).alias("b"))
    w, whole = Window.partitionBy("g").orderBy("x"), Window.partitionBy("g")
    steps = per.select("g", F.sum("a").over(w).alias("ca"), F.sum("b").over(w).alias("cb"), F.sum("a").over(whole).alias("n"), F.sum("b").over(whole).alias("m"))
    return steps.filter("n > 0 and m > 0").groupBy(F.col("g").alias(group)).agg(F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))).alias("ks"))


def psi_by_group(df: DataFrame, group: str, value: str, is_reference: str, most: int = 5, per_bin: int = 5, eps: float = EPSILON) -> DataFrame:
    """T-03, T-04: group, psi, n_bins: as psi, for all groups at once; the number of bins follows from the reference's rows."""
    rows = _finite(df, group, value, is_reference)
    ref = F.when(F.col("r"), F.col("x"))
    wanted = F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("n") / per_bin).cast("int")))
    facts = rows.groupBy("g").agg(F.count_if("r").alias("n"), F.count_if(~F.col("r")).alias("m"), *(F.percentile(ref, [i / b for i in range(b + 1)]).alias(f"q{b}") for b in range(2, most + 1)))
    edges = F.element_at(F.array(*(F.col(f"q{b}") for b in range(2, most + 1))), wanted - 1)
    facts = facts.select("g", "n", "m", wanted.alias("wanted"), F.array_distinct(edges).alias("e"))
    inner = F.slice("e", 2, F.greatest(F.lit(0), F.size("e") - 2))
    bin_of = F.aggregate(inner, F.lit(0), lambda a, b: a + F.when(F.col("x") >= b, 1).otherwise(0))
    counted = rows.join(facts, "g").groupBy("g", bin_of.alias("bin")).agg(F.count_if("r").alias("cr"), F.count_if(~F.col("r")).alias("cc"))
    share = lambda c, n: F.greatest(F.col(c) / F.greatest(F.col(n), F.lit(1)), F.lit(eps))
    part = (share("cc", "m") - share("cr", "n")) * F.log(share("cc", "m") / share("cr", "n"))
    total = counted.join(facts, "g").groupBy("g").agg(F.sum(part).alias("psi"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("e").alias("e"), F.first("wanted").alias("wanted"))
    ok = (F.col("n") >= 2) & (F.col("m") >= 2)
    return total.select(F.col("g").alias(group), F.when(ok, F.when(F.size("e") < 2, 0.0).otherwise(F.col("psi"))).alias("psi"), F.when(ok, F.size("e") - 1).otherwise(F.col("wanted")).alias("n_bins"))


def robust_d(med_ref: Column, med_test: Column, iqr_ref: Column) -> Column:
    """T-05: null if the reference's interquartile range is under 1e-6."""
    return F.when(iqr_ref >= EPSILON, (med_test - med_ref) / iqr_ref)

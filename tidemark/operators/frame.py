"""Projections, filters, aggregations and reshaping of frames. Docstrings name the inventory ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def columns_of(x) -> list[Column]:
    """Names, columns, or one of them, as a list of columns."""
    return [F.col(c) if isinstance(c, str) else c for c in ([x] if isinstance(x, str | Column) else x)]


def field_of(name: str):
    """x -> x.name, for transforms over arrays of structs."""
    return lambda x: x[name]


# Projections


def isin_schema(df: DataFrame, *, column: str) -> bool:
    """F-01."""
    return column in df.columns


def add_zeros(df: DataFrame, *, column: str, dtype: str = "int") -> DataFrame:
    """F-02."""
    return df.withColumn(column, F.lit(0).cast(dtype))


def add_ones(df: DataFrame, *, column: str, dtype: str = "int") -> DataFrame:
    """F-03."""
    return df.withColumn(column, F.lit(1).cast(dtype))


def add_alias_from(df: DataFrame, *, column: str, alias: str) -> DataFrame:
    """F-04."""
    return df.withColumn(alias, F.col(column))


def lists_to_arrays(df: DataFrame, columns, size: int) -> DataFrame:
    """F-05: arrays stay arrays; a row whose array has another size makes the query fail."""
    out = df
    for c in [columns] if isinstance(columns, str) else columns:
        if not df.schema[c].dataType.typeName() == "array":
            raise TypeError(f"{c} is no array")
        ok = F.size(c) == size
        out = out.withColumn(c, F.when(F.col(c).isNull() | ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: an array has another size than {size}")).cast(df.schema[c].dataType)))
    return out


def ordered_features(df: DataFrame, order: Sequence[str], appended: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """F-10: kept columns, then those of the model's order that are there, then the appended ones."""
    have = set(df.columns)
    return df.select(*keep, *(c for c in order if c in have), *(c for c in appended if c in have and c not in order))


def grouped_feature_columns(metrics: Sequence[str], groups: Sequence[str]) -> list[str]:
    """F-11: metric_group for all pairs, group by group."""
    return [f"{m}_{g}" for g in groups for m in metrics]


def feature_group(feature: str, groups: Sequence[str]) -> str:
    """F-12: the first group that the name ends with, or unknown."""
    return next((g for g in groups if feature.endswith(f"_{g}")), "unknown")


# Filters


def filter_datetime_range(df: DataFrame, *, start: str, end: str, dtime_min, dtime_max) -> DataFrame:
    """P-01: intervals that overlap (dtime_min, dtime_max), strictly."""
    return df.filter((F.col(end) > F.lit(dtime_min)) & (F.col(start) < F.lit(dtime_max)))


def filter_group_length(df: DataFrame, *, groupby_col, min_length: int) -> DataFrame:
    """P-02, A-04, Q-05: the keys of groups with that many rows at least; not their rows."""
    keys = columns_of(groupby_col)
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_length).drop("_n")


def rows_of_long_groups(df: DataFrame, *, groupby_col: str, min_length: int) -> DataFrame:
    """J-01: the rows of those groups."""
    return df.join(filter_group_length(df, groupby_col=groupby_col, min_length=min_length), groupby_col, "left_semi")


def exclude_ranges(df: DataFrame, timestamp_col: str, ranges: Sequence[dict]) -> DataFrame:
    """P-03, Q-12: rows outside all ranges {date[, start_time, end_time]}; ends are inclusive, a whole day ends at 23:59:59. Null
    timestamps go if there is any range."""
    t = F.col(timestamp_col)
    conds = [(t < F.lit(f"{r['date']} {r.get('start_time', '00:00:00')}").cast("timestamp_ntz")) | (t > F.lit(f"{r['date']} {r.get('end_time', '23:59:59')}").cast("timestamp_ntz")) for r in ranges]
    return df.filter(reduce(and_, conds)) if conds else df


def split_by_dates(df: DataFrame, start: str, end: str, timestamp_col: str) -> DataFrame:
    """P-04: rows whose date is between start and end, inclusive; of strings, the first ten characters are the date."""
    c = F.col(timestamp_col)
    day = F.to_date(F.substring(c, 1, 10)) if df.schema[timestamp_col].dataType.typeName() == "string" else F.to_date(c)
    return df.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def split_train_test(df: DataFrame, timestamp_col: str, train_end: str, test_start: str, out: str = "split") -> DataFrame:
    """P-05: train up to train_end, test from test_start, validation between, in one column; nulls are in none."""
    if test_start <= train_end:
        raise ValueError("the test has to start after the training ends")
    t, a, b = F.col(timestamp_col), F.lit(train_end).cast("timestamp_ntz"), F.lit(test_start).cast("timestamp_ntz")
    return df.withColumn(out, F.when(t <= a, "train").when(t >= b, "test").when(t.isNotNull(), "validation"))


def above(df: DataFrame, score: str, threshold: float, inclusive: bool = False) -> DataFrame:
    """P-06, Q-26: scores over a threshold; NaN is over none."""
    c = F.col(score)
    return df.filter((c >= threshold if inclusive else c > threshold) & ~F.isnan(c))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """P-10: rows with finite numbers in all columns."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]))


def all_full(df: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """P-09, Q-06: rows whose named arrays all have that size."""
    return df.filter(reduce(and_, [F.size(c) == size for c in columns]))


def without_unmatched(df: DataFrame, ids: str, mark: int = -1) -> DataFrame:
    """P-11: windows without the mark of unmatched lines."""
    return df.filter(~F.array_contains(ids, mark))


def zero_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-13: null and NaN become 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-08, A-16: one row with the number of nulls of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


# Aggregations


def aggregates_to_list(df: DataFrame, groupby_cols, aggregate_cols: Sequence[str], order_by: str, aliases: Sequence[str] | None = None) -> DataFrame:
    """A-01: each group's values as arrays, in the order of order_by; nulls stay in their places."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("_o"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(aggregate_cols)))))
    grouped = df.groupBy(*columns_of(groupby_cols)).agg(rows.alias("_rows"))
    names = aliases or aggregate_cols
    return grouped.select(*columns_of(groupby_cols), *(F.transform("_rows", field_of(f"_{i}")).alias(n) for i, n in enumerate(names)))


def groupby_first(df: DataFrame, *, sort_cols: Sequence[str], groupby_cols, descending: bool = True, tie_break: Sequence[str] = ()) -> DataFrame:
    """A-02: the first row of each group after a sort; nulls come first."""
    order = [F.desc_nulls_first(c) if descending else F.asc_nulls_first(c) for c in sort_cols] + [F.col(c) for c in tie_break]
    w = Window.partitionBy(*columns_of(groupby_cols)).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def longest_interval(df: DataFrame, end: str, start: str, tie_break: str | None = None) -> DataFrame:
    """A-03: of the intervals with a start, the one with the greatest end (of equal ones, the last by tie_break)."""
    key = F.struct(end, *([tie_break] if tie_break else []))
    return df.groupBy(F.col(start).alias("_s")).agg(F.max_by(F.struct("*"), key).alias("_row")).select("_row.*")


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """A-13."""
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def profile(df: DataFrame, column: str) -> DataFrame:
    """A-16: distinct values, nulls, least and greatest of a column, in one row."""
    return df.agg(F.countDistinct(column).alias("n_unique"), F.count_if(F.col(column).isNull()).alias("n_null"), F.min(column).alias("least"), F.max(column).alias("greatest"))


def block_label_summary(df: DataFrame, block: str, label: str, order_by: str, short: int = 10) -> DataFrame:
    """A-14: of each label its blocks, their lines, blocks under `short` lines and the shortest one. A block's label is its first
    line's."""
    per = df.groupBy(block).agg(F.min_by(label, order_by).alias(label), F.count("*").alias("_n"))
    return per.groupBy(label).agg(F.count("*").alias("blocks"), F.sum("_n").alias("lines"), F.count_if(F.col("_n") < short).alias("short_blocks"), F.min("_n").alias("shortest"))


def class_rollup(df: DataFrame, group: str, cls: str, classes: Sequence[str]) -> DataFrame:
    """A-15, O-11, T-09: a column of counts for each class of a fixed list."""
    return df.groupBy(group).agg(*(F.count_if(F.col(cls) == c).alias(c) for c in classes))


def top_counts(df: DataFrame, column: str, n: int = 12, least: int = 0) -> DataFrame:
    """A-21: the n most frequent values of at least `least` (ties: the smaller value)."""
    return value_counts(df.filter(F.col(column) >= least), column).orderBy(F.desc("n"), column).limit(n)


def exploded(df: DataFrame, column: str) -> DataFrame:
    """O-08: one row for each element; an empty array gives one row with null."""
    return df.withColumn(column, F.explode_outer(column))


def union_all(*frames: DataFrame) -> DataFrame:
    """O-09."""
    return reduce(DataFrame.unionByName, frames)


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """O-10: distinct values of both."""
    return a.select(column).intersect(b.select(column))


def only_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """O-10: distinct values of a that b lacks."""
    return a.select(column).distinct().join(b.select(column), column, "left_anti")

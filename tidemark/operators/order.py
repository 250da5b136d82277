"""Row order: Spark frames have none, so positions, gathers and stable sorts take explicit order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frame import columns_of
from tidemark.sources.shared import written


def with_row_index(df: DataFrame, order_by, name: str = "index", offset: int = 0, partition_by=()) -> DataFrame:
    """F-06: a 0-based position in the order of order_by, whole or within partition_by.

    A position in the whole frame needs no single task: rows are range-partitioned and sorted, and written once, so that every later step
    sees the same partitions; they are counted for each partition, and a running sum of the (few) counts is joined back.
    """
    keys = columns_of(order_by)
    if partition_by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*columns_of(partition_by)).orderBy(*keys)) - 1 + F.lit(offset).cast("long"))
    placed = _placed(df, keys)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(_BEFORE()), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_place") + offset).cast("long")).drop("_part", "_place", "_start")


def _placed(df: DataFrame, keys) -> DataFrame:
    """Rows in the order of keys, with their partition (_part) and place in it (_place), as a written table: a range exchange samples
    its input, and two of them need not agree on where a partition ends."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    return written(rows, "placed").withColumns({"_part": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row")


def _BEFORE() -> Window:
    """The rows before one, among one row for each partition."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def gather(df: DataFrame, positions: DataFrame, index: str = "index", position: str = "position") -> DataFrame:
    """F-07: the rows at the given positions (with repeats); positions is a frame with one column of positions."""
    return df.join(positions.select(F.col(position).alias(index)), index)


def stable_sort(df: DataFrame, order_by, tie_break) -> DataFrame:
    """O-01, O-02: a sort whose ties keep the order of tie_break, the column that holds the input order."""
    return df.orderBy(*columns_of(order_by), *columns_of(tie_break))


def first_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    """O-03: the first n rows in an order; each task keeps n rows before they meet."""
    return df.orderBy(*columns_of(order_by)).limit(n)


def distinct_in_order(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """O-05: distinct values with the first order key of each, as first_seen."""
    return df.groupBy(column).agg(F.min(order_by).alias("first_seen"))


def distinct_by(df: DataFrame, subset, order_by) -> DataFrame:
    """O-06: of rows with equal subset, the first in the order."""
    w = Window.partitionBy(*columns_of(subset)).orderBy(*columns_of(order_by))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def hash_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 0, out: str = "split") -> DataFrame:
    """O-12: routes rows to named splits by a hash of their key; rows of a key stay together, whatever the partitioning."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    case, top = None, 0.0
    for name, share in fractions.items():
        top += share
        case = F.when(place < top, name) if case is None else case.when(place < top, name)
    return df.withColumn(out, case.otherwise(list(fractions)[-1]))


def chronological_split(df: DataFrame, order_by: str, cuts: dict[str, float], out: str = "split") -> DataFrame:
    """W-12: splits by the share of rows that come before, in the order of a dense 0-based key: int(share * n) rows end before a cut."""
    n = df.count()
    case = None
    for name, share in cuts.items():
        cond = F.col(order_by) < int(share * n)
        case = F.when(cond, name) if case is None else case.when(cond, name)
    return df.withColumn(out, case.otherwise("rest"))


def running_totals(df: DataFrame, order_by: str, sums: dict[str, str], descending: bool = False, following: str | None = None) -> DataFrame:
    """W-13: of distinct values of order_by, the totals of columns over all values up to each one, as the names in sums; following: the
    name of a column with the next value.

    Values are aggregated first and range-partitioned; each partition sums up its own and adds the total of those before it, which is
    one row for each partition.
    """
    per = df.groupBy(order_by).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    placed = _placed(per, [F.desc(order_by) if descending else F.asc(order_by)])
    w = Window.partitionBy("_part").orderBy("_place")
    local = placed.withColumns({f"_{n}": F.sum(n).over(w) for n in sums} | ({"_own": F.lead(order_by).over(w)} if following else {}))
    heads = placed.groupBy("_part").agg(*(F.sum(n).alias(n) for n in sums), F.min_by(order_by, "_place").alias("_head"))
    starts = heads.select("_part", *(F.coalesce(F.sum(n).over(_BEFORE()), F.lit(0)).alias(f"_s_{n}") for n in sums), F.lead("_head").over(Window.orderBy("_part")).alias("_after"))
    out = local.join(F.broadcast(starts), "_part")
    more = [F.coalesce("_own", "_after").alias(following)] if following else []
    return out.select(order_by, *((F.col(f"_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums), *more)


def list_distinct(df: DataFrame, column: str) -> DataFrame:
    """O-07: each array without repeated elements, in the order in which they first come."""
    return df.withColumn(column, F.array_distinct(column))

"""Time gaps, sessions and sliding windows. All need partition_by: a whole stream in one window goes to one task, so that has to be asked
for by WHOLE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frame import columns_of, field_of

#: Seconds of a unit, as (numerator, denominator).
UNITS = {"h": (3600, 1), "m": (60, 1), "s": (1, 1), "ms": (1, 1000), "us": (1, 10**6), "ns": (1, 10**9)}


def micros(column: str | Column) -> Column:
    """A timestamp (with or without zone, session in UTC) as microseconds since the epoch."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


#: As partition_by: all rows in order, in one task. For frames known to be small.
WHOLE = "*"


def _keys(partition_by) -> list[Column]:
    if isinstance(partition_by, str) and partition_by == WHOLE:
        return []
    if not isinstance(partition_by, Column) and not partition_by:
        raise ValueError("partition_by has to name what a window may not cross; WHOLE puts all rows into one task")
    return columns_of(partition_by)


def _part(partition_by):
    return Window.partitionBy(*(_keys(partition_by) or [F.lit(0)]))


def _spec(partition_by, order_by):
    return _part(partition_by).orderBy(*columns_of(order_by))


def time_delta(df: DataFrame, *, column: str, out_column: str, order_by, partition_by, time_unit: str = "s") -> DataFrame:
    """W-01, Q-02: the gap to the row before, in whole seconds (truncated), in units of h, m, s, ms, us or ns; the first is null."""
    if time_unit not in UNITS:
        raise ValueError(f"unknown unit: {time_unit}")
    up, down = UNITS[time_unit]
    gap = micros(column) - F.lag(micros(column)).over(_spec(partition_by, order_by))
    seconds = F.when(gap >= 0, F.floor(gap / 1_000_000)).otherwise(F.ceil(gap / 1_000_000)).cast("double")
    return df.withColumn(out_column, seconds * down / up)


def gap_groups(df: DataFrame, *, column: str, out_column: str, threshold: float, order_by, partition_by, time_unit: str = "s") -> DataFrame:
    """W-02, Q-03, Q-04: the number of gaps over the threshold so far; a row whose gap is null is in group 0."""
    gaps = time_delta(df, column=column, out_column="_gap", order_by=order_by, partition_by=partition_by, time_unit=time_unit)
    w = _spec(partition_by, order_by).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("_gap") > threshold, 1).otherwise(0)).over(w)
    return gaps.withColumn(out_column, F.when(F.col("_gap").isNull(), 0).otherwise(total).cast("long")).drop("_gap")


def centered_rolling_sum(df: DataFrame, *, column: str, safe_range: int, index_column: str = "date_time", out_column: str = "count", partition_by, timedelta_unit: str = "s", closed: str = "right") -> DataFrame:
    """W-03: the sum over the times within safe_range on both sides; closed names the ends that count: right, left, both or none."""
    up, down = UNITS[timedelta_unit]
    r = safe_range * up * 1_000_000 // down
    low, high = {"right": (1 - r, r), "left": (-r, r - 1), "both": (-r, r), "none": (1 - r, r - 1)}[closed]
    return df.withColumn(out_column, F.sum(column).over(_part(partition_by).orderBy(micros(index_column)).rangeBetween(low, high)))


def forward_windows(df: DataFrame, columns: Sequence[str] | str, window_size: int, *, order_by, partition_by, output: Sequence[str] | None = None, filter_valid_rows: bool = False) -> DataFrame:
    """W-04, W-08: the values of a row and of the window_size - 1 after it; shorter at the end, unless only full ones are kept. Nulls
    keep their places."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    names = output or [f"{c}_sliding_window" for c in columns]
    w = _spec(partition_by, order_by).rowsBetween(0, window_size - 1)
    rows = F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))).over(w)
    out = df.withColumn("_rows", rows)
    if filter_valid_rows:
        out = out.filter(F.size("_rows") == window_size)
    return out.withColumns({n: F.transform("_rows", field_of(f"_{i}")) for i, n in enumerate(names)}).drop("_rows")


def last_row_windows(df: DataFrame, features: Sequence[str], window_size: int, *, timestamp: str, order_by, partition_by, zero_padding: bool = True) -> DataFrame:
    """W-09: full windows over an array of features, as window, with the timestamp of their last row, as window_ts. A partition with
    fewer rows gives one window padded with zeros at its end, or none."""
    vec = F.array(*(F.col(c).cast("double") for c in features))
    w = _spec(partition_by, order_by)
    part = _part(partition_by)
    out = df.withColumns({"_w": F.collect_list(vec).over(w.rowsBetween(0, window_size - 1)), "window_ts": F.last(timestamp).over(w.rowsBetween(0, window_size - 1)), "_n": F.count("*").over(part), "_r": F.row_number().over(w)})
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(features)), F.greatest(F.lit(0), window_size - F.size("_w")))
    short = F.lit(zero_padding) & (F.col("_n") < window_size) & (F.col("_r") == 1)
    return out.filter((F.size("_w") == window_size) | short).withColumn("window", F.concat("_w", pad)).drop("_w", "_n", "_r")


def generate_windows(df: DataFrame, *, column: str, order_by, partition_by, delta_thr: float = 10, sequence_length: int = 2, index: str = "index", force_padding_with_values: bool = False, padding_constant: int = 0) -> DataFrame:
    """W-05, Q-07, Q-10: windows of row positions (column index) within sessions by gaps. Sessions shorter than a window are left out,
    or give one window padded with the constant. Rows: session, first position, window."""
    grouped = gap_groups(df, column=column, out_column="_session", threshold=delta_thr, order_by=order_by, partition_by=partition_by)
    keys = [*_keys(partition_by), F.col("_session")]
    w = Window.partitionBy(*keys).orderBy(*columns_of(order_by))
    rows = grouped.withColumns({"window": F.collect_list(index).over(w.rowsBetween(0, sequence_length - 1)), "_n": F.count("*").over(Window.partitionBy(*keys)), "_r": F.row_number().over(w)})
    full = F.size("window") == sequence_length
    if force_padding_with_values:
        short = (F.col("_n") < sequence_length) & (F.col("_r") == 1)
        rows = rows.filter(full | short).withColumn("window", F.concat("window", F.array_repeat(F.lit(padding_constant).cast("long"), F.greatest(F.lit(0), sequence_length - F.size("window")))))
    else:
        rows = rows.filter(full)
    return rows.select(*_keys(partition_by), F.col("_session").alias("session"), F.col(index).alias("first_position"), "window")


def array_windows(column: str | Column, window_size: int, force_padding_with_values: bool = False, padding_constant: float = 0.0) -> Column:
    """W-06: all windows of an array; of a shorter one none, or one padded at its end."""
    c = F.col(column) if isinstance(column, str) else column
    full = F.transform(F.sequence(F.lit(1), F.size(c) - window_size + 1), lambda i: F.slice(c, i, window_size))
    none = F.slice(F.array(c), 1, 0)
    padded = F.array(F.concat(c, F.array_repeat(F.lit(padding_constant), window_size - F.size(c))))
    return F.when(F.size(c) >= window_size, full).otherwise(padded if force_padding_with_values else none)


def node_windows(df: DataFrame, *, node, line_id: str, length: int, pad: int = -1, more: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """W-07, P-12, A-22: full windows of line ids of each node, in file order; a node with fewer lines gives one, padded with -1. For
    each column of more, its sum over the window's lines, as sum_<column>. value: a column that windows hold in place of line ids."""
    keys = columns_of(node)
    w = Window.partitionBy(*keys).orderBy(line_id)
    frame = w.rowsBetween(0, length - 1)
    held = F.when(F.col(line_id).isNotNull(), F.col(value)) if value else F.col(line_id)
    rows = df.withColumns({"window": F.collect_list(held).over(frame), "_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), **{f"sum_{c}": F.sum(c).over(frame) for c in more}})
    rows = rows.filter((F.size("window") == length) | ((F.col("_r") == 1) & (F.col("_n") < length)))
    padded = F.concat("window", F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), length - F.size("window"))))
    return rows.select(*keys, F.col(line_id).alias("first_line"), padded.alias("window"), (F.col("_r") == 1).alias("is_first"), *(f"sum_{c}" for c in more))


def line_scores(windows: DataFrame, *, window: str = "window", step_scores: str = "step_scores", is_first: str = "is_first", pad: int = -1) -> DataFrame:
    """W-11, E-08: line_id, score: a line has its own step's score in the window that ends on it; a node's first window scores all its
    lines."""
    size = F.size(window)
    steps = windows.select(is_first, size.alias("_size"), F.posexplode(F.arrays_zip(F.col(window).alias("line_id"), F.col(step_scores).alias("score"))).alias("_pos", "_x"))
    return steps.filter((F.col(is_first) | (F.col("_pos") == F.col("_size") - 1)) & (F.col("_x.line_id") != pad)).select(F.col("_x.line_id").alias("line_id"), F.col("_x.score").alias("score"))


def split_intervals(df: DataFrame, *, start: str, end: str, safe_range: int, interval_unit_t: str = "s", closed: str = "left") -> DataFrame:
    """C-09: one row for each step between start and end, in place of start; an interval without steps keeps one row with null."""
    step = F.expr(f"INTERVAL '{safe_range}' {({'s': 'SECOND', 'm': 'MINUTE', 'h': 'HOUR', 'd': 'DAY'})[interval_unit_t]}")
    s, e = F.col(start), F.col(end)
    steps = F.when(s <= e, F.sequence(s, e, step))
    if closed in ("left", "none"):
        steps = F.filter(steps, lambda x: x < e)
    if closed in ("right", "none"):
        steps = F.filter(steps, lambda x: x > s)
    return df.withColumn(start, F.explode_outer(steps))


def split_longest_interval(df: DataFrame, *, start: str, end: str, safe_range: int) -> DataFrame:
    """C-10: of each start the longest interval, split in steps of seconds."""
    from tidemark.operators.frame import longest_interval

    return split_intervals(longest_interval(df, end, start), start=start, end=end, safe_range=safe_range)

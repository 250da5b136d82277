"""Joins: intervals, incidents, lookups and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frame import columns_of
from tidemark.operators.windows import micros

#: Intervals are broadcast up to this number of rows, which is also how many comparisons a point can cost; beyond it they meet points by
#: time bucket.
BROADCAST_ROWS = 1000


def _within(t: Column, start: Column, end: Column, closed: str) -> Column:
    lower = t >= start if closed in ("both", "left") else t > start
    upper = t <= end if closed in ("both", "right") else t < end
    return lower & upper


def range_join(points: DataFrame, intervals: DataFrame, *, time: str, start: str, end: str, closed: str = "both", how: str = "inner", bucket_seconds: int | None = None, rows: int | None = None) -> DataFrame:
    """J-03's join: each point with each interval that holds it. A few intervals (counted, unless rows says how many there are) are
    broadcast; many are cut at bucket edges, so that the join is an equality on buckets with the range as a further condition. A bucket is
    twice as long as the mean interval, unless bucket_seconds is given, so an interval is in one or two of them as a rule."""
    n = rows if rows is not None else intervals.limit(BROADCAST_ROWS + 1).count()
    cond = _within(F.col(time), F.col(start), F.col(end), closed)
    if n <= BROADCAST_ROWS:
        return points.join(F.broadcast(intervals), cond, how)
    size = bucket_seconds * 1_000_000 if bucket_seconds else _bucket(intervals, start, end)
    bucket = lambda c: F.floor(micros(c) / size)
    cut = intervals.filter(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return points.withColumn("_a", bucket(F.col(time))).join(cut, (F.col("_a") == F.col("_b")) & cond, how).drop("_a", "_b")


def _bucket(intervals: DataFrame, start: str, end: str) -> int:
    """Microseconds of a bucket."""
    mean = intervals.filter(F.col(start) <= F.col(end)).agg(F.avg(micros(end) - micros(start))).first()[0]
    return max(60_000_000, int(2 * (mean or 0)))


def filter_incidents(df: DataFrame, incidents: DataFrame | None, *, datetime_column: str, logs_column: str, event_start_column: str = "event_start", event_end_column: str = "event_end", incident_buffer: int | None = None, mode: str = "outside", order_by=()) -> DataFrame:
    """J-02, Q-01: log rows with regard to incidents, widened by a buffer in seconds at both ends.

    mode outside: rows in no incident, start and end included. mode compat: rows with dt <= start and dt < end for some incident, as
    the rule has been coded elsewhere. Of rows equal in time and text one is kept, the first by order_by (without it, by a hash of the
    whole row). Without incidents all rows are returned.
    """
    if incidents is None:
        return df
    buffer = F.expr(f"INTERVAL '{incident_buffer or 0}' SECOND")
    inc = incidents.select((F.col(event_start_column) - buffer).alias("_s"), (F.col(event_end_column) + buffer).alias("_e"))
    if mode == "compat":  # some start >= dt whose end > dt: the greatest of least(start, end - 1 us) decides
        last = inc.agg(F.max(F.least(micros("_s"), micros("_e") - 1)).alias("_m"))
        kept = df.join(F.broadcast(last), micros(datetime_column) <= F.col("_m")).drop("_m")
    elif mode == "outside":
        kept = _outside(df, inc, datetime_column)
    else:
        raise ValueError(f"unknown mode: {mode}")
    w = Window.partitionBy(datetime_column, logs_column).orderBy(*(columns_of(order_by) or [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))]))
    return kept.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _outside(df: DataFrame, inc: DataFrame, time: str, rows: int | None = None) -> DataFrame:
    n = rows if rows is not None else inc.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(inc), F.col(time).between(F.col("_s"), F.col("_e")), "left_anti")
    size = _bucket(inc, "_s", "_e")
    # cut at bucket edges, and merged within each bucket: a point then meets few disjoint stretches, however much incidents overlap
    cut = inc.filter("_s <= _e").select(micros("_s").alias("s"), micros("_e").alias("e")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor(F.col("e") / size))))
    cut = cut.select("_b", F.greatest("s", F.col("_b") * size).alias("s"), F.least("e", (F.col("_b") + 1) * size - 1).alias("e"))
    w = Window.partitionBy("_b").orderBy("s", "e")
    new = F.when(F.col("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    merged = cut.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w)).groupBy("_b", "_i").agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
    return df.withColumns({"_t": micros(time), "_a": F.floor(micros(time) / size)}).join(merged, (F.col("_a") == F.col("_b")) & F.col("_t").between(F.col("_s"), F.col("_e")), "left_anti").drop("_t", "_a")


def interval_precision(df: DataFrame, intervals: DataFrame, *, time: str, start: str, end: str, score: str | None = None, threshold: float = 0.0, closed: str = "both") -> DataFrame:
    """J-03, E-09, P-07, Q-13: tp, fp and precision of the rows with score >= threshold. A row counts once for each interval that holds it,
    so overlaps can make fp negative; distinct_tp counts rows once. Only rows in the hull of all intervals are considered. Precision is
    null without rows."""
    rows = df if score is None else df.filter(F.col(score) >= threshold)
    hull = intervals.agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    rows = rows.join(F.broadcast(hull), _within(F.col(time), F.col("_lo"), F.col("_hi"), closed)).drop("_lo", "_hi").withColumn("_id", F.monotonically_increasing_id())
    hits = range_join(rows.select("_id", time), intervals.select(F.col(start).alias("_s"), F.col(end).alias("_e")), time=time, start="_s", end="_e", closed=closed)
    tp = hits.groupBy("_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tp"), F.count("*").alias("distinct_tp"))
    n = rows.agg(F.count("*").alias("n"))
    both = tp.crossJoin(F.broadcast(n))  # one row each
    return both.select("tp", (F.col("n") - F.col("tp")).alias("fp"), "distinct_tp", F.when(F.col("n") > 0, F.col("tp") / F.col("n")).alias("precision"))


def with_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """J-04, J-05."""
    return df.join(labels, key, "left")


def strict_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """J-06: a lookup in which a missing key makes the query fail."""
    out = df.join(table.withColumn("_hit", F.lit(True)), key, "left")
    return out.withColumn("_hit", F.when(F.col("_hit"), True).otherwise(F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast("boolean"))).filter("_hit").drop("_hit")


def gather_vectors(windows: DataFrame, vectors: DataFrame, *, window_id: str, ids: str, key: str, vector: str) -> DataFrame:
    """J-07, M-15: window_id, vectors: one vector for each slot, in order; a slot without one has null."""
    slots = windows.select(window_id, F.posexplode_outer(ids).alias("_pos", key))
    joined = slots.join(vectors.select(key, vector), key, "left")
    rows = joined.groupBy(window_id).agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(vector).alias("_v")))).alias("_rows"))
    return rows.select(window_id, F.transform("_rows", lambda x: x["_v"]).alias("vectors"))


def map_distinct(df: DataFrame, column: str, function, *, out: str) -> DataFrame:
    """J-08: function maps the frame of distinct values (one column) to value and out; the result is joined back."""
    return df.join(function(df.select(column).distinct()), column, "left")


def cosine(a: str, b: str) -> Column:
    """The cosine of two array columns, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pairwise_cosine(df: DataFrame, *, key: str, vector: str, block: int = 1024) -> DataFrame:
    """J-09: left, right, distance (1 - cosine) for all pairs of a table of vectors, whatever its size: rows are dealt to blocks of about
    `block`, and each pair of blocks meets once, by equality. All pairs are what is asked for; near ones alone are a search's work."""
    blocks = max(1, -(-df.count() // block))
    dealt = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = dealt.withColumn("o", other).select("k", "v", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    a = rows.select(F.col("k").alias("left"), F.col("v").alias("_a"), F.col("b").alias("_ba"), "x", "y")
    b = rows.select(F.col("k").alias("right"), F.col("v").alias("_b"), F.col("b").alias("_bb"), "x", "y")
    met = (F.col("left") < F.col("right")) & ((F.col("_ba") != F.col("_bb")) | (F.col("x") == F.col("y")))
    return a.join(b, ["x", "y"]).filter(met).select("left", "right", (1 - cosine("_a", "_b")).alias("distance"))

"""The catalogue: one query for each operator that tables can show, and the SQL that says what it has to return.

Log lines are events: node = user_id, order = (ts, event_id), label = an error, score and metric = value. `hourly` is the sum of values
of each event type and hour. Incidents are errors over 150, with ten minutes on both sides.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.operators import evaluation, frame, joins, order, scaling, scoring, tiles, windows
from tidemark.operators.templates import MinerConfig, TemplateMiner, calinski_harabasz
from tidemark.plans import drift, logs, metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, d) -> DataFrame:
    return read(spark, d, "events")


def lines(spark, d) -> DataFrame:
    e = events(spark, d)
    return e.withColumn("message", F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id"), F.lit(" value "), F.col("value"))).withColumn("label", (F.col("event_type") == "error").cast("int"))


def hourly(spark, d) -> DataFrame:
    e = events(spark, d)
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*(F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)).alias(t) for t in TYPES))


HOURLY = "hourly AS (SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"coalesce(sum(CASE WHEN event_type = '{t}' THEN value END), 0.0) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1)"


def incidents(spark, d) -> DataFrame:
    e = events(spark, d).filter("event_type = 'error' and value > 150")
    return e.select(text.shifted("ts", -600).alias("event_start"), text.shifted("ts", 600).alias("event_end"))


INCIDENTS = "incidents AS (SELECT ts - INTERVAL 600 SECOND AS event_start, ts + INTERVAL 600 SECOND AS event_end FROM events WHERE event_type = 'error' AND value > 150)"
KEY = ("ts", "event_id")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# Projections and filters


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error', 'view') AND value IS NOT NULL AND value > 20")
def scan_project_filter(spark, d):
    """S-01, F-09, P-08."""
    return events(spark, d).filter(F.col("event_type").isin("error", "view") & F.col("value").isNotNull() & (F.col("value") > 20)).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, CAST(0 AS INTEGER) AS zero, CAST(1 AS INTEGER) AS one, value AS score FROM events")
def add_literals_alias(spark, d):
    """F-02 .. F-04."""
    df = frame.add_alias_from(frame.add_ones(frame.add_zeros(events(spark, d), column="zero"), column="one"), column="value", alias="score")
    return df.select("event_id", "zero", "one", "score")


@query("SELECT event_id, strptime(strftime(ts, '%y%m%d %H%M%S'), '%y%m%d %H%M%S') AS parsed, CAST(ts AS DATE) AS day FROM events")
def date_parse_cast(spark, d):
    """F-08, C-05: texts parsed with a format."""
    df = events(spark, d).select("event_id", F.date_format("ts", "yyMMdd HHmmss").alias("parsed"), F.to_date("ts").alias("day"))
    return text.parsed_datetime(df, "parsed", "yyMMdd HHmmss")


@query("SELECT event_id, regexp_replace(props, '\\d+', 'N', 'g') AS props_mapped FROM events")
def replace_regex(spark, d):
    """C-01."""
    return text.replaced(events(spark, d), column="props", pattern=r"\d+", replacement="N").select("event_id", "props_mapped")


@query("SELECT doc_id, regexp_replace(substring(text, 1, 40), '^\\s+|\\s+$', '', 'g') AS head FROM documents")
def strip_slice(spark, d):
    """C-02, C-03: whole texts are read; the slice is the operator."""
    return read(spark, d, "documents").select("doc_id", text.stripped(text.first_characters("text", 40)).alias("head"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^(https?)://') THEN regexp_extract(url, '^(https?)://', 1) END AS scheme, CASE WHEN regexp_matches(url, '\\?(.*)$') THEN regexp_extract(url, '\\?(.*)$', 1) END AS query, CAST(len(regexp_extract_all(url, '[0-9]+')) AS BIGINT) AS numbers FROM pages")
def extract_groups(spark, d):
    """C-04: no match is null."""
    return read(spark, d, "pages").select("page_id", text.extracted("url", r"^(https?)://").alias("scheme"), text.extracted("url", r"\?(.*)$").alias("query"), F.size(text.extracted_all("url", "[0-9]+")).cast("long").alias("numbers"))


@query("SELECT event_id, regexp_replace(regexp_replace(event_type || ' user ' || user_id || ' value ' || value, '\\d+\\.\\d+', 'FLOAT', 'g'), '\\d+', 'NUM', 'g') AS masked FROM events")
def mask_messages(spark, d):
    """L-02, L-03."""
    rules = [(r"\d+\.\d+", "FLOAT"), (r"\d+", "NUM")]
    return lines(spark, d).select("event_id", text.masked("message", rules).alias("masked"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01'")
def interval_overlap(spark, d):
    """P-01."""
    df = read(spark, d, "orders").withColumn("end", F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS"))
    lo, hi = (datetime.datetime(1995, m, 1) for m in (3, 6))
    return frame.filter_datetime_range(df, start="o_orderdate", end="end", dtime_min=lo, dtime_max=hi).select("o_orderkey")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60")
def group_length_keys(spark, d):
    """P-02, A-04."""
    return frame.filter_group_length(events(spark, d), groupby_col="user_id", min_length=60)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 60)")
def semi_groups(spark, d):
    """J-01."""
    return frame.rows_of_long_groups(events(spark, d), groupby_col="user_id", min_length=60).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05 23:59:59') AND NOT (ts BETWEEN TIMESTAMP '2024-01-10 08:00:00' AND TIMESTAMP '2024-01-10 12:30:00')")
def exclude_ranges(spark, d):
    """P-03."""
    return frame.exclude_ranges(events(spark, d), "ts", [{"date": "2024-01-05"}, {"date": "2024-01-10", "start_time": "08:00:00", "end_time": "12:30:00"}]).select("event_id")


@query("SELECT CASE WHEN ts <= TIMESTAMP '2024-01-14' THEN 'train' WHEN ts >= TIMESTAMP '2024-01-20' THEN 'test' ELSE 'validation' END AS split, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-28' GROUP BY 1")
def date_split_counts(spark, d):
    """P-04, P-05, N-09."""
    df = frame.split_by_dates(events(spark, d), "2024-01-02", "2024-01-28", "ts")
    return frame.value_counts(frame.split_train_test(df, "ts", "2024-01-14", "2024-01-20"), "split")


@query(f"WITH {HOURLY} SELECT CAST(sum(CASE WHEN click IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS error FROM (SELECT nullif(click, 0) AS click, nullif(error, 0) AS error FROM hourly)")
def missing_counts(spark, d):
    """P-08, P-13."""
    return frame.missing_counts(hourly(spark, d).select(F.nullif("click", F.lit(0.0)).alias("click"), F.nullif("error", F.lit(0.0)).alias("error")), ["click", "error"])


# Aggregations


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM events GROUP BY user_id")
def agg_to_list(spark, d):
    """A-01."""
    e = events(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return frame.aggregates_to_list(e, "user_id", ["event_type"], "o").select("user_id", F.array_join("event_type", ",").alias("types"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def groupby_first(spark, d):
    """A-02."""
    return frame.groupby_first(events(spark, d), sort_cols=["value"], groupby_cols="user_id", tie_break=["event_id"]).select("user_id", "event_id", "value")


INTERVALS = "iv AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 10) AS e FROM orders)"


def order_intervals(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 10).cast("int"))).alias("e"))


@query(f"WITH {INTERVALS} SELECT o_orderkey, s, e FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY e DESC, o_orderkey DESC) AS r FROM iv) WHERE r = 1")
def longest_interval(spark, d):
    """A-03."""
    return frame.longest_interval(order_intervals(spark, d), "e", "s", "o_orderkey")


@query(f"WITH {INTERVALS} SELECT o_orderkey, x.t AS s, e FROM iv, LATERAL (SELECT unnest(CASE WHEN len(range(s, e, INTERVAL 2 DAY)) > 0 THEN range(s, e, INTERVAL 2 DAY) ELSE [NULL] END) AS t) x")
def split_intervals(spark, d):
    """C-09, O-08."""
    return windows.split_intervals(order_intervals(spark, d), start="s", end="e", safe_range=2, interval_unit_t="d").select("o_orderkey", "s", "e")


@query(f"WITH {INTERVALS}, b AS (SELECT o_orderkey, s, e FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY e DESC) AS r FROM iv) WHERE r = 1) SELECT x.t AS s, e FROM b, LATERAL (SELECT unnest(CASE WHEN len(range(s, e, INTERVAL 86400 SECOND)) > 0 THEN range(s, e, INTERVAL 86400 SECOND) ELSE [NULL] END) AS t) x")
def split_longest_interval(spark, d):
    """C-10."""
    return windows.split_longest_interval(order_intervals(spark, d), start="s", end="e", safe_range=86_400).select("s", "e")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    """A-13."""
    return frame.value_counts(events(spark, d), "event_type")


@query("SELECT count(DISTINCT user_id) AS n_unique, CAST(sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, min(user_id) AS least, max(user_id) AS greatest FROM events")
def column_profile(spark, d):
    """A-16."""
    return frame.profile(events(spark, d), "user_id")


@query("WITH b AS (SELECT user_id, arg_min(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(CASE WHEN n < 50 THEN 1 ELSE 0 END) AS BIGINT) AS short_blocks, min(n) AS shortest FROM b GROUP BY 1")
def block_summary(spark, d):
    """A-14."""
    return frame.block_label_summary(events(spark, d), "user_id", "event_type", "event_id", short=50)


@query("SELECT user_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1")
def class_rollup_pivot(spark, d):
    """A-15, O-11, T-09."""
    return frame.class_rollup(events(spark, d), "user_id", "event_type", TYPES)


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id >= 10 GROUP BY 1 ORDER BY n DESC, user_id LIMIT 12")
def topk_templates(spark, d):
    """A-21: a top-12 report."""
    return frame.top_counts(events(spark, d), "user_id", 12, least=10)


@query("SELECT message, first_seen FROM (SELECT event_type || ' ' || (user_id % 7) AS message, min(event_id) AS first_seen FROM events GROUP BY 1)")
def distinct_first_seen(spark, d):
    """O-05."""
    return order.distinct_in_order(events(spark, d).withColumn("message", F.concat_ws(" ", "event_type", (F.col("user_id") % 7).cast("string"))), "message", "event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def distinct_by_subset(spark, d):
    """O-06."""
    return order.distinct_by(events(spark, d), ["user_id", "event_type"], KEY).select("event_id")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS index FROM events")
def row_index(spark, d):
    """F-06: no single task numbers all rows."""
    return order.with_row_index(events(spark, d), KEY).select("event_id", "index")


@query("SELECT *, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS index FROM events")
def row_index_wide(spark, d):
    """F-06: with all columns of the frame."""
    return order.with_row_index(events(spark, d), KEY)


@query("WITH i AS (SELECT *, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS index FROM events) SELECT * FROM i WHERE index % 3 = 0")
def gather_rows(spark, d):
    """F-07: whole rows by position."""
    indexed = order.with_row_index(events(spark, d), KEY)
    return order.gather(indexed, indexed.filter("index % 3 = 0").select(F.col("index").alias("position"))).select(*events(spark, d).columns, "index")


@query("SELECT CASE WHEN i < CAST(0.6 * n AS BIGINT) THEN 'fit' WHEN i < CAST(0.8 * n AS BIGINT) THEN 'val' ELSE 'rest' END AS split, count(*) AS n, round(sum(value), 4) AS total, max(props) AS last FROM (SELECT value, props, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) GROUP BY 1")
def fraction_split(spark, d):
    """W-12."""
    parts = order.chronological_split(order.with_row_index(events(spark, d), KEY), "index", {"fit": 0.6, "val": 0.8})
    return rounded(parts.groupBy("split").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("props").alias("last")), "total", digits=4)


@query("SELECT a.user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') a WHERE a.user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)")
def set_intersection(spark, d):
    """O-10."""
    e = events(spark, d)
    return frame.common_values(e.filter("event_type = 'error'"), e.filter("event_type = 'signup' and value > 100"), "user_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)")
def anti_unmatched(spark, d):
    """O-10, M-05."""
    e = events(spark, d)
    return frame.only_values(e.filter("event_type = 'error'"), e.filter("event_type = 'signup' and value > 100"), "user_id")


@query("SELECT event_id, 'a' AS part FROM events WHERE value > 100 UNION ALL SELECT event_id, 'b' AS part FROM events WHERE value <= 20")
def union_parts(spark, d):
    """O-09."""
    e = events(spark, d)
    return frame.union_all(e.filter("value > 100").select("event_id", F.lit("a").alias("part")), e.filter("value <= 20").select("event_id", F.lit("b").alias("part")))


# Windows


GAPS = "g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS gap FROM events), s AS (SELECT *, CASE WHEN gap IS NULL THEN 0 ELSE sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS session FROM g)"


@query("SELECT event_id, CAST((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS DOUBLE) / 60 AS minutes FROM events")
def time_delta(spark, d):
    """W-01."""
    return windows.time_delta(events(spark, d), column="ts", out_column="minutes", order_by=KEY, partition_by="user_id", time_unit="m").select("event_id", "minutes")


@query(f"WITH {GAPS} SELECT event_id, CAST(session AS BIGINT) AS session FROM s")
def gap_groups(spark, d):
    """W-02."""
    return windows.gap_groups(events(spark, d), column="ts", out_column="session", threshold=43_200, order_by=KEY, partition_by="user_id").select("event_id", "session")


@query(f"WITH {GAPS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 3")
def gap_group_sizes(spark, d):
    """W-02, P-02."""
    g = windows.gap_groups(events(spark, d), column="ts", out_column="session", threshold=43_200, order_by=KEY, partition_by="user_id")
    return frame.value_counts(g, "user_id", "session").filter("n >= 3")


def _rolling(name: str, closed: str, low: str, high: str):
    @query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {low} AND {high}), 6) AS total FROM events")
    def f(spark, d, closed=closed):
        df = windows.centered_rolling_sum(events(spark, d), column="value", safe_range=86_400, index_column="ts", out_column="total", partition_by="user_id", closed=closed)
        return rounded(df.select("event_id", "total"), "total")

    QUERIES[name], SQL[name] = QUERIES.pop("f"), SQL.pop("f")


_DAY = 86_400_000_000
_rolling("centered_rolling_sum_right", "right", f"{_DAY - 1} PRECEDING", f"{_DAY} FOLLOWING")
_rolling("centered_rolling_sum_left", "left", f"{_DAY} PRECEDING", f"{_DAY - 1} FOLLOWING")
_rolling("centered_rolling_sum_both", "both", f"{_DAY} PRECEDING", f"{_DAY} FOLLOWING")
_rolling("centered_rolling_sum_none", "none", f"{_DAY - 1} PRECEDING", f"{_DAY - 1} FOLLOWING")


@query("SELECT event_id, CAST(len(w) AS BIGINT) AS n, round(list_sum(w), 6) AS total FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM events)")
def forward_window_partial(spark, d):
    """W-04."""
    w = windows.forward_windows(events(spark, d), "value", 5, order_by=KEY, partition_by="user_id", output=["w"])
    return w.select("event_id", F.size("w").cast("long").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT event_id, round(list_sum(w), 6) AS total FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM events) WHERE len(w) = 5")
def forward_window_full(spark, d):
    """W-04, W-08, P-09."""
    w = windows.forward_windows(events(spark, d), "value", 5, order_by=KEY, partition_by="user_id", output=["w"], filter_valid_rows=True)
    return w.select("event_id", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {GAPS}, p AS (SELECT *, count(*) OVER (PARTITION BY user_id, session) AS n, count(*) OVER w AS k, sum(value) OVER w AS t FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT user_id, count(*) AS windows, round(sum(t), 6) AS total FROM p WHERE k = 3 GROUP BY 1")
def session_windows(spark, d):
    """W-02, W-04, W-05, P-02, A-01: for each user, sessions by gaps over 12 hours, and the windows of three events in them."""
    g = windows.gap_groups(events(spark, d), column="ts", out_column="session", threshold=43_200, order_by=KEY, partition_by="user_id")
    w = windows.forward_windows(g, "value", 3, order_by=KEY, partition_by=["user_id", "session"], output=["w"], filter_valid_rows=True)
    return w.groupBy("user_id").agg(F.count("*").alias("windows"), F.round(F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


_GEN = f"WITH {GAPS}, p AS (SELECT user_id, session, event_id, ts, list(event_id) OVER w AS l, count(*) OVER (PARTITION BY user_id, session) AS n, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS r FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"


@query(_GEN + " SELECT user_id, CAST(session AS BIGINT) AS session, event_id AS first_position, array_to_string(l, ',') AS positions FROM p WHERE len(l) = 3")
def generate_windows(spark, d):
    """W-05."""
    w = windows.generate_windows(events(spark, d), column="ts", order_by=KEY, partition_by="user_id", delta_thr=43_200, sequence_length=3, index="event_id")
    return w.select("user_id", "session", "first_position", F.array_join("window", ",").alias("positions"))


@query(_GEN + " SELECT user_id, CAST(session AS BIGINT) AS session, event_id AS first_position, array_to_string(list_concat(l, list_transform(range(3 - len(l)), lambda x: -1)), ',') AS positions FROM p WHERE len(l) = 3 OR (n < 3 AND r = 1)")
def generate_windows_padded(spark, d):
    """W-05, Q-07."""
    w = windows.generate_windows(events(spark, d), column="ts", order_by=KEY, partition_by="user_id", delta_thr=43_200, sequence_length=3, index="event_id", force_padding_with_values=True, padding_constant=-1)
    return w.select("user_id", "session", "first_position", F.array_join("window", ",").alias("positions"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings), w AS (SELECT vec_id, unnest(range(6)) AS i, l FROM v) SELECT vec_id, i, round(l[i + 1], 6) AS a, round(l[i + 2], 6) AS b, round(l[i + 3], 6) AS c, round(l[i + 4], 6) AS d FROM w")
def array_windows(spark, d):
    """W-06: windows of four of nine values."""
    v = read(spark, d, "embeddings").select("vec_id", F.posexplode(windows.array_windows(F.slice(F.col("embedding").cast("array<double>"), 1, 9), 4)).alias("i", "w"))
    return rounded(v.select("vec_id", F.col("i").cast("long").alias("i"), *(F.col("w")[k].alias(c) for k, c in enumerate("abcd"))), *"abcd")


@query("SELECT user_id, CAST(greatest(0, count(*) - 3) AS BIGINT) AS n, CAST(CASE WHEN count(*) < 4 THEN 1 ELSE 0 END AS BIGINT) AS padded FROM events GROUP BY 1")
def array_window_counts(spark, d):
    """W-06: the number of windows of each user's values, and of padded ones where there is none."""
    a = events(spark, d).groupBy("user_id").agg(F.collect_list("value").alias("l"))
    full, padded = (F.size(windows.array_windows("l", 4, force)).cast("long") for force in (False, True))
    return a.select("user_id", full.alias("n"), (padded - full).alias("padded"))


_NODE = "n AS (SELECT user_id, event_id AS first_line, list(event_id) OVER w AS l, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS errors, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING))"


@query(f"WITH {_NODE} SELECT user_id, first_line, CAST(list_sum(list_concat(l, list_transform(range(60 - len(l)), lambda x: -1))) AS BIGINT) AS lines, CAST(errors AS BIGINT) AS sum_label, r = 1 AS is_first FROM n WHERE len(l) = 60 OR (c < 60 AND r = 1)")
def node_windows_padded(spark, d):
    """W-07, P-12, A-22."""
    w = windows.node_windows(lines(spark, d), node="user_id", line_id="event_id", length=60, more=["label"])
    return w.select("user_id", "first_line", F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("lines"), F.col("sum_label").cast("long").alias("sum_label"), "is_first")


@query(f"WITH {_NODE}, x AS (SELECT r, l, len(l) AS k, unnest(l) AS line_id, unnest(range(len(l))) AS pos FROM n WHERE len(l) = 60 OR (c < 60 AND r = 1)) SELECT line_id, round(CAST(pos * 0.5 + r AS DOUBLE), 6) AS score FROM x WHERE r = 1 OR pos = 59")
def line_scores(spark, d):
    """W-11, E-08: a step's score is half its place plus the window's number in its node."""
    w = windows.node_windows(lines(spark, d), node="user_id", line_id="event_id", length=60)
    from pyspark.sql import Window

    w = w.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("first_line")))
    w = w.withColumn("step_scores", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: i * 0.5 + F.col("r")))
    return rounded(windows.line_scores(w), "score")


@query(f"WITH {HOURLY} SELECT ts AS window_ts, round(t, 6) AS total FROM (SELECT lead(hour, 23) OVER (ORDER BY hour) AS ts, sum(click + error) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS t FROM hourly) WHERE ts IS NOT NULL")
def last_row_windows(spark, d):
    """W-09. One row for each hour, so that all are one window; events without a time are of no hour."""
    h = hourly(spark, d).filter("hour is not null")
    w = windows.last_row_windows(h, ["click", "error"], 24, timestamp="hour", order_by="hour", partition_by=windows.WHOLE, zero_padding=False)
    return w.select("window_ts", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0] + x[1]), 6).alias("total"))


# Scalar features and scaling


@query("SELECT event_id, round(cos(2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000), 6) AS ts_day_cos, round(sin(2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000), 6) AS ts_day_sin FROM events")
def cyclic_features(spark, d):
    """C-11, C-12."""
    df = text.cyclic_features(events(spark, d), "ts", {"day": 86_400}, prefix="ts")
    return rounded(df.select("event_id", "ts_day_cos", "ts_day_sin"), "ts_day_cos", "ts_day_sin")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events")
def iso_times(spark, d):
    """C-15, C-16."""
    return events(spark, d).select("event_id", text.iso_millis("ts").alias("iso"), F.weekday("ts").alias("weekday"))


def _scaled(kind: str, quantiles=(5.0, 95.0)):
    def f(spark, d):
        h = hourly(spark, d)
        return rounded(scaling.Scaler(kind, quantiles).fit_transform(h, ["click", "error"]).select("hour", "click", "error"), "click", "error")

    return f


def _scale_sql(a: str, b: str, x: str = "{c}") -> str:
    one = lambda c: f"round(({x.format(c=c)} - ({a.format(c=x.format(c=c))})) / ({b.format(c=x.format(c=c))}), 6) AS {c}"
    return f"WITH {HOURLY} SELECT hour, {one('click')}, {one('error')} FROM hourly"


def _over(e: str) -> str:
    return f"(SELECT {e} FROM hourly)"


QUERIES["scale_minmax"] = _scaled("MinMaxScaler")
SQL["scale_minmax"] = _scale_sql(_over("min({c})"), _over("max({c}) - min({c})"))
QUERIES["scale_standard"] = _scaled("StandardScaler")
SQL["scale_standard"] = _scale_sql(_over("avg({c})"), _over("stddev_pop({c})"))
QUERIES["scale_robust"] = _scaled("RobustScaler")
SQL["scale_robust"] = _scale_sql(_over("quantile_cont({c}, 0.5)"), _over("quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)"))
QUERIES["normalize_custom"] = _scaled("custom")
SQL["normalize_custom"] = _scale_sql(_over("quantile_cont({c}, 0.5)"), _over("quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)"), "asinh({c})")


@query(f"WITH {HOURLY}, tr AS (SELECT * FROM hourly WHERE hour <= TIMESTAMP '2024-01-14' AND NOT hour BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-05 23:59:59') SELECT 'train' AS split, count(*) AS n, round(sum((click - (SELECT avg(click) FROM tr)) / (SELECT stddev_pop(click) FROM tr)), 4) AS click FROM tr UNION ALL SELECT 'test', count(*), round(sum((click - (SELECT avg(click) FROM tr)) / (SELECT stddev_pop(click) FROM tr)), 4) FROM hourly WHERE hour >= TIMESTAMP '2024-01-20'")
def metric_preprocessing(spark, d):
    """N-08 .. N-11."""
    parts, _ = metrics.split_and_prepared(hourly(spark, d), timestamp_col="hour", metric_columns=["click"], train_end="2024-01-14", test_start="2024-01-20", exclude=[{"date": "2024-01-05"}])
    one = lambda s: parts[s].agg(F.lit(s).alias("split"), F.count("*").alias("n"), (F.round(F.sum("click"), 4) + F.lit(0.0)).alias("click"))
    return one("train").unionByName(one("test"))


# Joins


@query(f"WITH {INCIDENTS} SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM incidents i WHERE NOT (e.ts > i.event_start) AND e.ts < i.event_end)")
def incident_filter_compat(spark, d):
    """J-02, Q-01."""
    e = lines(spark, d).withColumn("message", F.concat_ws(" ", "message", "event_id"))
    return joins.filter_incidents(e, incidents(spark, d), datetime_column="ts", logs_column="message", mode="compat").select("event_id")


@query(f"WITH {INCIDENTS} SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM incidents i WHERE e.ts BETWEEN i.event_start AND i.event_end)")
def incident_filter_outside(spark, d):
    """J-02."""
    e = lines(spark, d).withColumn("message", F.concat_ws(" ", "message", "event_id"))
    return joins.filter_incidents(e, incidents(spark, d), datetime_column="ts", logs_column="message").select("event_id")


@query(f"WITH {INCIDENTS}, r AS (SELECT * FROM events WHERE value >= 100 AND ts BETWEEN (SELECT min(event_start) FROM incidents) AND (SELECT max(event_end) FROM incidents)), h AS (SELECT r.event_id FROM r JOIN incidents i ON r.ts BETWEEN i.event_start AND i.event_end) SELECT (SELECT count(*) FROM h) AS tp, (SELECT count(*) FROM r) - (SELECT count(*) FROM h) AS fp, (SELECT count(DISTINCT event_id) FROM h) AS distinct_tp, round((SELECT count(*) FROM h) / (SELECT count(*) FROM r), 6) AS precision")
def interval_precision(spark, d):
    """J-03, E-09, P-07, Q-13."""
    return rounded(joins.interval_precision(events(spark, d), incidents(spark, d), time="ts", start="event_start", end="event_end", score="value", threshold=100), "precision")


@query(f"WITH {INCIDENTS} SELECT event_id, event_start FROM events JOIN incidents ON ts >= event_start AND ts < event_end")
def range_join_bucketed(spark, d):
    """J-03 with intervals too many to broadcast: they are cut at bucket edges."""
    return joins.range_join(events(spark, d), incidents(spark, d), time="ts", start="event_start", end="event_end", closed="left", rows=joins.BROADCAST_ROWS + 1).select("event_id", "event_start")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_label_join(spark, d):
    """J-04, J-05."""
    return joins.with_labels(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def strict_lookup(spark, d):
    """J-06."""
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.strict_lookup(read(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey").select("c_custkey", "n_name")


@query("WITH w AS (SELECT event_id, [user_id % 500, event_id % 500] AS ids FROM events), x AS (SELECT event_id, unnest(ids) AS vec_id, unnest([1, 2]) AS p FROM w) SELECT event_id, round(sum(p * CAST(embedding[1] AS DOUBLE)), 6) AS mark FROM x JOIN embeddings USING (vec_id) GROUP BY 1")
def gather_vectors(spark, d):
    """J-07, M-15: two slots for each event; the mark weighs their vectors' first components by place."""
    w = events(spark, d).select("event_id", F.array((F.col("user_id") % 500).cast("long"), (F.col("event_id") % 500).cast("long")).alias("ids"))
    got = joins.gather_vectors(w, read(spark, d, "embeddings"), window_id="event_id", ids="ids", key="vec_id", vector="embedding")
    mark = F.aggregate(F.transform("vectors", lambda v, i: v[0].cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select("event_id", F.round(mark, 6).alias("mark"))


@query("SELECT event_id, upper(event_type) AS up FROM events")
def map_distinct(spark, d):
    """J-08."""
    return joins.map_distinct(events(spark, d).select("event_id", "event_type"), "event_type", lambda v: v.withColumn("up", F.upper("event_type")), out="up").select("event_id", "up")


_NATION_VECTORS = "v AS (SELECT s_suppkey AS k, [s_acctbal, s_nationkey * 100 + 1.0, s_suppkey + 0.5] AS e FROM supplier)"


def _supplier_vectors(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.array(F.col("s_acctbal"), F.col("s_nationkey") * 100 + 1.0, F.col("s_suppkey") + 0.5).alias("e"))


@query(f"WITH {_NATION_VECTORS}, p AS (SELECT 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a.k < b.k) SELECT round(quantile_disc(d, 0.5), 6) AS median, round(min(d), 6) AS least, round(min(CASE WHEN d > 1e-4 THEN d END), 6) AS least_over, round(quantile_cont(d, 0.1), 6) AS q10, round(avg(CASE WHEN d < 1e-4 THEN 1.0 ELSE 0.0 END), 6) AS share_under FROM p")
def pairwise_cosine_stats(spark, d):
    """J-09, M-16, M-17: over a table of template-like vectors."""
    return rounded(tiles.distance_stats(_supplier_vectors(spark, d), key="k", vector="e"), "median", "least", "least_over", "q10", "share_under")


# Statistics and drift


@query("WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND value > 120 GROUP BY 1) SELECT CAST(x.day AS DATE) AS day, coalesce(p.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(day) FROM p), (SELECT max(day) FROM p), INTERVAL 1 DAY)) AS day) x LEFT JOIN p ON p.day = x.day")
def rows_per_day(spark, d):
    """A-06."""
    return stats.rows_per_day(events(spark, d).filter("event_type = 'error' and value > 120"), "ts")


@query("WITH f AS (SELECT ts FROM events ORDER BY event_id LIMIT 2000), g AS (SELECT round((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1000000.0, 1) AS seconds, row_number() OVER (ORDER BY ts) AS r FROM f) SELECT seconds FROM g WHERE seconds IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(r) LIMIT 1")
def sampling_interval(spark, d):
    """A-07, Q-23: a mode of the first 2000 rows, which the rule asks for."""
    return stats.sampling_interval(events(spark, d), "ts", "event_id")


@query(f"WITH {HOURLY} SELECT " + ", ".join(f'round(avg(CASE WHEN "{t}" = 0 THEN 1.0 ELSE 0.0 END), 6) AS "{t}"' for t in TYPES) + " FROM hourly")
def zero_rates(spark, d):
    """A-08, A-09."""
    return rounded(hourly(spark, d).agg(*(stats.zero_rate(t).alias(t) for t in TYPES)), *TYPES)


_DAYPART = f"WITH {HOURLY}, l AS (SELECT *, timezone('Europe/Berlin', timezone('UTC', hour)) AS t FROM hourly)"


@query(_DAYPART + " SELECT CAST(t AS DATE) AS date, CASE WHEN extract(hour FROM t) >= 8 AND extract(hour FROM t) < 18 THEN 'working' ELSE 'night' END AS daypart, round(median(click), 6) AS click, round(median(error), 6) AS error FROM l GROUP BY 1, 2")
def daypart_medians(spark, d):
    """A-05, Q-14."""
    return rounded(stats.daypart_medians(hourly(spark, d), ["click", "error"], "hour").select("date", "daypart", "click", "error"), "click", "error")


@query(_DAYPART + " SELECT CAST(t AS DATE) AS date, CASE WHEN extract(hour FROM t) >= 8 AND extract(hour FROM t) < 18 THEN 'working' ELSE 'night' END AS daypart, round(median(view), 6) AS view, CAST(isodow(CAST(t AS DATE)) - 1 AS INTEGER) AS weekday FROM l WHERE isodow(CAST(t AS DATE)) < 6 GROUP BY 1, 2, 4")
def daypart_medians_weekdays(spark, d):
    """A-05."""
    return rounded(stats.daypart_medians(hourly(spark, d), ["view"], "hour", weekdays_only=True).select("date", "daypart", "view", "weekday"), "view")


_SIDES = f"WITH {HOURLY}, x AS (SELECT click AS x, hour < TIMESTAMP '2024-01-15' AS r FROM hourly), n AS (SELECT sum(CASE WHEN r THEN 1 ELSE 0 END) AS n, sum(CASE WHEN r THEN 0 ELSE 1 END) AS m FROM x)"


def _sides(spark, d):
    return hourly(spark, d).select(F.col("click").alias("x"), (F.col("hour") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("r"))


@query(_SIDES + ", s AS (SELECT x, sum(sum(CASE WHEN r THEN 1 ELSE 0 END)) OVER (ORDER BY x) AS a, sum(sum(CASE WHEN r THEN 0 ELSE 1 END)) OVER (ORDER BY x) AS b, lead(x) OVER (ORDER BY x) AS nx FROM x GROUP BY x) SELECT round(max(abs(a / n - b / m)), 6) AS ks, round(sum(abs(a / n - b / m) * (nx - x)), 4) AS wasserstein FROM s, n")
def ks_wasserstein(spark, d):
    """E-06, T-06, W-13."""
    f = stats.ks_and_wasserstein(_sides(spark, d), "x", "r")
    return f.select(F.round("ks", 6).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"))


@query(_SIDES + ", q AS (SELECT list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM x WHERE r), b AS (SELECT r, len(list_filter(list_sort(e)[2:len(e) - 1], lambda y: x.x >= y)) AS bin FROM x, q), c AS (SELECT bin, greatest(sum(CASE WHEN r THEN 1 ELSE 0 END) / (SELECT n FROM n), 1e-6) AS p, greatest(sum(CASE WHEN r THEN 0 ELSE 1 END) / (SELECT m FROM n), 1e-6) AS c FROM b GROUP BY 1) SELECT round(sum((c - p) * ln(c / p)), 6) AS psi, CAST((SELECT len(e) - 1 FROM q) AS INTEGER) AS n_bins FROM c")
def psi(spark, d):
    """T-03, T-04."""
    return rounded(stats.psi(_sides(spark, d), "x", "r", 5), "psi")


_GAP = "(SELECT seconds FROM (SELECT round((epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour)) / 1000000.0, 1) AS seconds, row_number() OVER (ORDER BY hour) AS r FROM hourly WHERE {c}) WHERE seconds IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(r) LIMIT 1)"
_DAYS = "(SELECT x.day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(CAST(hour AS DATE)), max(CAST(hour AS DATE)), INTERVAL 1 DAY)) AS day FROM hourly WHERE {c}) x LEFT JOIN (SELECT CAST(hour AS DATE) AS day, count(*) AS n FROM hourly WHERE {c} GROUP BY 1) y ON CAST(x.day AS DATE) = y.day)"
_REF, _TEST = "hour < TIMESTAMP '2024-01-15'", "hour >= TIMESTAMP '2024-01-15'"
_TIER0 = f"WITH {HOURLY}, z AS (SELECT (SELECT avg(n) FROM {_DAYS.format(c=_REF)}) AS a, (SELECT avg(n) FROM {_DAYS.format(c=_TEST)}) AS b, (SELECT count(*) FROM hourly WHERE {_REF}) AS ra, (SELECT count(*) FROM hourly WHERE {_TEST}) AS rb, (SELECT count(*) FROM {_DAYS.format(c=_TEST)} WHERE n < 20) AS low, {_GAP.format(c=_REF)} AS ga, {_GAP.format(c=_TEST)} AS gb)"


def _tier0(spark, d):
    h = hourly(spark, d).withColumnsRenamed({t: f"value_{t}" for t in TYPES})
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return drift.tier0(h.filter(F.col("hour") < cut), h.filter(F.col("hour") >= cut), [f"value_{t}" for t in TYPES], list(TYPES), ["value"], "hour", "hour", drift.THRESHOLDS | {"tier0_min_rows_per_day": 20})


@query(_TIER0 + " SELECT 'ref_rows' AS \"check\", CAST(ra AS DOUBLE) AS value, 'info' AS level, TRUE AS passed FROM z UNION ALL SELECT 'test_rows', rb, 'info', TRUE FROM z UNION ALL SELECT 'ref_mean_rows_per_day', round(a, 1), 'info', TRUE FROM z UNION ALL SELECT 'test_mean_rows_per_day', round(b, 1), 'info', TRUE FROM z UNION ALL SELECT 'row_count_drop_pct', round(100 * (a - b) / a, 2), CASE WHEN 100 * (a - b) / a > 20 THEN 'fail' ELSE 'ok' END, 100 * (a - b) / a <= 20 FROM z UNION ALL SELECT 'sampling_interval_sec_ref', ga, 'info', TRUE FROM z UNION ALL SELECT 'sampling_interval_sec_test', gb, CASE WHEN abs(ga - gb) > 1 THEN 'warn' ELSE 'ok' END, abs(ga - gb) <= 1 FROM z UNION ALL SELECT 'test_days_below_min_rows', low, CASE WHEN low > 0 THEN 'warn' ELSE 'ok' END, low = 0 FROM z")
def tier0_checks(spark, d):
    """T-02: all gates."""
    return spark.createDataFrame([(c["check"], float(c["value"]), c["level"], bool(c["passed"])) for c in _tier0(spark, d)[1]], "check string, value double, level string, passed boolean")


@query(f"WITH {HOURLY}, g AS (" + " UNION ALL ".join(f"SELECT '{t}' AS grp, avg(CASE WHEN {_REF} THEN CAST(\"{t}\" = 0 AS INTEGER) END) AS a, avg(CASE WHEN {_TEST} THEN CAST(\"{t}\" = 0 AS INTEGER) END) AS b FROM hourly" for t in TYPES) + ") SELECT grp AS \"group\", round(a, 4) AS zero_rate_ref, round(b, 4) AS zero_rate_test, round(b - a, 4) AS delta_pp, CASE WHEN abs(b - a) > 0.15 THEN 'fail' WHEN abs(b - a) > 0.05 THEN 'warn' ELSE 'ok' END AS level FROM g")
def tier0_groups(spark, d):
    """T-02, A-09: the table of groups."""
    return spark.createDataFrame([tuple(g.values()) for g in _tier0(spark, d)[2]], "group string, zero_rate_ref double, zero_rate_test double, delta_pp double, level string")


@query("WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS sparse, (p_partkey % 23) / 100.0 AS z, CAST(p_partkey % 61 - 30 AS DOUBLE) AS med, (p_partkey % 41) / 100.0 AS ks, (p_partkey % 83) / 100.0 AS rd FROM part) SELECT p_partkey, CASE WHEN abs(z) >= 0.10 THEN 'data_quality' WHEN sparse THEN 'sparse' WHEN abs(med) >= 25 AND (ks >= 0.35 OR rd >= 0.70) THEN 'investigate' WHEN abs(med) >= 25 OR ks >= 0.20 OR rd >= 0.40 THEN 'watch' ELSE 'stable' END AS drift_class FROM f")
def tier1_classes(spark, d):
    """T-07: effect sizes made from part keys, so that every class comes up."""
    k = F.col("p_partkey")
    cls = drift.drift_class(sparse=F.col("p_size") % 2 == 0, zero_delta=(k % 23) / 100.0, median_shift=(k % 61 - 30).cast("double"), ks=(k % 41) / 100.0, robust_d=(k % 83) / 100.0)
    return read(spark, d, "part").select("p_partkey", cls.alias("drift_class"))


@query()
def drift_report(spark, d):
    """T-01, T-08, N-12: the monitor's table of features over the whole hourly frame. tests/test_catalogue.py holds it against NumPy."""
    h = hourly(spark, d).withColumnsRenamed({t: f"value_{t}" for t in TYPES})
    names = [f"value_{t}" for t in TYPES]
    return drift.monitor(h, timestamp_col="hour", features=names, groups=list(TYPES), metrics=["value"], ref=("2024-01-01", "2024-01-14"), test=("2024-01-15", "2024-01-30"), order_by="hour")[1]


# Evaluation


@query("WITH e AS (SELECT value > 50 AS h, event_type = 'error' AS t FROM events), n AS (SELECT CAST(sum(CASE WHEN h AND t THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN h AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT h AND t THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN NOT h AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM e) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n")
def confusion_at_threshold(spark, d):
    """A-18, P-06."""
    return rounded(evaluation.confusion(lines(spark, d), "value", "label", 50.0), "precision", "recall", "f1")


@query("WITH s AS (SELECT value AS score, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS t, count(*) AS n FROM events GROUP BY 1), c AS (SELECT score, sum(t) OVER (ORDER BY score DESC) AS tp, sum(n - t) OVER (ORDER BY score DESC) AS fp, lead(score) OVER (ORDER BY score DESC) AS nx FROM s), p AS (SELECT sum(t) AS pos FROM s) SELECT round((score + nx) / 2, 6) AS threshold, round(2 * tp / (tp + fp + pos), 6) AS f1 FROM c, p WHERE nx IS NOT NULL ORDER BY 2 * tp / (tp + fp + pos) DESC, score DESC LIMIT 1")
def threshold_selector(spark, d):
    """A-20, E-07."""
    return rounded(evaluation.threshold_selector(lines(spark, d), "value", "label"), "threshold", "f1")


@query("WITH s AS (SELECT value AS score, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS f FROM events GROUP BY 1), c AS (SELECT *, sum(f) OVER (ORDER BY score) AS cf FROM s) SELECT round(sum(t * (cf - f / 2.0)) / (sum(t) * sum(f)), 6) AS auc FROM c")
def roc_auc(spark, d):
    """A-19."""
    return rounded(evaluation.roc_auc(lines(spark, d), "value", "label"), "auc")


@query("WITH s AS (SELECT value AS score, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS f FROM events GROUP BY 1), n AS (SELECT sum(t) AS p, sum(f) AS q FROM s) SELECT round(score, 6) AS score, round(sum(t) OVER (ORDER BY score DESC) / p, 6) AS tpr, round(sum(f) OVER (ORDER BY score DESC) / q, 6) AS fpr FROM s, n")
def roc_curve(spark, d):
    """A-19."""
    return rounded(evaluation.roc_curve(lines(spark, d), "value", "label"), "score", "tpr", "fpr")


@query("SELECT user_id, round(max(value), 6) AS max_score, count(*) AS n_windows, CAST(max(value) > 150 AS INTEGER) AS anomaly FROM events GROUP BY 1")
def max_window_verdict(spark, d):
    """A-17, E-08."""
    return rounded(scoring.verdicts(events(spark, d), group="user_id", score="value", threshold=150.0), "max_score")


@query("SELECT round(quantile_cont(value, 0.99), 6) AS q99, round(quantile_cont(value, 0.999), 6) AS q999, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS far FROM events")
def tail_quantiles(spark, d):
    """E-04, A-10."""
    e = events(spark, d)
    q99, q999 = stats.quantiles(e, {"value": F.col("value")}, [0.99, 0.999])["value"]
    return rounded(evaluation.far_at(e, "value", 100.0).select(F.lit(q99).alias("q99"), F.lit(q999).alias("q999"), "far"), "q99", "q999", "far")


@query("SELECT round(avg(CASE WHEN value > 75 THEN 1.0 ELSE 0.0 END), 6) AS far FROM events")
def far_at_threshold(spark, d):
    """E-04."""
    return rounded(evaluation.far_at(events(spark, d), "value", 75.0), "far")


@query("SELECT round(avg(q), 6) AS mean_quantile FROM (SELECT quantile_cont(value, 0.9) AS q FROM events GROUP BY user_id)")
def mean_batch_quantile(spark, d):
    """M-21."""
    return rounded(scoring.mean_of_batch_quantiles(events(spark, d), batch="user_id", score="value", q=0.9), "mean_quantile")


@query()
def evt_calibration(spark, d):
    """E-01 .. E-06: the threshold for one false alarm in a thousand; a row of nulls where there are no more than 1000 scores to learn
    from. tests/test_catalogue.py holds it against NumPy."""
    e = lines(spark, d)
    normal = e.filter("label = 0")
    c = evaluation.calibrated(normal, normal, "value", alpha=1e-3, anomalous=e.filter("label = 1")) if normal.limit(1001).count() > 1000 else None
    row = (None,) * 6 if c is None else (c.candidate.tail.u, c.candidate.tail.shape, c.candidate.tail.scale, c.candidate.threshold, c.candidate.far, c.recall)
    return spark.createDataFrame([row], "u double, shape double, scale double, threshold double, far double, recall double")


# Scoring


def _cells(spark, d):
    """Days as windows of hours, event types as features: target is the sum, reconstruction the type's mean."""
    h = hourly(spark, d)
    mean = h.agg(*(F.avg(t).alias(f"m_{t}") for t in TYPES))
    rows = h.crossJoin(F.broadcast(mean))  # one row
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(t).alias("target"), F.col(f"m_{t}").alias("recon")) for i, t in enumerate(TYPES))))
    return rows.select(F.to_date("hour").alias("window_id"), F.hour("hour").alias("step"), pairs.alias("x")).select("window_id", "step", "x.*")


_CELLS = f"WITH {HOURLY}, cells AS (" + " UNION ALL ".join(f'SELECT CAST(hour AS DATE) AS window_id, CAST(extract(hour FROM hour) AS INTEGER) AS step, {i} AS feature, "{t}" AS target, (SELECT avg("{t}") FROM hourly) AS recon FROM hourly' for i, t in enumerate(TYPES)) + ")"


@query(_CELLS + " SELECT window_id, round(avg((target - recon) * (target - recon)), 6) AS mse FROM cells GROUP BY 1")
def mse_window(spark, d):
    """M-10."""
    return rounded(scoring.pooled_mse(_cells(spark, d)), "mse")


@query(_CELLS + ", live AS (SELECT window_id, step FROM cells GROUP BY 1, 2 HAVING max(CASE WHEN target <> 0 THEN 1 ELSE 0 END) = 1) SELECT window_id, round(avg(abs(target - recon)) + 1e-8, 6) AS score FROM cells JOIN live USING (window_id, step) GROUP BY 1")
def masked_reduce(spark, d):
    """M-01 .. M-04, Q-16, Q-24."""
    return rounded(scoring.window_scores(_cells(spark, d), kind="mae"), "score")


@query(_CELLS + " SELECT window_id, step, round(avg((target - recon) * (target - recon)) + 1e-8, 6) AS score FROM cells WHERE feature <> 4 GROUP BY 1, 2")
def step_scores(spark, d):
    """M-03, M-04."""
    return rounded(scoring.window_scores(_cells(spark, d), aggregate="step", masked=False, skip_features=[4]), "score")


@query(_CELLS + ", m AS (SELECT window_id, feature, avg((target - recon) * (target - recon)) AS mse FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY mse DESC, feature) AS rank, sum(mse) OVER (PARTITION BY window_id) AS s FROM m) SELECT window_id, CAST(rank AS INTEGER) AS rank, feature, round(mse, 6) AS mse, round(100 * mse / (s + 1e-12), 6) AS contribution_percent FROM r WHERE rank <= 3")
def ranked_mse(spark, d):
    """M-11, O-04, W-14: a top-3 report of each window."""
    m = scoring.mse_by_feature(_cells(spark, d))
    return rounded(scoring.ranked_mse(m, window="window_id", feature="feature", top_k=3), "mse", "contribution_percent")


@query("WITH q AS (SELECT quantile_cont(value, 0.96) AS q FROM events) SELECT event_id, CASE WHEN value > (SELECT quantile_cont(value, 0.999) FROM events) THEN 0.0 ELSE value END AS weight, value > q AS masked FROM events, q")
def sampling_weights(spark, d):
    """M-19, M-20."""
    w = scoring.sampling_weights(events(spark, d), "value")
    return scoring.softmax_masking(w, "value").select("event_id", "weight", "masked")


@query()
def metric_inference(spark, d):
    """M-08, M-10, M-13, P-13, F-10, W-09: windows of a day over the hourly frame with a bidirectional model of metrics and
    times. tests/test_catalogue.py holds it against NumPy."""
    h = hourly(spark, d)
    verdict, _ = metrics.inferred(h, timestamp_col="hour", metric_columns=list(TYPES), scaler=scaling.Scaler("custom").fit(h, list(TYPES)), model=scoring.MetricLSTM.random(len(TYPES) + 2, 4, times=2), threshold=0.5, window_size=24, periods={"day": 86_400})
    return verdict


@query(f"WITH {HOURLY}, w AS (SELECT hour, lead(hour, 23) OVER (ORDER BY hour) AS window_ts, {', '.join(f'list(\"{t}\") OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS \"{t}\"' for t in TYPES)} FROM hourly) SELECT window_ts, round(({' + '.join(f'list_var_pop(\"{t}\")' for t in TYPES)}) / 5, 4) AS mse, CAST(({' + '.join(f'list_var_pop(\"{t}\")' for t in TYPES)}) / 5 > 1000 AS SMALLINT) AS predicted FROM w WHERE window_ts IS NOT NULL")
def metric_inference_mean(spark, d):
    """M-08 with the mean of each window as reconstruction."""
    verdict, _ = metrics.inferred(hourly(spark, d), timestamp_col="hour", metric_columns=list(TYPES), scaler=None, model=scoring.MeanReconstructor(), threshold=1000.0, window_size=24)
    return rounded(verdict, "mse", digits=4)


# Logs


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY f) AS BIGINT) AS template_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")
def template_ids(spark, d):
    """L-05 .. L-11, J-08: templates of all lines. Masked lines of a type are alike, and types part at the first token of the tree."""
    e = lines(spark, d)
    miner = TemplateMiner(MinerConfig(rules=[(r"\d+\.\d+", "<FLOAT>"), (r"\d+", "<NUM>")])).fit(e, "message", "event_id", distinct="masked")
    return miner.predict(e, "message").select("event_id", "template_id")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY f) AS BIGINT) AS template_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")
def template_ids_by_type(spark, d):
    """L-06, L-07: masked lines differ in their first word alone, so that templates are event types in the order of their coming."""
    e = lines(spark, d)
    miner = TemplateMiner(MinerConfig(similarity=0.9, rules=[(r"\d+\.\d+", "FLOAT"), (r"\d+", "NUM")])).fit(e, "message", "event_id", distinct="masked")
    return miner.predict(e, "message").select("event_id", "template_id")


@query(f"WITH {INCIDENTS}, k AS (SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM incidents i WHERE e.ts BETWEEN i.event_start AND i.event_end)), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts, event_type || ' user ' || user_id || ' value ' || value ORDER BY ts, event_id) AS dup FROM k) WHERE dup = 1), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index FROM u), g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY index)) // 1000000 AS gap FROM x), s AS (SELECT *, sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS session FROM g), w AS (SELECT user_id, session, index, list(index) OVER (PARTITION BY user_id, session ORDER BY index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM s) SELECT user_id, CAST(session AS BIGINT) AS session, CAST(index AS BIGINT) AS first_position, array_to_string(l, ',') AS positions FROM w WHERE len(l) = 3")
def log_windows(spark, d):
    """L-15: lines outside incidents, in windows of three within sessions of a node."""
    _, w = logs.prepared(lines(spark, d), incidents(spark, d), datetime_column="ts", logs_column="message", order_by=list(KEY), partition_by="user_id", delta_thr=43_200, sequence_length=3)
    return w.select("user_id", "session", "first_position", F.array_join("window", ",").alias("positions"))


@query()
def block_verdicts(spark, d):
    """M-06, M-07, A-17: users as blocks, scored by a model over template vectors. tests/test_catalogue.py holds it against NumPy."""
    e = lines(spark, d)
    miner = TemplateMiner(MinerConfig(similarity=0.9, rules=[(r"\d+\.\d+", "FLOAT"), (r"\d+", "NUM")])).fit(e, "message", "event_id", distinct="masked")
    return logs.block_verdicts(e, miner, block="user_id", message="message", line_id="event_id", length=10, model=scoring.MeanReconstructor(), threshold=0.1)


@query("WITH c AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings), p AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m, var_pop(CAST(x AS DOUBLE)) AS v, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT d, sum(v * n) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, count(*) AS k, sum(n) AS n FROM p GROUP BY 1) SELECT round(sum(b) * (max(n) - max(k)) / (sum(w) * (max(k) - 1)), 6) AS score FROM t")
def calinski_harabasz_score(spark, d):
    """L-13."""
    return rounded(calinski_harabasz(read(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "label", "embedding"), "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and windows of each user's stream."""
    return session_windows(spark, sf_dir)


import tidemark.queries_more  # noqa: E402, F401 - registers the queries of sources, sinks and small operators

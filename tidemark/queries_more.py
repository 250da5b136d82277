"""Queries of sources, sinks and small operators. What they write goes to the shared folder and is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import rules, stats, text
from tidemark.operators import frame, joins, order, scaling, scoring, windows
from tidemark.operators.templates import MinerConfig, TemplateMiner, messages_of
from tidemark.plans import drift
from tidemark.queries import KEY, TYPES, events, hourly, lines, query, read, rounded
from tidemark.runtime import run_name
from tidemark.sources import tables
from tidemark.sources.shared import shared_dir, written
from tidemark.streaming import online


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT fmt, event_id, ts, round(value, 6) AS value FROM events, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS fmt)")
def format_round_trip(spark, d):
    """S-02 .. S-04: written and read again in each format, times parsed by date_columns."""
    e = events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value")
    out = []
    for fmt in ("csv", "json", "orc", "parquet"):
        at = folder(spark, fmt)
        more = {"header": "true"} if fmt == "csv" else {}
        tables.save(e, at, fmt, **more)
        back = tables.load(spark, at, fmt, date_columns=["ts"], date_format="yyyy-MM-dd HH:mm:ss.SSSSSS", **more)
        out.append(back.select(F.lit(fmt).alias("fmt"), F.col("event_id").cast("long").alias("event_id"), "ts", F.round(F.col("value").cast("double"), 6).alias("value")))
    return frame.union_all(*out)


@query("SELECT k, CAST(v * 2 AS DOUBLE) AS v FROM (VALUES (1, 1.5), (2, 2.5), (3, NULL)) t(k, v)")
def created_frame(spark, d):
    """S-03: a frame from columns."""
    return tables.create(spark, {"k": [1, 2, 3], "v": [1.5, 2.5, None]}, "k int, v double").withColumn("v", F.col("v") * 2)


@query("SELECT name, (SELECT count(*) FROM nation) AS rows FROM (VALUES ('dataset_0.parquet'), ('dataset_1.parquet'), ('dataset_2.parquet')) t(name)")
def numbered_saves(spark, d):
    """S-05, S-18: three saves under one name."""
    at, n = folder(spark, "numbered"), read(spark, d, "nation")
    paths = [tables.save_next(n, at) for _ in range(3)]
    assert tables.matching_files(spark, at, "dataset_*.parquet") == [p.rsplit("/", 1)[1] for p in paths]
    return frame.union_all(*(spark.read.parquet(p).agg(F.count("*").alias("rows")).select(F.lit(p.rsplit("/", 1)[1]).alias("name"), "rows") for p in paths))


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS line_id, event_type || ' user ' || user_id AS raw FROM events")
def raw_log_lines(spark, d):
    """S-06: a text file and the places of its lines; one file, as places are counted by file."""
    at = folder(spark, "lines")
    events(spark, d).select("event_id", F.concat(F.col("event_type"), F.lit(" user "), F.col("user_id")).alias("value")).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(at)
    return tables.read_lines(spark, at).select("line_id", "raw")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source, o_orderstatus AS \"Label\" FROM orders")
def label_file(spark, d):
    """S-07."""
    at = folder(spark, "labels")
    read(spark, d, "orders").select(F.col("o_orderkey").alias("BlockId"), F.col("o_orderstatus").alias("Label")).write.csv(at, header=True)
    return tables.read_labels(spark, at).select("source", "Label")


@query("SELECT 'events' AS name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def footer_row_counts(spark, d):
    """S-02, S-08: by file, no column is read."""
    files = tables.row_counts(spark, [f"{d}/events.parquet", f"{d}/orders.parquet"]).withColumn("name", F.regexp_extract("file", r"(events|orders)\.parquet", 1))
    return files.groupBy("name").agg(F.sum("rows").alias("rows"))


@query("SELECT event_type, count(*) AS n, TRUE AS in_order FROM events GROUP BY 1")
def grouped_files(spark, d):
    """S-09: one folder for each group, rows sorted within files."""
    at = folder(spark, "grouped")
    tables.save_grouped(events(spark, d), at, partition_by=["event_type"], sort_by=["ts", "event_id"])
    back = spark.read.parquet(at).select("event_type", F.col("_metadata.file_path").alias("f"), "ts", "event_id", F.monotonically_increasing_id().alias("m"))
    from pyspark.sql import Window

    w = Window.partitionBy("f").orderBy("m")
    late = back.withColumn("late", F.struct("ts", "event_id") < F.lag(F.struct("ts", "event_id")).over(w))
    return late.groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if("late") == 0).alias("in_order"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(len(embedding)) AS BIGINT) AS cells, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 3) AS total FROM embeddings")
def matrix_sink(spark, d):
    """S-04, S-10, S-11, S-16: a matrix as a table, stacked again from two parts."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    a, b = folder(spark, "matrix"), folder(spark, "matrix")
    tables.save_matrix(v.filter("vec_id % 2 = 0"), a, "x")
    tables.save_matrix(v.filter("vec_id % 2 <> 0"), b, "x")
    x = tables.stacked(spark, [a, b], "x")
    return rounded(x.agg(F.count("*").alias("rows"), F.sum(F.size("x")).cast("long").alias("cells"), F.sum(F.aggregate("x", F.lit(0.0), lambda s, y: s + y)).alias("total")), "total", digits=3)


@query("WITH n AS (SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b), p AS (SELECT unnest(range(40)) AS position) SELECT position, CASE WHEN position < a THEN 'nation' WHEN position < a + b THEN 'region' ELSE '' END AS name, CASE WHEN position < a THEN position WHEN position < a + b THEN position - a ELSE -1 END AS \"row\" FROM p, n")
def row_locations(spark, d):
    """S-12: where rows of two tables, one after another, lie."""
    at = tables.row_locations(spark, [f"{d}/nation.parquet", f"{d}/region.parquet"], spark.range(40).withColumnRenamed("id", "position"))
    return at.select("position", F.regexp_extract("file", r"(nation|region)\.parquet", 1).alias("name"), "row")


@query("WITH w AS (SELECT n_nationkey AS window_id, unnest([n_regionkey, n_regionkey + 1]) AS k, unnest([0, 1]) AS p FROM nation) SELECT window_id, CAST(p AS INTEGER) AS slot, round(CAST(len(r_name) AS DOUBLE), 6) AS a FROM w LEFT JOIN region ON r_regionkey = k")
def window_loader(spark, d):
    """S-13, M-15: windows and vectors from a table each; a slot without a vector has null."""
    w, v = folder(spark, "windows"), folder(spark, "vectors")
    read(spark, d, "nation").select(F.col("n_nationkey").alias("window_id"), F.array(F.col("n_regionkey"), F.col("n_regionkey") + 1).alias("ids")).write.parquet(w)
    read(spark, d, "region").select(F.col("r_regionkey").alias("template_id"), F.array(F.length("r_name").cast("double")).alias("vector")).write.parquet(v)
    rows = tables.load_windows(spark, w, v)
    return rows.select("window_id", F.posexplode("vectors").alias("slot", "x")).select("window_id", "slot", F.col("x")[0].alias("a"))


@query("SELECT DISTINCT text AS anchor, text AS positive FROM conversations WHERE text IS NOT NULL")
def training_texts(spark, d):
    """S-14."""
    return tables.load_training_texts(spark, f"{d}/conversations.parquet")


@query("SELECT 'study' AS study, 5 AS features, 25 AS investigate_pct")
def report_files(spark, d):
    """S-15, S-17, T-10, C-20: a report and its thresholds through a file."""
    at = f"{folder(spark, 'report')}/report.json"
    drift.write_report({"study": "study", "features": len(TYPES), "thresholds": drift.THRESHOLDS}, at)
    r = tables.load_json(at)
    return spark.createDataFrame([(r["study"], r["features"], int(r["thresholds"]["median_shift_investigate_pct"]))], "study string, features int, investigate_pct int")


@query("SELECT CAST(event_id AS VARCHAR) AS key, '{\"rank_1_feature_name\":\"' || event_type || '\"}' AS value FROM events")
def payload_rows(spark, d):
    """S-19: as message sinks take them."""
    e = events(spark, d)
    return online.payloads(e.withColumn("document", F.to_json(F.struct(F.col("event_type").alias("rank_1_feature_name")))), "event_id")


# Small operators


@query("SELECT feature, CASE WHEN feature LIKE '%_click' THEN 'click' WHEN feature LIKE '%_view' THEN 'view' ELSE 'unknown' END AS grp, feature IN ('value_click', 'value_view') AS held FROM (VALUES ('value_click'), ('count_click'), ('value_view'), ('count_view'), ('other')) t(feature)")
def feature_names(spark, d):
    """F-01, F-10 .. F-12: names by group, which of them a frame has."""
    h = hourly(spark, d).withColumnsRenamed({t: f"value_{t}" for t in TYPES})
    names = [*frame.grouped_feature_columns(["value", "count"], ["click", "view"]), "other"]
    ordered = frame.ordered_features(h, names).columns
    assert ordered == ["value_click", "value_view"]
    return spark.createDataFrame([(n, frame.feature_group(n, ["click", "view"]), frame.isin_schema(h, column=n)) for n in names], "feature string, grp string, held boolean")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def fixed_arrays(spark, d):
    """F-05, C-18."""
    v = frame.lists_to_arrays(read(spark, d, "embeddings"), "embedding", 64)
    return rounded(v.select("vec_id", F.size("embedding").alias("n"), F.col("embedding")[0].alias("first")), "first")


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND value < 100 AND event_id % 7 <> 0")
def finite_rows(spark, d):
    """P-06, P-10: with every seventh value not a number, and an infinite one for each over 100."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("value") >= 100, F.lit(float("inf"))).otherwise(F.col("value"))
    return frame.finite(events(spark, d).withColumn("value", v), "value").select("event_id")


@query("WITH w AS (SELECT event_id, list(CASE WHEN event_type = 'error' THEN -1 ELSE event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM events) SELECT event_id, array_to_string(l, ',') AS ids FROM w WHERE len(l) = 3 AND NOT list_contains(l, -1)")
def matched_windows(spark, d):
    """P-09, P-11."""
    e = events(spark, d).withColumn("id", F.when(F.col("event_type") == "error", -1).otherwise(F.col("event_id")))
    w = frame.all_full(windows.forward_windows(e, "id", 3, order_by=KEY, partition_by="user_id", output=["w"]), ["w"], 3)
    return frame.without_unmatched(w, "w").select("event_id", F.array_join("w", ",").alias("ids"))


@query("SELECT event_id, event_type FROM events ORDER BY event_type DESC, ts, event_id LIMIT 25")
def stable_head(spark, d):
    """O-01 .. O-03: the first rows of a stable sort."""
    e = events(spark, d)
    return order.first_rows(order.stable_sort(e, [F.desc("event_type")], KEY), 25, [F.desc("event_type"), *KEY]).select("event_id", "event_type")


@query("SELECT user_id, list_aggregate(list(event_type ORDER BY f, event_type), 'string_agg', ',') AS types FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def list_distinct(spark, d):
    """O-07: each user's event types, in the order in which they first come."""
    e = events(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return order.list_distinct(frame.aggregates_to_list(e, "user_id", ["event_type"], "o"), "event_type").select("user_id", F.array_join("event_type", ",").alias("types"))


@query("SELECT CAST(0 AS BIGINT) AS torn, count(*) AS rows, TRUE AS all_named FROM events")
def routed_rows(spark, d):
    """O-12: rows of a user are in one split, and every row is in one."""
    r = order.hash_split(events(spark, d), "user_id", {"train": 0.8, "val": 0.1, "test": 0.1})
    torn = r.groupBy("user_id").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    return torn.crossJoin(r.agg(F.count("*").alias("rows"), F.bool_and(F.col("split").isin("train", "val", "test")).alias("all_named")))  # one row each


@query("SELECT event_id, to_timestamp(epoch_us(ts) // 1000000)::TIMESTAMP AS at, event_type <> 'view' AS labelled, CAST(len(string_split(event_type || ' user ' || user_id, ' ')) AS INTEGER) AS n_tokens, ts - INTERVAL 90 SECOND AS before FROM events")
def log_fields(spark, d):
    """C-06 .. C-08, C-17."""
    e = events(spark, d).withColumn("epoch", F.floor(windows.micros("ts") / 1_000_000))
    message = F.concat(F.lit(" "), F.col("event_type"), F.lit("  user\t"), F.col("user_id"), F.lit(" "))
    return e.select("event_id", text.from_epoch("epoch").cast("timestamp_ntz").alias("at"), text.is_labelled("event_type", "view").alias("labelled"), F.size(text.tokens(message)).alias("n_tokens"), text.shifted("ts", -90).alias("before"))


@query("SELECT 'fit_20240102_030405_ab' AS name")
def run_names(spark, d):
    """C-21, X-10: of a given time and mark; without them they differ from run to run."""
    import datetime as dt

    assert run_name() != run_name()
    return spark.createDataFrame([(run_name("fit", dt.datetime(2024, 1, 2, 3, 4, 5), "ab"),)], "name string")


_HOURLY_ALL = "hourly AS (SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"coalesce(sum(CASE WHEN event_type = '{t}' THEN value END), 0.0) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1)"


@query(f"WITH {_HOURLY_ALL}, p AS (SELECT min(click) AS a, max(click) AS b, quantile_cont(error, 0.5) AS m, quantile_cont(error, 0.75) - quantile_cont(error, 0.25) AS q FROM hourly) SELECT hour, round((click - a) / (b - a), 6) AS click, round((error - m) / CASE WHEN q = 0 THEN 1 ELSE q END, 6) AS error FROM hourly, p")
def scale_by_column(spark, d):
    """N-01, N-07, N-12, A-12: a scaler for each column, through their saved form."""
    h = hourly(spark, d).select("hour", "click", "error")
    _, fitted = scaling.scale(h, ["click", "error"], per_column={"error": "robust"})
    frozen = {k: scaling.Scaler.from_json(s.to_json()) for k, s in fitted.items()}
    return rounded(scaling.scale(h, ["click", "error"], per_column={"error": "robust"}, fitted=frozen)[0].select("hour", "click", "error"), "click", "error")


@query("WITH q AS (SELECT event_type, quantile_cont(CASE WHEN event_id % 2 = 0 THEN value END, [0.25, 0.5, 0.75]) AS a, quantile_cont(CASE WHEN event_id % 2 = 1 THEN value END, 0.5) AS b FROM events GROUP BY 1) SELECT event_type, round((b - a[2]) / (a[3] - a[1]), 6) AS robust_d, CAST(NULL AS DOUBLE) AS none FROM q")
def robust_distances(spark, d):
    """T-05, A-10."""
    even, odd = (F.when(F.col("event_id") % 2 == r, F.col("value")) for r in (0, 1))
    q = events(spark, d).groupBy("event_type").agg(stats.quantile(even, [0.25, 0.5, 0.75]).alias("a"), stats.quantile(odd, 0.5).alias("b"))
    return rounded(q.select("event_type", stats.robust_d(F.col("a")[1], F.col("b"), F.col("a")[2] - F.col("a")[0]).alias("robust_d"), stats.robust_d(F.col("a")[1], F.col("b"), F.lit(0.0)).alias("none")), "robust_d")


@query("SELECT round(v * (1 + greatest(0.0, m / t - 1)), 6) AS error FROM (SELECT avg(value) AS v, avg(CASE WHEN event_type = 'error' THEN value END) AS m, avg(CASE WHEN event_type = 'view' THEN value END) AS t FROM events)")
def validation_errors(spark, d):
    """M-23."""
    r = events(spark, d).agg(F.avg("value"), F.avg(F.when(F.col("event_type") == "error", F.col("value"))), F.avg(F.when(F.col("event_type") == "view", F.col("value")))).first()
    return rounded(spark.createDataFrame([(scoring.validation_error(*r),)], "error double"), "error")


_RAW = "'Receiving block blk_' || CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END || event_id || ' src: /10.0.' || (event_id % 200) || '.7:50010 0x' || user_id || 'f status[' || user_id || ']'"


@query(f"SELECT event_id, regexp_replace(regexp_replace({_RAW}, '/?(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}(?::\\d{{2,5}})?', '<IP>', 'g'), 'blk_(|-)[0-9]+', '<blk_>', 'g') AS hdfs, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_RAW}, '/[^\\s]+', '<PATH>', 'g'), '0x[0-9a-fA-F]+', '<ADDRESS>', 'g'), '\\[\\d+\\]', '[<NUM>]', 'g'), '\\b[0-9a-fA-F]{{6,}}\\b', '<HEX>', 'g'), '\\b\\d+\\b', '<NUM>', 'g'), '\\b[a-zA-Z]+[0-9][a-zA-Z0-9]*\\b', '<ALNUM>', 'g') AS thunderbird FROM events")
def rule_sets(spark, d):
    """L-04: published rules over lines of their kind."""
    k, u = F.col("event_id"), F.col("user_id")
    raw = F.concat(F.lit("Receiving block blk_"), F.when(k % 2 == 0, "-").otherwise(""), k, F.lit(" src: /10.0."), k % 200, F.lit(".7:50010 0x"), u, F.lit("f status["), u, F.lit("]"))
    return events(spark, d).select("event_id", text.masked(raw, rules.HDFS).alias("hdfs"), text.masked(raw, rules.RULES["thunderbird"]).alias("thunderbird"))


@query("SELECT count(*) AS n, count(DISTINCT event_type) AS distinct_messages, 'frame' AS kind FROM events UNION ALL SELECT count(*), count(DISTINCT event_type), 'path' FROM events UNION ALL SELECT 3, 2, 'list'")
def message_inputs(spark, d):
    """L-01: the inputs that a fit takes."""
    e = events(spark, d).select(F.col("event_type").alias("message"))
    made = {"frame": messages_of(spark, e), "path": messages_of(spark, written(e, "messages").inputFiles()), "list": messages_of(spark, ["a", "b", "a"])}
    return frame.union_all(*(f.agg(F.count("*").alias("n"), F.countDistinct("message").alias("distinct_messages")).withColumn("kind", F.lit(k)) for k, f in made.items()))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'known' ELSE 'online' END AS origin FROM events")
def online_fit(spark, d):
    """L-12, L-14: a miner that saw two types, saved and loaded, fits the lines that it does not know."""
    e = lines(spark, d)
    config = MinerConfig(similarity=0.9, rules=[(r"\d+\.\d+", "FLOAT"), (r"\d+", "NUM")])
    at = f"{folder(spark, 'miner')}/tree.json"
    TemplateMiner(config).fit(e.filter(F.col("event_type").isin("click", "view")), "message", "event_id").save(at)
    miner = TemplateMiner.load(at)
    known = len(miner.templates())
    out = miner.fit_online(e, "message", "event_id").predict(e, "message")
    return out.select("event_id", F.when(F.col("template_id") < 1, "none").when(F.col("template_id") <= known, "known").otherwise("online").alias("origin"))


@query("SELECT a.n_nationkey AS \"left\", b.n_nationkey AS \"right\", round(1 - list_cosine_similarity([a.n_regionkey + 1.0, a.n_nationkey + 0.5], [b.n_regionkey + 1.0, b.n_nationkey + 0.5]), 6) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def pairwise_cosine_blocks(spark, d):
    """J-09: all pairs, by blocks of seven."""
    v = read(spark, d, "nation").select("n_nationkey", F.array(F.col("n_regionkey") + 1.0, F.col("n_nationkey") + 0.5).alias("v"))
    return rounded(joins.pairwise_cosine(v, key="n_nationkey", vector="v", block=7), "distance")


@query("SELECT CAST(sum(w.kl) AS BIGINT) AS zero, count(*) AS rows FROM (SELECT 0 AS kl FROM region) w")
def latent_divergence(spark, d):
    """M-14: a latent that is standard normal diverges by nothing."""
    import numpy as np

    n = read(spark, d, "region").count()
    kl = scoring.divergence(np.zeros((n, 4)), np.zeros((n, 4)))
    return spark.createDataFrame([(int(abs(kl).sum()), n)], "zero long, rows long")

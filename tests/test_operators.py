"""Literal cases: small frames whose results are known."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.operators import evaluation, frame, joins, order, scaling, scoring, windows
from tidemark.operators.templates import MinerConfig, TemplateMiner, TemplateTree
from tidemark.plans import drift, logs, metrics
from tidemark.sources import tables


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def frame_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_group_lists_keep_order_and_nulls(spark):
    df = frame_of(spark, [("A", 2, 0), ("A", 1, 1), ("B", 3, 2), ("B", None, 3), ("B", 1, 4)], "g string, v long, o long")
    assert {r.g: r.v for r in frame.aggregates_to_list(df, "g", ["v"], "o").collect()} == {"A": [2, 1], "B": [3, None, 1]}


def test_rolling_sum_over_ten_second_series(spark):
    df = frame_of(spark, [(at(0), 1), (at(10), 2), (at(20), 3)], "date_time timestamp_ntz, value long")
    got = windows.centered_rolling_sum(df, column="value", safe_range=10, partition_by=windows.WHOLE).orderBy("date_time").collect()
    assert [r["count"] for r in got] == [3, 5, 3]


def test_forward_windows_are_short_at_the_end(spark):
    df = frame_of(spark, [(i,) for i in range(1, 6)], "v long")
    got = windows.forward_windows(df, "v", 3, order_by="v", partition_by=windows.WHOLE).orderBy("v").collect()
    assert [r.v_sliding_window for r in got] == [[1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5], [5]]
    assert windows.forward_windows(df, "v", 3, order_by="v", partition_by=windows.WHOLE, filter_valid_rows=True).count() == 3


def test_gaps_at_the_threshold_stay_together(spark):
    df = frame_of(spark, [(at(0),), (at(5.9),), (at(12),)], "t timestamp_ntz")
    got = windows.gap_groups(df, column="t", out_column="g", threshold=5, order_by="t", partition_by=windows.WHOLE).orderBy("t").collect()
    assert [r.g for r in got] == [0, 0, 1]


def test_unknown_unit(spark):
    with pytest.raises(ValueError):
        windows.time_delta(spark.range(1), column="id", out_column="d", order_by="id", partition_by=windows.WHOLE, time_unit="week")


def test_split_intervals_by_closed_ends(spark):
    df = frame_of(spark, [(at(0), at(10), 1), (at(5), at(5), 2), (at(9), at(3), 3)], "s timestamp_ntz, e timestamp_ntz, k long")
    n = lambda closed: {r.k: r.n for r in windows.split_intervals(df, start="s", end="e", safe_range=5, closed=closed).groupBy("k").agg(F.count("s").alias("n")).collect()}
    assert n("left") == {1: 2, 2: 0, 3: 0}
    assert n("both") == {1: 3, 2: 1, 3: 0}
    assert n("none") == {1: 1, 2: 0, 3: 0}


def test_windows_in_sessions(spark):
    df = frame_of(spark, [(0, at(0)), (1, at(1)), (2, at(2)), (3, at(60))], "index long, t timestamp_ntz")
    got = windows.generate_windows(df, column="t", order_by="index", partition_by=windows.WHOLE, delta_thr=10, sequence_length=2)
    assert sorted(r.window for r in got.collect()) == [[0, 1], [1, 2]]
    padded = windows.generate_windows(df, column="t", order_by="index", partition_by=windows.WHOLE, delta_thr=10, sequence_length=2, force_padding_with_values=True, padding_constant=-1)
    assert [3, -1] in [r.window for r in padded.collect()]


def test_row_index_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("k", F.hash("id"))
    got = order.with_row_index(df, ["k", "id"]).orderBy("k", "id").select("index").collect()
    assert [r[0] for r in got] == list(range(5000))


def test_running_totals_over_many_partitions(spark):
    df = spark.range(0, 1000, 1, 5).select((F.col("id") % 37).alias("x"), F.lit(1).alias("a"))
    got = {r.x: r.n for r in order.running_totals(df, "x", {"n": "a"}).collect()}
    counts = np.bincount(np.arange(1000) % 37).cumsum()
    assert got == {i: int(c) for i, c in enumerate(counts)}


def test_regex_groups_and_white_space(spark):
    df = frame_of(spark, [("ab12cd34ef", "\t x \n")], "t string, w string")
    row = text.replaced(df, column="t", pattern=r"(\d)(\d)", replacement="${2}${1}").select("t_mapped", text.stripped("w").alias("w")).first()
    assert (row.t_mapped, row.w) == ("ab21cd43ef", "x")
    assert text.grouped_rules([("a", "X"), ("b", "Y"), ("c", "X")]) == [("a", "X"), ("c", "X"), ("b", "Y")]


def test_incident_modes(spark):
    df = frame_of(spark, [(at(s), f"m{s}") for s in (0, 5, 10, 15, 20, 25)], "t timestamp_ntz, m string")
    inc = frame_of(spark, [(at(5), at(10)), (at(20), at(22))], "event_start timestamp_ntz, event_end timestamp_ntz")
    f = lambda mode: sorted(r.m for r in joins.filter_incidents(df, inc, datetime_column="t", logs_column="m", mode=mode).collect())
    assert f("outside") == ["m0", "m15", "m25"]
    assert f("compat") == ["m0", "m10", "m15", "m20", "m5"]


def test_range_join_ways_agree(spark):
    df = frame_of(spark, [(i, at(600 * i)) for i in range(50)], "k long, t timestamp_ntz")
    iv = frame_of(spark, [(at(1000 * i), at(1000 * i + 7000)) for i in range(20)], "s timestamp_ntz, e timestamp_ntz")
    a, b = (sorted((r.k, r.s) for r in joins.range_join(df, iv, time="t", start="s", end="e", rows=n).collect()) for n in (None, joins.BROADCAST_ROWS + 1))
    assert a == b and a


def test_interval_precision_counts_overlaps(spark):
    df = frame_of(spark, [(at(1), 1.0), (at(2), 1.0)], "t timestamp_ntz, s double")
    iv = frame_of(spark, [(at(0), at(3)), (at(1), at(3))], "a timestamp_ntz, b timestamp_ntz")
    r = joins.interval_precision(df, iv, time="t", start="a", end="b").first()
    assert (r.tp, r.fp, r.distinct_tp) == (4, -2, 2)
    assert joins.interval_precision(df, iv, time="t", start="a", end="b", score="s", threshold=2.0).first().precision is None


def test_strict_lookup_fails(spark):
    df, t = frame_of(spark, [(1,), (2,)], "k long"), frame_of(spark, [(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="no entry for"):
        joins.strict_lookup(df, t, "k").collect()


def test_scalers_round_trip_and_constants(spark):
    df = frame_of(spark, [(float(i), 7.0) for i in range(101)], "a double, b double")
    s = scaling.Scaler("custom").fit(df, ["a", "b", "missing"])
    back = scaling.Scaler.from_json(s.to_json())
    rows = back.transform(df).collect()
    assert {r.b for r in rows} == {0.0} and set(back.params) == {"a", "b"} and back.kind == "custom"
    with pytest.raises(ValueError):
        scaling.Scaler("RobustScaler").transform(df)
    with pytest.raises(ValueError):
        scaling.Scaler("other")
    out, scalers = scaling.scale(df, ["b", "a"], per_column={"a": "robust"})
    assert out.columns == ["b", "a"] and set(scalers) == {"MinMaxScaler", "RobustScaler"} or set(scalers) == {"minmax", "robust"}


def test_templates_match_what_was_fitted(spark):
    rows = [(i, m) for i, m in enumerate(["user a logged in", "user b logged in", "disk 1 full", "disk 2 full", "user a logged in", None])]
    df = frame_of(spark, rows, "o long, m string")
    miner = TemplateMiner(MinerConfig(similarity=0.5, depth=3)).fit(df, "m", "o")
    got = [r.template_id for r in miner.predict(df, "m").orderBy("o").collect()]
    assert got[0] == got[1] == got[4] and got[2] == got[3] != got[0] and got[5] == -1 and -1 not in got[:5]
    assert (1, "user <*> logged in", 2) in miner.templates()
    again = TemplateTree.from_json(miner.tree.to_json())
    assert again.match("user zz logged in") == got[0] and again.match("something else") == -1
    more = frame_of(spark, [(0, "brand new words")], "o long, m string")
    assert miner.fit_online(more, "m", "o", 0.9).predict(more, "m").first().template_id > 0
    miner.tree.discard(got[0])
    assert miner.tree.match("user a logged in") == -1


def test_masked_mean_is_shifted(spark):
    df = frame_of(spark, [([1.0, 3.0, 9.0], [1.0, 1.0, 0.0])], "x array<double>, m array<double>")
    assert df.select(scoring.masked_mean("x", "m").alias("v")).first().v == pytest.approx(2 + 1e-8, abs=1e-12)


def test_ranked_mse_documents(spark):
    df = frame_of(spark, [(1, at(0), f, v) for f, v in (("a", 0.1), ("b", 0.3), ("c", 0.6))], "w long, t timestamp_ntz, f string, mse double")
    ranked = scoring.ranked_mse(df, window="w", feature="f", top_k=2).withColumn("t", F.lit(at(0)).cast("timestamp_ntz"))
    assert [(r["rank"], r.f) for r in ranked.orderBy("rank").collect()] == [(1, "c"), (2, "b")]
    import json

    doc = json.loads(scoring.ranked_documents(ranked, window="w", timestamp="t", feature="f").first().document)
    assert doc["@timestamp"] == "2024-01-01T00:00:00.000Z" and doc["rank_1_feature_name"] == "c" and doc["rank_1_contribution_percent"] == pytest.approx(60)
    even = frame_of(spark, [(1, "a", 0.0), (1, "b", 0.0)], "w long, f string, mse double")
    assert {r.contribution_percent for r in scoring.ranked_mse(even, window="w", feature="f").collect()} == {50.0}


def test_weighted_sample_size(spark):
    df = spark.range(1000).withColumn("w", (F.col("id") % 2).cast("double"))
    got = scoring.weighted_sample(df, "w", 5000, seed=3)
    assert abs(got.count() - 5000) < 400 and got.filter("id % 2 = 0").count() == 0


def test_lstm_runs_backwards_too():
    x = np.random.default_rng(0).normal(size=(2, 5, 3))
    m = scoring.LSTMAutoEncoder.random(3, 4, layers=2)
    assert m(x).shape == x.shape
    with pytest.raises(ValueError):
        scoring.LSTMAutoEncoder.random(3, 3)
    w = [np.random.default_rng(1).normal(size=s) for s in ((8, 3), (8, 2), (8,), (8,))]
    forward, backward = scoring.lstm_layer(x[:, ::-1], *w)[:, ::-1], scoring.lstm_layer(x, *w, reverse=True)
    assert np.allclose(forward, backward)


def test_tail_of_an_exponential():
    s = np.random.default_rng(0).exponential(size=20_000)
    u = float(np.quantile(s, 0.95))
    tail = evaluation.fit_tail(s, u, len(s))
    assert abs(tail.shape) < 0.1 and abs(tail.scale - 1) < 0.15
    assert evaluation.tail_threshold(1e-3, tail) == pytest.approx(-math.log(1e-3), rel=0.1)
    assert evaluation.tail_threshold(0.5, tail) == u
    assert evaluation.tail_ks(np.ones(5), 0.0, 1.0) == math.inf


def test_calibration(spark):
    s = np.random.default_rng(0).exponential(size=20_000)
    df = spark.createDataFrame([(float(x),) for x in s], "score double")
    c = evaluation.calibrated(df, df, "score", alpha=1e-3, anomalous=df.select((F.col("score") + 8).alias("score")))
    assert c.candidate.far == pytest.approx(1e-3, abs=5e-4) and c.recall > 0.9 and c.ks > 0.9 and c.ks_p < 1e-6
    with pytest.raises(ValueError):
        evaluation.calibrated(df.limit(10), df, "score", alpha=1e-3)


def test_f1_threshold_by_hand(spark):
    df = frame_of(spark, [(0.9, 1), (0.8, 1), (0.7, 0), (0.2, 0)], "s double, t int")
    r = evaluation.threshold_selector(df, "s", "t").first()
    assert (r.threshold, r.f1) == (pytest.approx(0.75), 1.0)
    assert evaluation.roc_auc(df, "s", "t").first().auc == 1.0


def test_ks_p_values():
    assert stats.ks_p_value(0.0, 5, 5) == pytest.approx(1.0)
    assert stats.ks_p_value(1.0, 5, 5) == pytest.approx(2 / math.comb(10, 5))
    assert stats.ks_p_value(0.5, 2000, 2000) < 1e-100 + 1e-9


def test_drift_classes_and_excluded(spark):
    rows = [(dt.datetime(2026, 5, 5 + d, h, m), (10.0 if h < 8 else 100.0) * (1 if d < 4 else 2)) for d in range(8) for h in (2, 10, 16) for m in (0, 5)]
    df = frame_of(spark, rows, "timestamp timestamp_ntz, metric_a double")
    report, table = drift.monitor(df, timestamp_col="timestamp", features=["metric_a"], groups=["a"], metrics=["metric"], ref=("2026-05-05", "2026-05-08"), test=("2026-05-09", "2026-05-12"), order_by="timestamp")
    row = table.first()
    assert row.median_shift_pct == pytest.approx(100.0) and row.input_drift_class == "investigate" and report["tier0_status"] == "warn"
    _, gone = drift.monitor(df, timestamp_col="timestamp", features=["metric_a"], groups=["a"], metrics=["metric"], ref=("2026-05-05", "2026-05-08"), test=("2026-05-09", "2026-05-12"), order_by="timestamp", exclude_groups=["a"])
    assert gone.first().input_drift_class == "excluded"
    with pytest.raises(ValueError):
        drift.monitor(df, timestamp_col="timestamp", features=[], groups=[], metrics=[], ref=("", ""), test=("", ""), order_by="timestamp", mode="other")


def test_empty_side_fails(spark):
    df = frame_of(spark, [], "t timestamp_ntz, m_a double")
    assert drift.tier0(df, df, ["m_a"], ["a"], ["m"], "t", "t") == ("fail", [], [])


def test_metric_pipeline_pads_short_input(spark):
    df = frame_of(spark, [(at(3600 * i), float(i), None) for i in range(3)], "t timestamp_ntz, a double, b double")
    verdict, ranked = metrics.inferred(df, timestamp_col="t", metric_columns=["a", "b"], scaler=None, model=scoring.MeanReconstructor(), threshold=0.0, window_size=5, periods={"hour": 3600})
    assert verdict.count() == 1 and verdict.first().predicted == 1 and ranked.count() == 4


def test_log_preparation(spark):
    df = frame_of(spark, [(i, at(i), "n", f"m{i}") for i in range(6)], "k long, t timestamp_ntz, node string, m string")
    indexed, w = logs.prepared(df, None, datetime_column="t", logs_column="m", order_by="k", partition_by="node", sequence_length=3)
    assert indexed.count() == 6 and sorted(r.window for r in w.collect()) == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]]


def test_sources(spark, tmp_path):
    df = frame_of(spark, [("2024-01-01", 1)], "d string, v long")
    for fmt in ("parquet", "csv", "json", "orc"):
        options = {"header": True} if fmt == "csv" else {}
        tables.save(df, str(tmp_path / fmt), fmt, **options)
        got = tables.load(spark, str(tmp_path / fmt), fmt, date_columns=["d"], **options).first()
        assert got.d == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        tables.load(spark, "x", "nothing")
    assert tables.save_next(df, str(tmp_path / "n"), "my_base").endswith("my_base_0.parquet")
    assert tables.save_next(df, str(tmp_path / "n"), "my_base").endswith("my_base_1.parquet")
    (tmp_path / "log.txt").write_text("a\nb\nc\n")
    assert [(r.raw, r.line_id) for r in tables.read_lines(spark, str(tmp_path / "log.txt")).orderBy("line_id").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert tables.create(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2
    assert tables.matching_files(spark, str(tmp_path), "*.txt") == ["log.txt"]
    assert tables.row_counts(spark, str(tmp_path / "parquet")).agg(F.sum("rows")).first()[0] == 1


def test_streaming_windows(spark, tmp_path):
    from tidemark.streaming import online

    src = str(tmp_path / "in")
    frame_of(spark, [(i, "a", f"m{i}") for i in range(5)] + [(9, "b", "x")], "k long, node string, m string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k long, node string, m string").parquet(src)
    q = online.last_line_windows(stream, key="node", order_by="k", value="m", length=3).writeStream.format("memory").queryName("last").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.window for r in spark.table("last").collect()) == [["m0", "m1", "m2"], ["m1", "m2", "m3"], ["m2", "m3", "m4"]]
    seen = []
    miner = TemplateMiner()
    q = online.online_templates(stream, miner, message="m", order_by="k", sink=lambda df, _: seen.extend(r.template_id for r in df.collect())).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(seen) == 6 and -1 not in seen


def test_linear_auto_encoder_and_registry(spark, tmp_path):
    from tidemark import registry
    from tidemark.plans import training

    g = np.random.default_rng(1)
    line = g.normal(size=(60, 1)) @ g.normal(size=(1, 6)) + 2
    df = frame_of(spark, [(i, x.reshape(3, 2).tolist()) for i, x in enumerate(line)], "k long, window array<array<double>>")
    model, trials = training.searched(df, df, [{"k": 0}, {"k": 1}], key="k")
    assert trials[1]["loss"] < 1e-9 < trials[0]["loss"]
    (tmp_path / "m.json").write_text(model.to_json())
    again = registry.load("reconstructor", str(tmp_path / "m.json"))
    x = line[:2].reshape(2, 3, 2)
    assert np.allclose(again(x), x)
    assert {"linear", "mean"} <= set(registry.names("reconstructor"))
    with pytest.raises(KeyError):
        registry.make("reconstructor", {"name": "none"})


def test_drift_statistics_by_group_equal_single_ones(spark):
    g = np.random.default_rng(3)
    rows = [(f, float(v), r) for f, shift in (("a", 0.0), ("b", 1.0), ("c", 5.0)) for r in (True, False) for v in g.normal(0 if r else shift, 1, 28)] + [("d", 1.0, r) for r in (True, False) for _ in range(6)]
    df = frame_of(spark, rows, "f string, v double, r boolean")
    many = {x.f: x for x in stats.psi_by_group(df, "f", "v", "r").collect()}
    ks = {x.f: x.ks for x in stats.ks_by_group(df, "f", "v", "r").collect()}
    for f in "abcd":
        own = df.filter(F.col("f") == f)
        one = stats.psi(own, "v", "r", stats.psi_bins(own.filter("r").count())).first()
        assert (many[f].psi, many[f].n_bins) == (pytest.approx(one.psi), one.n_bins)
        assert ks[f] == pytest.approx(stats.ks_and_wasserstein(own, "v", "r").first().ks)
    ref = np.array([v for f, v, r in rows if f == "b" and r])
    cur = np.array([v for f, v, r in rows if f == "b" and not r])
    edges = np.percentile(ref, np.linspace(0, 100, 6))
    edges[0], edges[-1] = min(edges[0], cur.min()) - 1e-9, max(edges[-1], cur.max()) + 1e-9
    p, q = (np.clip(np.histogram(x, edges)[0] / 28, 1e-6, None) for x in (ref, cur))
    assert many["b"].psi == pytest.approx(((q - p) * np.log(q / p)).sum())

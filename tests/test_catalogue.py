"""Queries that SQL does not express, against NumPy; and operators at sizes or by ways that the small tables do not reach."""

import datetime as dt
import json
import math
import operator
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import evaluation, joins, order, scaling, scoring, tiles, windows
from tidemark.operators.templates import MinerConfig, TemplateMiner, TemplateTree, messages_of
from tidemark.plans import drift, logs
from tidemark.plans.artifacts import MetricPipeline
from tidemark.queries import QUERIES, SQL, TYPES
from tidemark.runtime import run_name, seeded, timed
from tidemark.sources import tables

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_row_index_of_wide_frames(spark):
    n = 1_000_000
    k = F.xxhash64("id")
    df = spark.range(0, n, 1, 12).select("id", k.alias("k"), *(F.concat(F.lit(c), F.hex(k)).alias(c) for c in "abcd"))
    got = order.with_row_index(df, ["k", "id"], name="i")
    r = got.agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.countDistinct("id").alias("ids")).first()
    assert tuple(r) == (n, n, 0, n - 1, n)
    some = got.filter("i % 99991 < 2").orderBy("i").collect()
    assert all(x.k <= y.k for x, y in zip(some, some[1:], strict=False)) and some[0].a.startswith("a")


def test_quantiles_both_ways(spark):
    g = np.random.default_rng(1)
    a, b = g.normal(size=5000), g.integers(0, 7, 5000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).withColumn("none", F.lit(None).cast("double")).withColumn("b", F.when(F.rand(1) < 2, F.col("b"))).repartition(7)
    q = [0.0, 0.013, 0.5, 0.77, 1.0]
    for few in (0, 1_000_000):
        got = stats.quantiles(df, {c: F.col(c) for c in ("a", "b", "none")}, q, few)
        assert np.allclose(got["a"], np.quantile(a, q)) and np.allclose(got["b"], np.quantile(b, q)) and got["none"] is None


def test_ks_law_is_exact_beyond_small_samples():
    def paths(d, n, m):  # counts lattice paths that stay within the distance, as whole numbers
        bound = round(d * n * m)
        row = [0] * (m + 1)
        for i in range(n + 1):
            for j in range(m + 1):
                inside = abs(i * m - j * n) < bound
                row[j] = 0 if not inside else 1 if i == j == 0 else (row[j] if i else 0) + (row[j - 1] if j else 0)
        return 1 - row[m] / math.comb(n + m, m)

    for n, m, d in ((150, 120, 0.2), (7, 11, 0.6), (300, 200, 0.1)):
        d = round(d * n * m) / (n * m)
        assert stats.ks_p_value(d, n, m) == pytest.approx(paths(d, n, m), abs=1e-9)


def test_incidents_by_bucket(spark):
    g = np.random.default_rng(2)
    starts = g.integers(0, 100_000, 400)
    iv = [(at(int(s)), at(int(s + n))) for s, n in zip(starts, g.integers(0, 900, 400), strict=True)]
    pts = [(int(s), at(int(s)), f"m{s}") for s in range(0, 101_000, 37)]
    inc = spark.createDataFrame(iv, "_s timestamp_ntz, _e timestamp_ntz")
    df = spark.createDataFrame(pts, "k long, t timestamp_ntz, m string")
    want = sorted(k for k, t, _ in pts if not any(s <= t <= e for s, e in iv))
    for rows in (1, joins.BROADCAST_ROWS + 1):
        assert sorted(r.k for r in joins._outside(df, inc, "t", rows).select("k").collect()) == want


def test_windows_name_what_they_may_not_cross(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        windows.forward_windows(df, "id", 2, order_by="id", partition_by=())
    assert windows.forward_windows(df, "id", 2, order_by="id", partition_by=windows.WHOLE).count() == 3


def test_trees_grow_as_one_by_one(spark):
    g = np.random.default_rng(3)
    words = ["get", "put", "user", "disk", "7", "x9", "full", "ok"]
    rows = [(i, " ".join(g.choice(words, g.integers(1, 6)))) for i in range(600)] + [(600, " ")]
    df = spark.createDataFrame(rows, "o long, m string").repartition(5)
    config = MinerConfig(similarity=0.5, max_children=3)
    one = TemplateTree(config)
    first, later = rows[:300], rows[300:]
    for m in dict.fromkeys(m for _, m in first):
        one.add(m.strip())
    miner = TemplateMiner(config).fit(df.filter("o < 300"), "m", "o")
    assert miner.templates() == [(t.id, " ".join(t.tokens), t.size) for t in one.templates.values()]
    for m in dict.fromkeys(m for _, m in later):
        one.add(m.strip())
    miner.fit(df.filter("o >= 300"), "m", "o")
    assert sorted(miner.templates()) == sorted((t.id, " ".join(t.tokens), t.size) for t in one.templates.values())
    assert [r.template_id for r in miner.predict(df, "m").orderBy("o").collect()] == [one.match(m.strip()) for _, m in rows]


def test_messages_of_odd_inputs(spark):
    for bad in (5, [1, 2], {"a": 1}, spark.range(1)):
        with pytest.raises(TypeError):
            messages_of(spark, bad)
    assert messages_of(spark, np.array(["a", "b"])).count() == 2


def test_metric_model_through_its_folder(spark, tmp_path):
    model = scoring.MetricLSTM.random(6, 4, layers=2, times=2, seed=1)
    x = np.random.default_rng(0).normal(size=(3, 5, 6))
    t = x[:, :, 4:]
    for k in (0, 1):
        t = np.maximum(0, t @ model.weights[f"time.{k}.weight"].T + model.weights[f"time.{k}.bias"])
    z = np.concatenate([x[:, :, :4], t], 2)
    for part in ("encoder", "decoder"):
        for k in range(2):
            ways = []
            for way, steps in (("", range(5)), ("_reverse", range(4, -1, -1))):
                wi, wh, bi, bh = (model.weights[f"{part}.{k}.{n}{way}"] for n in ("weight_ih", "weight_hh", "bias_ih", "bias_hh"))
                out = np.zeros((3, 5, 4))
                for b in range(3):
                    h = c = np.zeros(4)
                    for s in steps:
                        gates = wi @ z[b, s] + bi + wh @ h + bh
                        i, f, g, o = gates[:4], gates[4:8], gates[8:12], gates[12:]
                        c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
                        h = np.tanh(c) / (1 + np.exp(-o))
                        out[b, s] = h
                ways.append(out)
            z = np.concatenate(ways, 2)
    assert np.allclose(model(x), z @ model.weights["head.weight"].T + model.weights["head.bias"]) and model(x).shape == (3, 5, 4)
    df = spark.createDataFrame([(at(3600 * i), float(i % 5), float(i % 3)) for i in range(30)], "t timestamp_ntz, a double, b double")
    pipe = MetricPipeline(scoring.MetricLSTM.random(4, 4, times=2), scaling.Scaler("custom").fit(df, ["a", "b"]), ["a", "b"], 0.01, 6, {"day": 86_400})
    pipe.save(f"file://{tmp_path}/model")
    back = MetricPipeline.from_folder(f"file://{tmp_path}/model")
    want, got = (sorted(map(tuple, p.infer(df, timestamp_col="t")[0].collect())) for p in (pipe, back))
    assert want == got and len(got) == 25
    assert {r.feature for r in back.infer(df, timestamp_col="t")[1].collect()} == {"a", "b"}
    assert MetricPipeline.from_folder(f"file://{tmp_path}/model", window_size=8).window_size == 8


def test_variational_parts():
    assert scoring.divergence(np.array([[1.0, 0.0]]), np.zeros((1, 2)))[0] == pytest.approx(0.5)
    mean, log_var = np.full((20_000, 1), 3.0), np.full((20_000, 1), math.log(4.0))
    z = scoring.drawn(mean, log_var)
    assert z.mean() == pytest.approx(3, abs=0.05) and z.std() == pytest.approx(2, abs=0.05)
    assert scoring.noisy(mean, 0.1).std() == pytest.approx(0.3, abs=0.02) and scoring.noisy(mean, 0) is mean


def test_weighted_draws_of_one_heavy_row(spark):
    df = spark.createDataFrame([(0, 1000.0)] + [(i, 0.0) for i in range(1, 50)], "k long, w double")
    assert scoring.weighted_sample(df, "w", 900, seed=4).count() == pytest.approx(900, abs=150)


def test_files_and_archives(spark, tmp_path):
    import tarfile

    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "k long, x array<double>")
    tables.save_npy(df, f"{base}/m.npy", "x", "k")
    assert np.load(tmp_path / "m.npy").tolist() == [[float(i), 2.0] for i in range(4)]
    with pytest.raises(ValueError):
        tables.save_npy(df, f"{base}/m.npy", "x", "k", limit_mb=0)
    (tmp_path / "a.txt").write_text("hello")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "a.txt", "in/a.txt")
    assert tables.unpacked(spark, f"{base}/a.tar", f"{base}/out") == ["in/a.txt"] and (tmp_path / "out/in/a.txt").read_text() == "hello"
    tables.copied(spark, f"{base}/out", f"{base}/copy")
    assert (tmp_path / "copy/in/a.txt").read_text() == "hello"
    assert [len(b) for b in tables.batches(spark.range(5), 2)] == [2, 2, 1]
    df.write.parquet(f"{base}/t")
    assert tables.metadata_of(spark, f"{base}/t").agg(F.sum("rows")).first()[0] == 4


def test_runtime(caplog):
    assert seeded(3).integers(100) == seeded(3).integers(100)
    with timed("a block") as t:
        pass
    assert t["seconds"] >= 0 and run_name("x", mark="m").startswith("x_")


# Queries without SQL


def hourly():
    e = pd.read_parquet(f"{DATA}/events.parquet")
    h = e.assign(hour=e.ts.dt.floor("h")).pivot_table(index="hour", columns="event_type", values="value", aggfunc="sum").reindex(columns=TYPES)
    return h.fillna(0.0)


@needs_data
def test_evt_calibration(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet")
    normal, bad = (e.value[e.event_type == "error"].to_numpy() if k else e.value[e.event_type != "error"].to_numpy() for k in (0, 1))
    r = QUERIES["evt_calibration"](spark, DATA).first()
    y = normal[normal > r.u] - r.u
    us = np.quantile(normal, np.linspace(1 - 1000 / len(normal), 1 - 100 / len(normal), 50))
    assert np.abs(us - r.u).min() < 1e-9

    def likelihood(shape, scale):
        z = 1 + shape * y / scale
        return -math.inf if (z <= 0).any() else -len(y) * math.log(scale) - (1 + 1 / shape) * np.log(z).sum()

    best = likelihood(r.shape, r.scale)
    assert all(likelihood(r.shape + a, r.scale * b) <= best + 1e-6 for a in (-0.02, 0, 0.02) for b in (0.97, 1, 1.03))
    assert r.threshold == pytest.approx(r.u + r.scale / r.shape * ((1e-3 * len(normal) / len(y)) ** -r.shape - 1), rel=1e-9)
    assert r.far == pytest.approx((normal > r.threshold).mean()) and r.recall == pytest.approx((bad > r.threshold).mean())
    assert tuple(QUERIES["evt_calibration"](spark, DATA.replace("0.01", "0.001")).first()) == (None,) * 6


@needs_data
def test_drift_report(spark):
    h = hourly()
    ref, test = h[h.index < "2024-01-15"], h[(h.index >= "2024-01-15") & (h.index < "2024-01-31")]

    def medians(x):  # by local day and part of day
        local = x.index.tz_localize("UTC").tz_convert("Europe/Berlin")
        part = np.where((local.hour >= 8) & (local.hour < 18), "working", "night")
        return x.groupby([local.date, part]).median()

    a, b = medians(ref), medians(test)
    got = {r.feature: r for r in QUERIES["drift_report"](spark, DATA).collect()}
    assert set(got) == {f"value_{t}" for t in TYPES}
    for t in TYPES:
        r, x, y = got[f"value_{t}"], a[t].to_numpy(), b[t].to_numpy()
        assert (r.n_periods_ref, r.n_periods_test) == (len(x), len(y))
        assert r.zero_rate_ref == pytest.approx((ref[t] == 0).mean(), abs=1e-4) and r.zero_rate_test == pytest.approx((test[t] == 0).mean(), abs=1e-4)
        assert r.median_ref == pytest.approx(np.median(x), abs=1e-3) and r.median_test == pytest.approx(np.median(y), abs=1e-3)
        iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
        assert r.robust_d == pytest.approx((np.median(y) - np.median(x)) / iqr, abs=2e-3)
        every = np.sort(np.concatenate([x, y]))
        ks = max(abs((x <= v).mean() - (y <= v).mean()) for v in every)
        assert r.ks_stat == pytest.approx(ks, abs=1e-3) and 0 <= r.ks_pvalue <= 1
        assert r.input_drift_class in drift.COLOURS


@needs_data
def test_metric_inference(spark):
    h = hourly()
    x = np.arcsinh(h.to_numpy())
    low, high, mid = np.quantile(x, 0.05, 0), np.quantile(x, 0.95, 0), np.median(x, 0)
    x = (x - mid) / (high - low)
    angle = 2 * np.pi * ((h.index.astype("datetime64[us]").astype("int64") % 86_400_000_000) / 86_400_000_000)
    x = np.c_[x, np.sin(angle), np.cos(angle)]
    w = np.stack([x[i : i + 24] for i in range(len(x) - 23)])
    mse = ((w[:, :, : len(TYPES)] - scoring.MetricLSTM.random(len(TYPES) + 2, 4, times=2)(w)) ** 2).mean((1, 2))
    got = {r.window_ts: r for r in QUERIES["metric_inference"](spark, DATA).collect()}
    assert len(got) == len(mse)
    for ts, m in zip(h.index[23:], mse, strict=True):
        r = got[ts.to_pydatetime()]
        assert r.mse == pytest.approx(m, rel=1e-6) and r.predicted == int(m > 0.5)


@needs_data
def test_block_verdicts(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet").sort_values("event_id")
    kinds = dict.fromkeys(e.event_type)
    texts = spark.createDataFrame([(k, f"{k} user NUM value FLOAT") for k in kinds], "k string, t string")
    from tidemark.operators.templates import hashed_embedding

    vec = {r.k: np.array(r.v) for r in texts.select("k", hashed_embedding("t").alias("v")).collect()}
    want = {}
    for user, own in e.groupby("user_id"):
        v = np.array([vec[k] for k in own.event_type])
        v = np.r_[v, np.zeros((max(0, 10 - len(v)), 64))]
        scores = [((s - s.mean(0)) ** 2).mean() + 1e-8 for s in (v[i : i + 10] for i in range(len(v) - 9))]
        want[user] = max(scores), len(scores)
    got = {r.user_id: (r.max_score, r.n_windows, r.anomaly) for r in QUERIES["block_verdicts"](spark, DATA).collect()}
    assert set(got) == set(want)
    for u, (score, n, hit) in got.items():
        assert score == pytest.approx(want[u][0], rel=1e-9) and n == want[u][1] and hit == int(want[u][0] > 0.1)


@pytest.mark.parametrize("model", [scoring.MeanReconstructor(), scoring.LSTMAutoEncoder.random(64, 4)])
def test_block_verdicts_of_lines_numbered_by_block(spark, model):
    kinds = ["open file", "close the file", "read all", None]
    own = {b: [kinds[(i * i + b) % 4] for i in range(n)] for b, n in ((1, 3), (2, 10), (3, 25), (4, 1))}
    e = spark.createDataFrame([(b, i, m) for b, ms in own.items() for i, m in enumerate(ms)], "block long, line long, message string")
    miner = TemplateMiner(MinerConfig(similarity=0.9)).fit(e, "message", "line", distinct="masked")
    vec = {r.Template: np.array(r.vector) for r in logs.template_table(miner, spark).collect()} | {None: np.zeros(64)}
    df = logs.block_verdicts(e, miner, block="block", message="message", line_id="line", length=10, model=model, threshold=0.02)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # neither slots nor cells are rows
    got = {r.block: (r.max_score, r.n_windows, r.anomaly) for r in df.collect()}
    assert set(got) == set(own)
    for b, ms in own.items():
        v = np.array([vec[m] for m in ms] + [np.zeros(64)] * max(0, 10 - len(ms)))
        w = np.stack([v[i : i + 10] for i in range(len(v) - 9)])
        scores = ((w - model(w)) ** 2).mean((1, 2)) + 1e-8
        assert got[b] == (pytest.approx(scores.max(), rel=1e-9), len(scores), int(scores.max() > 0.02))


def test_window_errors_of_shapes(spark):
    g = np.random.default_rng(5)
    own = [g.normal(size=s).tolist() for s in ((3, 2), (3, 2), (5, 2), (1, 4))] + [[], [[math.nan, 1.0], [0.0, 1.0]]]

    first = operator.itemgetter((slice(None), slice(None, None, -1), slice(0, 1)))  # a model of one feature alone
    df = scoring.window_errors(spark.createDataFrame(list(enumerate(own)), "k long, window array<array<double>>").coalesce(1), first)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # a cell is no row
    got = {r.k: (r.mse, r.feature_mse) for r in df.collect()}
    assert set(got) == {0, 1, 2, 3, 5} and math.isnan(got.pop(5)[0])
    for k, (mse, each) in got.items():
        x = np.array(own[k])[None]
        want = ((x[:, :, :1] - first(x)) ** 2).mean()
        assert mse == pytest.approx(want) and each == pytest.approx([want])


@needs_data
def test_drift_map(spark):
    rows = [r.asDict() for r in QUERIES["drift_report"](spark, DATA).collect()]
    rows.append({**rows[0], "feature": "gone", "input_drift_class": "sparse"})
    svg = drift.drift_map({"tier1_all_features": rows})
    assert svg.count("<circle") == len(TYPES) and "gone" not in svg
    assert json.loads(json.dumps({"ok": evaluation.tail_ks(np.zeros(3), 0.1, 1.0) == math.inf}))["ok"]


def test_pairwise_cosine_stats_of_many_suppliers(spark, tmp_path):
    import time

    import duckdb

    g = np.random.default_rng(3)
    n = 6000
    f = pd.DataFrame({"s_suppkey": g.permutation(n), "s_acctbal": g.normal(0, 3000, n).round(2), "s_nationkey": g.integers(0, 25, n).astype("int32")})
    f.loc[:40, "s_suppkey"] = 17  # pairs of one key are none
    f.loc[70:75, "s_acctbal"] = np.nan
    f.loc[80:82, "s_acctbal"] = np.inf
    spark.createDataFrame([(int(k), float(a), int(c)) for k, a, c in f[["s_suppkey", "s_acctbal", "s_nationkey"]].itertuples(index=False)], "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.time()
    got = QUERIES["pairwise_cosine_stats"](spark, str(tmp_path)).collect()
    assert time.time() - began < 120  # by an aggregate over a row for each pair: not done after 170 s, on 8 cores
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert [tuple(r) for r in got] == c.sql(SQL["pairwise_cosine_stats"]).fetchall()


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_distance_stats_of_odd_vectors(spark, monkeypatch, few):
    g = np.random.default_rng(4)
    rows = [(f"k{i % 170}", g.normal(size=3).tolist()) for i in range(180)] + [(f"s{i}", [0.5, 0.5, 1.0]) for i in range(25)]
    rows += [("z0", [0.0, 0.0, 0.0]), ("z1", [0.0, 0.0, 0.0]), ("n0", None), ("n1", [1.0, None, 2.0]), ("e", []), (None, [1.0, 2.0, 3.0])]
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 40)
    r = tiles.distance_stats(spark.createDataFrame(rows, "k string, v array<double>"), key="k", vector="v", tiny=0.02, few=few).first()
    d, pairs = [], 0
    for i, (k, v) in enumerate(rows):
        for m, w in rows[i + 1 :]:
            pairs += None not in (k, m) and k != m
            if None not in (k, m) and k != m and v and w and None not in v + w:
                a, b = np.array(v), np.array(w)
                d.append(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else math.nan)
    d = np.maximum(np.sort(d), 0)
    want = d[(len(d) - 1) // 2], d[0], d[d > 0.02].min(), np.quantile(d[~np.isnan(d)], 0.1 * (len(d) - 1) / ((~np.isnan(d)).sum() - 1)), (d < 0.02).sum() / pairs
    assert tuple(r) == pytest.approx(want, abs=1e-12)


def test_distance_stats_without_pairs(spark):
    of = lambda rows: tuple(tiles.distance_stats(spark.createDataFrame(rows, "k long, v array<double>"), key="k", vector="v").first())
    assert of([]) == of([(1, [1.0])]) == of([(1, [1.0]), (1, [2.0])]) == (None,) * 5
    assert of([(1, None), (2, [2.0])]) == (None, None, None, None, 0.0)
    assert of([(1, [0.0]), (2, [2.0])])[4] == 0.0 and all(math.isnan(x) for x in of([(1, [0.0]), (2, [2.0])])[:4])
    with pytest.raises(ValueError):
        of([(1, [1.0]), (2, [2.0, 1.0])])

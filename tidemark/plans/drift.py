"""Input drift between a reference and a test period: health gates, effect sizes, classes and a report."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import daypart_medians, ks_by_group, ks_p_value, psi_by_group, rows_per_day, sampling_interval, zero_rate
from tidemark.operators.frame import feature_group, split_by_dates
from tidemark.operators.scaling import Scaler
from tidemark.sources.shared import write_text

# Fixed values (T-10): thresholds by name, modes, classes and their colours.
THRESHOLDS = {
    "tier0_row_count_drop_pct": 20.0,
    "tier0_db_zero_warn_pp": 0.05,
    "tier0_db_zero_fail_pp": 0.15,
    "tier0_min_rows_per_day": 200,
    "psi_bins_max": 5,
    "psi_min_samples_per_bin": 5,
    "psi_min_ref_days": 14,
    "psi_report_severe": 0.25,
    "psi_report_moderate": 0.10,
    "median_shift_investigate_pct": 25.0,
    "median_shift_watch_pct": 15.0,
    "ks_stat_investigate": 0.35,
    "ks_stat_watch": 0.20,
    "robust_d_investigate": 0.70,
    "robust_d_watch": 0.40,
    "zero_rate_sparse_threshold": 0.90,
    "zero_rate_dq_flag_pp": 0.10,
}
MODES = ("daypart_all_days", "daypart_weekdays")
COLOURS = {"stable": "green", "watch": "orange", "investigate": "red", "data_quality": "gray", "sparse": "lightgray", "excluded": "silver"}


def zero_rates(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Of all features in one job; NaN without values."""
    row = df.agg(*(zero_rate(c).alias(c) for c in features)).first().asDict()
    return {c: math.nan if row[c] is None else row[c] for c in features}


# Fixed values (T-02): names and order of the gates in reports, with how each gets its value, when it fails, and as what.
_GATES = (
    ("ref_rows", "ref_rows", None, None),
    ("test_rows", "test_rows", None, None),
    ("ref_mean_rows_per_day", "round(ref_mean, 1)", None, None),
    ("test_mean_rows_per_day", "round(test_mean, 1)", None, None),
    ("row_count_drop_pct", "round(100 * (1 - test_mean / ref_mean), 2)", "100 * (1 - test_mean / ref_mean) > {tier0_row_count_drop_pct}", "fail"),
    ("sampling_interval_sec_ref", "ref_gap", None, None),
    ("sampling_interval_sec_test", "test_gap", "abs(ref_gap - test_gap) > 1", "warn"),
    ("test_days_below_min_rows", "test_low", "test_low > 0", "warn"),
)


def _facts(df: DataFrame, side: str, timestamp_col: str, order_by: str, thresholds: Mapping) -> DataFrame:
    """One row: what the gates ask of a side."""
    low = F.count_if(F.col("n") < thresholds["tier0_min_rows_per_day"])
    days = rows_per_day(df, timestamp_col).agg(F.avg("n").alias(f"{side}_mean"), low.cast("double").alias(f"{side}_low"))
    gap = sampling_interval(df, timestamp_col, order_by).agg(F.max("seconds").alias(f"{side}_gap"))
    return days.crossJoin(gap).crossJoin(df.agg(F.count("*").cast("double").alias(f"{side}_rows")))  # one row each


def tier0(ref: DataFrame, test: DataFrame, features: Sequence[str], groups: Sequence[str], metrics: Sequence[str], timestamp_col: str, order_by: str, thresholds: Mapping = THRESHOLDS) -> tuple[str, list[dict], list[dict]]:
    """T-02, A-09: status (ok, warn, fail), checks, and zero rates by group. A side without rows fails without checks. A gate whose value
    is unknown has not passed, but raises no alarm."""
    facts = _facts(ref, "ref", timestamp_col, order_by, thresholds).crossJoin(_facts(test, "test", timestamp_col, order_by, thresholds))
    rows = []
    for name, value, bad, level in _GATES:
        hit = F.expr(bad.format(**thresholds)) if bad else F.lit(False)
        rows.append(F.struct(F.lit(name).alias("check"), F.expr(value).cast("double").alias("value"), F.when(hit, F.lit(level)).otherwise("ok" if bad else "info").alias("level"), F.coalesce(~hit, F.lit(False)).alias("passed")))
    gates = facts.filter("ref_mean is not null and test_mean is not null").select(F.inline(F.array(*rows))).collect()
    if not gates:
        return "fail", [], []
    checks = [{**r.asDict(), "value": math.nan if r["value"] is None else r["value"]} for r in gates]
    by_group = group_zero_rates(zero_rates(ref, features), zero_rates(test, features), groups, metrics, thresholds)
    levels = {c["level"] for c in checks if not c["passed"]} | {g["level"] for g in by_group}
    return next((x for x in ("fail", "warn") if x in levels), "ok"), checks, by_group


def group_zero_rates(ref: Mapping[str, float], test: Mapping[str, float], groups: Sequence[str], metrics: Sequence[str], thresholds: Mapping = THRESHOLDS) -> list[dict]:
    """A-09: of each group that has features, the mean zero rates of both sides and how far they are apart."""
    out = []
    for g in groups:
        own = [c for c in (f"{m}_{g}" for m in metrics) if c in ref]
        if not own:
            continue
        before, after = (math.fsum(side[c] for c in own) / len(own) for side in (ref, test))
        apart = abs(after - before)
        level = next((x for x in ("fail", "warn") if apart > thresholds[f"tier0_db_zero_{x}_pp"]), "ok")
        out.append({"group": g, "zero_rate_ref": round(before, 4), "zero_rate_test": round(after, 4), "delta_pp": round(after - before, 4), "level": level})
    return out


def drift_class(*, sparse: Column, zero_delta: Column, median_shift: Column, ks: Column, robust_d: Column, thresholds: Mapping = THRESHOLDS) -> Column:
    """T-07, Q-20, Q-26: the class of a feature from its (rounded) effect sizes; null, NaN and infinite ones count as 0."""
    size = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.abs(c)).otherwise(0.0)
    flawed = size(zero_delta) >= thresholds["zero_rate_dq_flag_pp"]
    level = size(median_shift) >= thresholds["median_shift_investigate_pct"]
    k, d = size(ks), size(robust_d)
    shape = (k >= thresholds["ks_stat_investigate"]) | (d >= thresholds["robust_d_investigate"])
    seen = level | (k >= thresholds["ks_stat_watch"]) | (d >= thresholds["robust_d_watch"])
    return F.when(flawed, "data_quality").when(sparse, "sparse").when(level & shape, "investigate").when(seen, "watch").otherwise("stable")


def _round(x, digits: int):
    return round(x, digits) if x is not None and math.isfinite(x) else x


def tier1(ref: DataFrame, test: DataFrame, ref_agg: DataFrame, test_agg: DataFrame, features: Sequence[str], groups: Sequence[str], scaler: Scaler, aggregation: str, tier0_status: str, thresholds: Mapping = THRESHOLDS, exclude_groups: Sequence[str] = ()) -> DataFrame:
    """T-08: a row of effect sizes and the class for each feature. Medians, quantiles, PSI and KS of all features are one job each; only numbers for
    each feature reach the driver, where they are rounded as reports show them."""
    spark = ref.sparkSession
    za, zb = zero_rates(ref, features), zero_rates(test, features)
    sides = []
    for df in (ref_agg, test_agg):
        sides.append(df.agg(*(x for c in features for x in (F.count(c).alias(f"{c}|n"), F.percentile(c, [0.25, 0.5, 0.75]).alias(f"{c}|q")))).first().asDict())
    sizes = scaler.transform(ref_agg.select(*features), features).withColumn("_r", F.lit(True)).unionByName(scaler.transform(test_agg.select(*features), features).withColumn("_r", F.lit(False))).unpivot("_r", list(features), "feature", "value")
    shapes = {r["feature"]: r for r in psi_by_group(sizes, "feature", "value", "_r", thresholds["psi_bins_max"], thresholds["psi_min_samples_per_bin"]).collect()}
    steps = {r["feature"]: r["ks"] for r in ks_by_group(sizes, "feature", "value", "_r").collect()}
    rows = []
    for c in features:
        group = feature_group(c, groups)
        row = {"feature": c, "group": group, "aggregation": aggregation, "excluded": group in exclude_groups, "sparse_metric": False, "n_periods_ref": 0, "n_periods_test": 0, "zero_rate_ref": _round(za[c], 4), "zero_rate_test": _round(zb[c], 4), "zero_rate_delta": _round(zb[c] - za[c], 4), "median_ref": None, "median_test": None, "median_shift_pct": None, "robust_d": None, "psi": None, "psi_bins": 0, "psi_signal": "n/a", "ks_stat": None, "ks_pvalue": None}
        if not row["excluded"]:
            (n, q), (m, p) = ((s[f"{c}|n"], s[f"{c}|q"] or [math.nan] * 3) for s in sides)
            shift = 100.0 * (p[1] - q[1]) / q[1] if q[1] else math.nan if p[1] == 0 else math.inf
            iqr = q[2] - q[0]
            sparse = za[c] >= thresholds["zero_rate_sparse_threshold"]
            row |= {"sparse_metric": sparse, "n_periods_ref": n, "n_periods_test": m, "median_ref": _round(q[1], 4), "median_test": _round(p[1], 4), "median_shift_pct": _round(shift, 2), "robust_d": _round((p[1] - q[1]) / iqr, 3) if iqr >= 1e-6 else math.nan, "psi": math.nan}
            if not sparse and n >= thresholds["psi_min_ref_days"]:
                f = shapes.get(c)
                value = math.nan if f is None or f["psi"] is None else f["psi"]
                signal = "n/a" if math.isnan(value) else "severe" if value >= thresholds["psi_report_severe"] else "moderate" if value >= thresholds["psi_report_moderate"] else "none"
                row |= {"psi": _round(value, 4), "psi_bins": f["n_bins"] if f else 0, "psi_signal": signal}
            row |= {"ks_stat": math.nan, "ks_pvalue": math.nan}
            if n >= 5 and m >= 5:
                k = steps.get(c, math.nan)
                row |= {"ks_stat": _round(k, 4), "ks_pvalue": ks_p_value(k, n, m)}
        rows.append(row)
    schema = "feature string, group string, aggregation string, excluded boolean, sparse_metric boolean, n_periods_ref long, n_periods_test long, zero_rate_ref double, zero_rate_test double, zero_rate_delta double, median_ref double, median_test double, median_shift_pct double, robust_d double, psi double, psi_bins int, psi_signal string, ks_stat double, ks_pvalue double"
    out = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    cls = F.when(F.col("excluded"), "excluded").otherwise(drift_class(sparse=F.col("sparse_metric"), zero_delta=F.col("zero_rate_delta"), median_shift=F.col("median_shift_pct"), ks=F.col("ks_stat"), robust_d=F.col("robust_d"), thresholds=thresholds))
    return out.withColumn("input_drift_class", cls).withColumn("actionable", F.lit(tier0_status != "fail") & F.col("input_drift_class").isin("watch", "investigate"))


def monitor(df: DataFrame, *, timestamp_col: str, features: Sequence[str], groups: Sequence[str], metrics: Sequence[str], ref: tuple[str, str], test: tuple[str, str], order_by: str, mode: str = "daypart_all_days", tz: str = "Europe/Berlin", thresholds: Mapping = THRESHOLDS, exclude_groups: Sequence[str] = (), study: str = "", run_prefix: str = "") -> tuple[dict, DataFrame]:
    """T-01, T-09: the report and the table of features."""
    if mode not in MODES:
        raise ValueError(f"unknown aggregation mode: {mode}")
    held = df.select(*dict.fromkeys([timestamp_col, order_by, *features])).persist()  # read by every gate and statistic
    try:
        a, b = (split_by_dates(held, *span, timestamp_col) for span in (ref, test))
        status, checks, zero = tier0(a, b, features, groups, metrics, timestamp_col, order_by, thresholds)
        weekdays = mode == "daypart_weekdays"
        am, bm = (daypart_medians(x, features, timestamp_col, tz, weekdays_only=weekdays) for x in (a, b))
        table = tier1(a, b, am, bm, features, groups, Scaler("custom").fit(a, features), mode, status, thresholds, exclude_groups)
        counts = {"ref": a.count(), "test": b.count()}
    finally:
        held.unpersist()
    rows = [r.asDict() for r in table.collect()]  # one for each feature
    classes = sorted({r["input_drift_class"] for r in rows})
    names = sorted({r["group"] for r in rows})
    count = lambda g, c: sum(r["group"] == g and r["input_drift_class"] == c for r in rows)
    # The keys of reports, which their readers match on.
    report = {
        "study": study,
        "run_prefix": run_prefix,
        "reference": {"start": ref[0], "end": ref[1], "rows": counts["ref"]},
        "test": {"start": test[0], "end": test[1], "rows": counts["test"]},
        "tier0_status": status,
        "tier0_checks": checks,
        "tier0_group_zero_rates": zero,
        "tier1_class_counts": {c: sum(r["input_drift_class"] == c for r in rows) for c in classes},
        "tier1_group_rollup": [{"group": g, **{c: count(g, c) for c in classes}} for g in names],
        "tier1_all_features": rows,
        "tier1_investigate": [r for r in rows if r["input_drift_class"] == "investigate"],
        "aggregation": {"mode": mode, "timezone": tz},
        "exclude_groups": list(exclude_groups),
        "methodology": {"input_only": True, "classification": "effect_size_first_psi_diagnostic_only", "thresholds": dict(thresholds)},
    }
    return report, table


def write_report(report: dict, path: str) -> None:
    """S-15: as JSON, in any file system that Spark reaches."""
    write_text(json.dumps(report, indent=2, default=str), path)


def drift_map(report: dict, width: int = 640, height: int = 420) -> str:
    """S-15, T-11: features by median shift (capped at 100 %, the axis' end) and KS distance, in their class's colour, as an SVG picture.
    Sparse and excluded features, and those without both sizes, are left out."""
    left, foot = 50, 40
    across = lambda v: left + (max(-100.0, min(100.0, v)) + 100) / 200 * (width - left - 20)
    up = lambda v: height - foot - max(0.0, min(1.0, v)) * (height - foot - 20)
    shown = [r for r in report["tier1_all_features"] if r["input_drift_class"] not in ("sparse", "excluded") and all(r[k] is not None and not math.isnan(r[k]) for k in ("median_shift_pct", "ks_stat"))]
    dots = "".join(f'<circle cx="{across(r["median_shift_pct"]):.1f}" cy="{up(r["ks_stat"]):.1f}" r="4" fill="{COLOURS[r["input_drift_class"]]}"><title>{escape(r["feature"])}: {r["input_drift_class"]}</title></circle>' for r in shown)
    axes = f'<path d="M{left} 20V{height - foot}H{width - 20}" fill="none" stroke="black"/><text x="{width // 2}" y="{height - 8}">median shift, %</text><text x="8" y="14">KS</text>'
    legend = "".join(f'<text x="{left + 10 + 110 * i}" y="14" fill="{COLOURS[c]}">{c}</text>' for i, c in enumerate(sorted({r["input_drift_class"] for r in shown})))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">{axes}{legend}{dots}</svg>'


def save_drift_map(report: dict, path: str) -> None:
    """T-11."""
    write_text(drift_map(report), path)

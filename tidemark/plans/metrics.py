"""Metric series: preprocessing for training and inference, and scoring of windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import cyclic_features
from tidemark.operators.frame import exclude_ranges, ordered_features, split_train_test, zero_filled
from tidemark.operators.scaling import Scaler
from tidemark.operators.scoring import classified, ranked_mse, window_errors
from tidemark.operators.windows import WHOLE, last_row_windows


def prepared(df: DataFrame, *, timestamp_col: str, metric_columns: Sequence[str], exclude: Sequence[dict] = (), periods: Mapping[str, float] | None = None, scaler: Scaler | None = None, kind: str = "StandardScaler") -> tuple[DataFrame, Scaler | None]:
    """N-08: without ranges to exclude, with cyclic features, scaled; the scaler is returned if it was fitted here."""
    rows = cyclic_features(exclude_ranges(df, timestamp_col, exclude), timestamp_col, periods)
    if scaler is not None:
        return scaler.transform(rows, metric_columns), None
    new = Scaler(kind).fit(rows, metric_columns)
    return new.transform(rows, metric_columns), new


def split_and_prepared(df: DataFrame, *, timestamp_col: str, metric_columns: Sequence[str], train_end: str, test_start: str, exclude: Sequence[dict] = (), periods: Mapping[str, float] | None = None, kind: str = "StandardScaler", fit_on: DataFrame | None = None) -> tuple[dict[str, DataFrame], Scaler]:
    """N-09 .. N-11, Q-18: train, validation and test, scaled by what was fitted on all training rows (or on fit_on); ranges are excluded
    from training and validation, not from the test."""
    parts = split_train_test(df, timestamp_col, train_end, test_start)
    own = {s: parts.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}
    more = {"timestamp_col": timestamp_col, "metric_columns": metric_columns, "periods": periods}
    scaler = prepared(fit_on, exclude=exclude, kind=kind, **more)[1] if fit_on is not None else None
    train, fitted = prepared(own["train"], exclude=exclude, scaler=scaler, kind=kind, **more)
    scaler = fitted or scaler
    return {"train": train, "validation": prepared(own["validation"], exclude=exclude, scaler=scaler, **more)[0], "test": prepared(own["test"], scaler=scaler, **more)[0]}, scaler


def inferred(df: DataFrame, *, timestamp_col: str, metric_columns: Sequence[str], scaler: Scaler | None, model, threshold: float | None, window_size: int, periods: Mapping[str, float] | None = None, partition_by=WHOLE, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """M-08, Q-17: verdicts of windows (window_ts, mse, predicted) and their ranked features. Missing values are 0; cyclic features are
    inputs of the model, and of the error. A metric series is one row for each instant; WHOLE takes all of it as one."""
    rows = cyclic_features(zero_filled(df, metric_columns), timestamp_col, {} if periods is None else periods)
    rows = scaler.transform(rows, metric_columns) if scaler else rows
    extra = [c for c in rows.columns if c not in df.columns]
    names = [*metric_columns, *extra]
    keys = [] if partition_by == WHOLE else [partition_by] if isinstance(partition_by, str) else list(partition_by)
    rows = ordered_features(rows, metric_columns, extra, keep=[*keys, timestamp_col])
    windows = last_row_windows(rows, names, window_size, timestamp=timestamp_col, order_by=timestamp_col, partition_by=keys or WHOLE)
    errors = window_errors(windows.select(F.struct(*keys, "window_ts").alias("id"), "window"), model)
    pooled = errors.groupBy("id").agg(F.avg("mse").alias("mse"))  # windows that end in one instant are of one size
    verdict = classified(pooled, "mse", threshold) if threshold is not None else pooled
    each = errors.select("id", F.posexplode("feature_mse").alias("feature", "mse")).groupBy("id", "feature").agg(F.avg("mse").alias("mse"))
    named = each.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("feature") + 1))
    return verdict.select("id.*", *[c for c in verdict.columns if c != "id"]), ranked_mse(named, window="id", feature="feature", top_k=top_k).select("id.*", "rank", "feature", "mse", "contribution_percent")

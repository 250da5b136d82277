"""Thresholds and evaluation: F1-optimal and extreme-value thresholds, confusion counts, ROC."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ks_and_wasserstein, ks_p_value, quantiles
from tidemark.operators.order import running_totals


def confusion(df: DataFrame, score: str, truth: str, threshold: float) -> DataFrame:
    """A-18: tp, fp, fn, tn, precision, recall and f1 of scores over the threshold; 0 where a denominator is 0."""
    hit = (F.col(score) > threshold) & ~F.isnan(F.col(score).cast("double"))
    t = F.col(truth).cast("boolean")
    n = df.agg(F.count_if(hit & t).alias("tp"), F.count_if(hit & ~t).alias("fp"), F.count_if(~hit & t).alias("fn"), F.count_if(~hit & ~t).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def _steps(df: DataFrame, score: str, truth: str, following: str | None = None) -> DataFrame:
    """Of each distinct score: tp and fp of a threshold just under it, and the next score."""
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(truth).cast("int").alias("t"), (1 - F.col(truth).cast("int")).alias("f"))
    return running_totals(rows, "score", {"tp": "t", "fp": "f"}, descending=True, following=following)


def threshold_selector(df: DataFrame, score: str, truth: str) -> DataFrame:
    """A-20, E-07: threshold, f1: of the cuts between distinct scores the one with the greatest F1 (ties: the highest), in the middle
    between its score and the next one. No row with fewer than two distinct scores."""
    total = df.agg(F.sum(F.col(truth).cast("long")).alias("pos"))
    cuts = _steps(df, score, truth, "next").filter("next is not null").crossJoin(F.broadcast(total))  # one row
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("pos") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))).otherwise(0.0)
    best = cuts.select(((F.col("score") + F.col("next")) / 2).alias("threshold"), f1.alias("f1"), "score")
    return best.orderBy(F.desc("f1"), F.desc("score")).limit(1).select("threshold", "f1")


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """A-19: auc, with equal scores taken together: the share of pairs in order, halves for ties. Null without both classes."""
    n = df.agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    per = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(truth).cast("int")).alias("t"), F.sum(1 - F.col(truth).cast("int")).alias("f"))
    below = running_totals(per, "score", {"cf": "f", "ct": "t"})
    area = per.join(below, "score").agg(F.sum(F.col("t") * (F.col("cf") - F.col("f") / 2.0)).alias("a"))
    return area.crossJoin(F.broadcast(n)).select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("a") / (F.col("pos") * F.col("neg"))).alias("auc"))


def roc_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """A-19: score, tpr, fpr of each distinct score, scores falling."""
    n = df.agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    return _steps(df, score, truth).crossJoin(F.broadcast(n)).select("score", (F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"))


# Extreme values


@dataclass(frozen=True)
class Tail:
    """A generalised Pareto tail over u: shape, scale, share of scores over u."""

    u: float
    shape: float
    scale: float
    share: float
    n: int
    n_exceed: int


def fit_tail(exceedances: np.ndarray, u: float, n: int) -> Tail | None:
    """E-01: the likeliest tail of the values over u, out of n. For a ratio t of shape to scale the likeliest shape is known in closed
    form, so only t is searched (Grimshaw)."""
    y = np.asarray(exceedances, np.float64) - u
    y = y[y > 0]
    if not len(y):
        return None
    mean, top = y.mean(), y.max()

    def profile(t: float) -> tuple[float, float]:
        if abs(t) < 1e-12 / mean:
            return -len(y) * (math.log(mean) + 1), 0.0
        with np.errstate(all="ignore"):
            k = float(np.log1p(t * y).mean())
        if not math.isfinite(k) or k / t <= 0 or abs(k) < 1e-300:
            return -math.inf, 0.0
        return -len(y) * (math.log(k / t) + k + 1), k

    grid = np.concatenate([-(1 - np.geomspace(1e-6, 0.999, 60)) / top, [0.0], np.geomspace(1e-6, 1e4, 160) / mean])
    grid.sort()
    values = [profile(t)[0] if profile(t)[1] > -1 else -math.inf for t in grid]
    i = int(np.argmax(values))
    a, b = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        if profile(c)[0] >= profile(d)[0]:
            b = d
        else:
            a = c
    t = (a + b) / 2
    shape = profile(t)[1]
    scale = shape / t if abs(shape) > 1e-12 and t else mean
    return Tail(float(u), float(shape), float(scale), len(y) / n, n, len(y))


def tail_threshold(alpha: float, tail: Tail) -> float:
    """E-02: the score that a share alpha of all scores is expected to be over; u if alpha is no smaller than the tail's share."""
    if alpha >= tail.share:
        return tail.u
    r = alpha / tail.share
    if abs(tail.shape) < 1e-6:
        return tail.u - tail.scale * math.log(r)
    return tail.u + tail.scale / tail.shape * (r ** -tail.shape - 1)


def tail_ks(y: np.ndarray, shape: float, scale: float) -> float:
    """E-03: the distance of the sample to its tail, times the root of its size; infinite under 20 values."""
    n = len(y)
    if n < 20:
        return math.inf
    y = np.sort(y)
    with np.errstate(all="ignore"):
        cdf = 1 - np.exp(-y / scale) if abs(shape) < 1e-6 else 1 - np.maximum(0, 1 + shape * y / scale) ** (-1 / shape)
    i = np.arange(1, n + 1)
    return float(max((i / n - cdf).max(), (cdf - (i - 1) / n).max()) * math.sqrt(n))


@dataclass(frozen=True)
class Candidate:
    tail: Tail
    threshold: float
    far: float
    far_error: float
    shape_jump: float
    scale_jump: float
    ks: float


def sweep(train: DataFrame, normal: DataFrame, score: str, *, alpha: float, q_min: float, q_max: float, n_q: int = 50, min_exceed: int = 100, shape_tol: float = 0.1, scale_tol: float = 0.2, shape_max: float = 0.7) -> list[Candidate]:
    """E-04: tails over n_q quantiles whose parameters are steady against the last one taken, with the false alarm rate of their
    threshold on normal scores. Quantiles take one pass; only the tail over the lowest one (a share 1 - q_min of all scores) goes to the
    driver; all false alarm rates take one pass."""
    s = F.col(score).cast("double")
    rows = train.select(s.alias("s")).filter("s is not null and not isnan(s)")
    n, us = rows.count(), quantiles(rows, {"s": F.col("s")}, np.linspace(q_min, q_max, n_q).tolist())["s"]
    if not us:
        return []
    top = np.array([r[0] for r in rows.filter(F.col("s") > us[0]).collect()], np.float64)
    fits = []
    for u in us:
        tail = fit_tail(top[top > u], u, n)
        if tail and tail.n_exceed >= min_exceed and tail.shape < shape_max:
            fits.append((tail, tail_threshold(alpha, tail)))
    if not fits:
        return []
    fars = normal.agg(*(F.avg(F.when((s > t) & ~F.isnan(s), 1.0).otherwise(0.0)) for _, t in fits)).first()
    out: list[Candidate] = []
    for (tail, t), far in zip(fits, fars, strict=True):
        far = math.nan if far is None else far
        jump = scale_jump = 0.0
        if out:
            last = out[-1].tail
            jump = abs(tail.shape - last.shape)
            scale_jump = abs(tail.scale - last.scale) / last.scale if last.scale > 0 else math.inf
            if jump > shape_tol or scale_jump > scale_tol:
                continue
        out.append(Candidate(tail, t, far, abs(far - alpha), jump, scale_jump, tail_ks(top[top > tail.u] - tail.u, tail.shape, tail.scale)))
    return out


def best_candidate(candidates: list[Candidate], near: float = 0.2) -> Candidate | None:
    """E-05: of those nearly as close to their tail as the best, the one with the least error of the false alarm rate, then the lowest u."""
    if not candidates:
        return None
    least = min(c.ks for c in candidates)
    return min((c for c in candidates if c.ks <= least + near), key=lambda c: (c.far_error, c.tail.u))


@dataclass(frozen=True)
class Calibration:
    candidate: Candidate
    ks: float | None = None
    ks_p: float | None = None
    wasserstein: float | None = None
    recall: float | None = None


def calibrated(train: DataFrame, normal: DataFrame, score: str, *, alpha: float, anomalous: DataFrame | None = None) -> Calibration | None:
    """E-06: the threshold for a false alarm rate from more than 1000 training scores, and how it separates anomalous scores."""
    n = train.count()
    if n <= 1000:
        raise ValueError(f"more than 1000 training scores are needed, not {n}")
    best = best_candidate(sweep(train, normal, score, alpha=alpha, q_min=1 - 1000 / n, q_max=1 - 100 / n))
    if best is None or anomalous is None:
        return best and Calibration(best)
    both = normal.select(score, F.lit(True).alias("r")).unionByName(anomalous.select(score, F.lit(False).alias("r")))
    row = ks_and_wasserstein(both, score, "r").first()
    hits = anomalous.agg(F.avg(F.when(F.col(score) > best.threshold, 1.0).otherwise(0.0))).first()[0]
    ks = row["ks"] if row["ks"] is not None else math.nan
    return Calibration(best, ks, ks_p_value(ks, row["n_ref"] or 0, row["n_test"] or 0), row["wasserstein"], math.nan if hits is None else hits)


def far_at(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """E-04: far, the share of scores over a threshold."""
    return df.agg(F.avg(F.when((F.col(score) > threshold) & ~F.isnan(F.col(score).cast("double")), 1.0).otherwise(0.0)).alias("far"))


def ranked_scores(df: DataFrame, group: str, score: str) -> DataFrame:
    """W-14: rank of rows within their group, by score, greatest first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score))))

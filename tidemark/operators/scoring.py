"""Scores of reconstructed windows, and forward passes of recurrent auto-encoders in numpy."""

from __future__ import annotations

import io
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import quantiles
from tidemark.sources.shared import read_bytes, write_bytes

SHIFT = 1e-8


def masked_mean(values: str, mask: str | None = None) -> Column:
    """M-01, Q-16: the mean of an array's masked places, plus 1e-8; of all places without mask."""
    if mask is None:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values) + SHIFT
    top = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return top / F.aggregate(mask, F.lit(0.0), lambda a, m: a + m) + SHIFT


def masked_sum(values: str, mask: str | None = None) -> Column:
    """M-01."""
    return F.aggregate(values if mask is None else F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)


def cell_loss(target: str, reconstruction: str, kind: str = "mse", beta: float = 1.0) -> Column:
    """M-02: the loss of a cell: mse, mae or smooth_l1."""
    d = F.abs(F.col(target) - F.col(reconstruction))
    if kind == "mse":
        return d * d
    if kind == "mae":
        return d
    if kind == "smooth_l1":
        return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    raise ValueError(f"unknown loss: {kind}")


def window_scores(cells: DataFrame, *, window: str = "window_id", step: str = "step", feature: str = "feature", target: str = "target", reconstruction: str = "recon", aggregate: str = "all", kind: str = "mse", masked: bool = True, skip_features: Sequence[int] = ()) -> DataFrame:
    """M-03, M-04, Q-24: score of each window (all), of its steps (step) or of its features (embedding), from a frame of cells.

    Masked: steps whose target is zero in all features are padding and don't count. skip_features are left out, as time features are.
    """
    keys = {"all": [window], "step": [window, step], "embedding": [window, feature]}[aggregate]
    rows = cells.withColumn("_loss", cell_loss(target, reconstruction, kind))
    if masked:
        rows = rows.withColumn("_live", F.max(F.when(F.col(target) != 0, 1).otherwise(0)).over(Window.partitionBy(window, step))).filter("_live = 1")
    if skip_features:
        rows = rows.filter(~F.col(feature).isin(*skip_features))
    return rows.groupBy(*keys).agg((F.avg("_loss") + SHIFT).alias("score"))


def mse_by_feature(cells: DataFrame, *, window: str = "window_id", feature: str = "feature", target: str = "target", reconstruction: str = "recon") -> DataFrame:
    """M-10: mean squared error of each window and feature, over time."""
    return cells.groupBy(window, feature).agg(F.avg(cell_loss(target, reconstruction)).alias("mse"))


def pooled_mse(cells: DataFrame, *, window: str = "window_id", target: str = "target", reconstruction: str = "recon") -> DataFrame:
    """M-10: over time and features."""
    return cells.groupBy(window).agg(F.avg(cell_loss(target, reconstruction)).alias("mse"))


def ranked_mse(mse: DataFrame, *, window: str, feature: str, value: str = "mse", top_k: int = 10, eps: float = 1e-12) -> DataFrame:
    """M-11, O-04, W-14: window, rank (from 1), feature, mse and contribution_percent of the top_k features of each window. Contributions
    are shares of the sum, or equal if the sum is under eps. Ties: the smaller name."""
    by = Window.partitionBy(window)
    rows = mse.withColumns({"rank": F.row_number().over(by.orderBy(F.desc(value), feature)), "_s": F.sum(value).over(by), "_n": F.count("*").over(by)})
    share = F.when(F.col("_s") < eps, 100.0 / F.col("_n")).otherwise(100.0 * F.col(value) / (F.col("_s") + eps))
    return rows.filter(F.col("rank") <= max(0, top_k)).select(window, "rank", feature, value, share.alias("contribution_percent"))


def ranked_documents(ranked: DataFrame, *, window: str, timestamp: str, feature: str, value: str = "mse") -> DataFrame:
    """M-11, S-19: one JSON document for each window, with @timestamp and rank_<j>_feature_name, _mse and _contribution_percent."""
    from tidemark.functions.text import iso_millis

    entries = F.concat(F.lit('"rank_'), F.col("rank"), F.lit('_feature_name":'), F.to_json(F.struct(F.col(feature).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(feature).alias("x")))) - 6), F.lit(',"rank_'), F.col("rank"), F.lit('_mse":'), F.col(value), F.lit(',"rank_'), F.col("rank"), F.lit('_contribution_percent":'), F.col("contribution_percent"))
    rows = ranked.groupBy(window, timestamp).agg(F.array_sort(F.collect_list(F.struct("rank", entries.alias("e")))).alias("r"))
    return rows.select(window, F.concat(F.lit('{"@timestamp":"'), iso_millis(timestamp), F.lit('",'), F.array_join(F.transform("r", lambda x: x["e"]), ","), F.lit("}")).alias("document"))


def verdicts(scores: DataFrame, *, group: str, score: str, threshold: float) -> DataFrame:
    """A-17, E-08, M-07: the greatest score of each group, and whether it is over the threshold."""
    return scores.groupBy(group).agg(F.max(score).alias("max_score"), F.count("*").alias("n_windows")).withColumn("anomaly", (F.col("max_score") > threshold).cast("int"))


def classified(df: DataFrame, score: str, threshold: float | None, out: str = "predicted") -> DataFrame:
    """M-06, Q-15: 1 over the threshold, else 0; a threshold of 0 is one."""
    if threshold is None:
        raise ValueError("no threshold is set")
    return df.withColumn(out, ((F.col(score) > threshold) & ~F.isnan(score)).cast("smallint"))


def mean_of_batch_quantiles(df: DataFrame, *, batch: str, score: str, q: float = 0.9999) -> DataFrame:
    """M-21."""
    return df.groupBy(batch).agg(F.percentile(score, q).alias("v")).agg(F.avg("v").alias("mean_quantile"))


def sampling_weights(df: DataFrame, score: str, q: float = 0.999, out: str = "weight") -> DataFrame:
    """M-20: the score itself, 0 over its quantile."""
    cut = (quantiles(df, {"s": F.col(score)}, [q])["s"] or [None])[0]
    return df.withColumn(out, F.when(F.col(score) > F.lit(cut).cast("double"), 0.0).otherwise(F.col(score).cast("double")))


def weighted_sample(df: DataFrame, weight: str, expected: int, seed: int = 0) -> DataFrame:
    """M-20: rows drawn with replacement in proportion to their weight: each row a Poisson number of times, `expected` rows in the mean."""
    total = df.agg(F.sum(weight).alias("_t"))
    rate = F.col(weight) * expected / F.col("_t")
    # a Poisson number is a sum of Poisson numbers of parts of its rate: parts of at most 8, whose number of draws is how often the running
    # probability stays under a uniform number (beyond 64 draws it is under 1e-30)
    parts = df.crossJoin(F.broadcast(total)).withColumn("_rate", rate).filter("_rate > 0").withColumn("_n", F.ceil(F.col("_rate") / 8).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    parts = parts.withColumn("_rate", F.col("_rate") / F.col("_n")).withColumn("_u", F.rand(seed))
    first = F.exp(-F.col("_rate"))
    times = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(first.alias("p"), first.alias("c"), F.lit(0).alias("k")), lambda a, i: F.struct((a["p"] * F.col("_rate") / i).alias("p"), (a["c"] + a["p"] * F.col("_rate") / i).alias("c"), (a["k"] + F.when(F.col("_u") > a["c"], 1).otherwise(0)).alias("k")))["k"]
    return parts.withColumn("_k", times).filter("_k > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_t", "_u", "_rate", "_n", "_k", "_i", "_j")


def softmax_masking(df: DataFrame, score: str, threshold: float = 0.96, mode: str = "hard", seed: int = 0, out: str = "masked") -> DataFrame:
    """M-19: marks rows over the score's quantile (hard); semi and soft draw as many in the mean among rows over the 0.94 or 0.9
    quantile."""
    low = {"hard": threshold, "semi": 0.94, "soft": 0.9}[mode]
    high, low = (F.lit(q).cast("double") for q in quantiles(df, {"s": F.col(score)}, [threshold, low])["s"] or [None, None])
    if mode == "hard":
        return df.withColumn(out, F.col(score) > high)
    n = df.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score) > low)).first()
    return df.withColumn(out, (F.col(score) > low) & (F.rand(seed) < n[0] / max(1, n[1])))


def validation_error(val_loss: float, val_mean: float, train_mean: float) -> float:
    """M-23."""
    return val_loss * (1 + max(0.0, val_mean / train_mean - 1))


# Reconstruction


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm_layer(x: np.ndarray, w_ih: np.ndarray, w_hh: np.ndarray, b_ih: np.ndarray, b_hh: np.ndarray, reverse: bool = False) -> np.ndarray:
    """One LSTM layer over (batch, steps, features), gates in the order input, forget, cell, output."""
    n, steps, _ = x.shape
    size = w_hh.shape[1]
    h, c, out = np.zeros((n, size)), np.zeros((n, size)), np.empty((n, steps, size))
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        i, f, g, o = np.split(x[:, t] @ w_ih.T + h @ w_hh.T + b_ih + b_hh, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out


class LSTMAutoEncoder:
    """M-12 .. M-14: stacked LSTM encoder and decoder with a linear head, from named weights: encoder.<k>.*, decoder.<k>.*, head.weight
    and head.bias, and for a variational one mean.weight and mean.bias, whose mean is the latent. A layer with *_reverse weights is
    bidirectional."""

    NAMES = ("weight_ih", "weight_hh", "bias_ih", "bias_hh")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {k: np.asarray(v, np.float64) for k, v in weights.items()}

    def _stack(self, x: np.ndarray, part: str) -> np.ndarray:
        k = 0
        while f"{part}.{k}.weight_ih" in self.weights:
            both = [lstm_layer(x, *(self.weights[f"{part}.{k}.{n}"] for n in self.NAMES))]
            if f"{part}.{k}.weight_ih_reverse" in self.weights:
                both.append(lstm_layer(x, *(self.weights[f"{part}.{k}.{n}_reverse"] for n in self.NAMES), reverse=True))
            x = np.concatenate(both, 2)
            k += 1
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self._stack(np.asarray(x, np.float64), "encoder")
        if "mean.weight" in self.weights:
            z = z @ self.weights["mean.weight"].T + self.weights["mean.bias"]
        return self._stack(z, "decoder") @ self.weights["head.weight"].T + self.weights["head.bias"]

    @classmethod
    def load(cls, path: str) -> LSTMAutoEncoder:
        with np.load(io.BytesIO(read_bytes(path))) as f:
            return cls(dict(f))

    def save(self, path: str) -> None:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        write_bytes(out.getvalue(), path)

    @classmethod
    def random(cls, features: int, hidden: int, layers: int = 1, seed: int = 0) -> LSTMAutoEncoder:
        """Widths hidden * 4 ** (layers - 1 - k) in the encoder, mirrored in the decoder; hidden has to be a power of two."""
        if hidden < 1 or hidden & hidden - 1:
            raise ValueError("hidden has to be a power of two")
        rng = np.random.default_rng(seed)
        widths = [hidden * 4 ** (layers - 1 - k) for k in range(layers)]
        out: dict[str, np.ndarray] = {}
        size = features
        for part, ws in (("encoder", widths), ("decoder", widths[::-1])):
            for k, w in enumerate(ws):
                r = 1 / np.sqrt(w)
                out |= {f"{part}.{k}.weight_ih": rng.uniform(-r, r, (4 * w, size)), f"{part}.{k}.weight_hh": rng.uniform(-r, r, (4 * w, w)), f"{part}.{k}.bias_ih": rng.uniform(-r, r, 4 * w), f"{part}.{k}.bias_hh": rng.uniform(-r, r, 4 * w)}
                size = w
        out |= {"head.weight": rng.uniform(-0.1, 0.1, (features, size)), "head.bias": np.zeros(features)}
        return cls(out)


class MetricLSTM(LSTMAutoEncoder):
    """M-13: a bidirectional auto-encoder of metrics whose last features are times. They go through two dense layers (time.0.*, time.1.*)
    with rectifiers and stand beside the metrics; metrics alone are reconstructed, so a reconstruction is narrower than its window."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, x = self.weights, np.asarray(x, np.float64)
        n = x.shape[2] - w["time.0.weight"].shape[1]
        t = x[:, :, n:]
        for k in (0, 1):
            t = np.maximum(0, t @ w[f"time.{k}.weight"].T + w[f"time.{k}.bias"])
        z = self._stack(np.concatenate([x[:, :, :n], t], 2), "encoder")
        return self._stack(z, "decoder") @ w["head.weight"].T + w["head.bias"]

    @classmethod
    def random(cls, features: int, hidden: int, layers: int = 1, seed: int = 0, times: int = 6, width: int = 4) -> MetricLSTM:
        """features: metrics and times together."""
        rng = np.random.default_rng(seed)
        r, out, metrics = 1 / np.sqrt(hidden), {}, features - times
        for part, first in (("encoder", metrics + width), ("decoder", 2 * hidden)):
            for k in range(layers):
                for way in ("", "_reverse"):
                    size = first if k == 0 else 2 * hidden
                    shapes = {"weight_ih": (4 * hidden, size), "weight_hh": (4 * hidden, hidden), "bias_ih": 4 * hidden, "bias_hh": 4 * hidden}
                    out |= {f"{part}.{k}.{n}{way}": rng.uniform(-r, r, s) for n, s in shapes.items()}
        for k, (a, b) in enumerate(((times, 2 * width), (2 * width, width))):
            out |= {f"time.{k}.weight": rng.uniform(-0.4, 0.4, (b, a)), f"time.{k}.bias": np.zeros(b)}
        return cls(out | {"head.weight": rng.uniform(-r, r, (metrics, 2 * hidden)), "head.bias": np.zeros(metrics)})


def divergence(mean: np.ndarray, log_var: np.ndarray) -> np.ndarray:
    """M-14: of each row, the Kullback-Leibler divergence of its normal from the standard one."""
    return -0.5 * (1 + log_var - mean**2 - np.exp(log_var)).sum(tuple(range(1, mean.ndim)))


def drawn(mean: np.ndarray, log_var: np.ndarray, seed: int = 0) -> np.ndarray:
    """M-14: a latent drawn around its mean, as training does it; scoring takes the mean."""
    return mean + np.exp(0.5 * log_var) * np.random.default_rng(seed).standard_normal(mean.shape)


def noisy(x: np.ndarray, sigma: float, seed: int = 0) -> np.ndarray:
    """X-12: multiplicative Gaussian noise, for training alone."""
    return x if sigma <= 0 else x * (1 + sigma * np.random.default_rng(seed).standard_normal(x.shape))


class MeanReconstructor:
    """Each feature's mean over the window: a baseline that needs no weights."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(x.mean(1, keepdims=True), x.shape)


def _by_shape(column: pa.ListArray):
    """Places of the windows of each shape, and these windows as an array cut from the column's buffers; empty ones are left out."""
    n = np.diff(column.offsets.to_numpy())
    steps = column.flatten()
    widths = np.diff(steps.offsets.to_numpy())
    flat = steps.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.r_[0, np.cumsum(n)]
    starts = np.r_[0, np.cumsum(widths)]
    for size, width in {(int(k), int(widths[b])) for k, b in zip(n, begins, strict=False) if k}:
        own = np.array([i for i in range(len(n)) if n[i] == size and widths[begins[i]] == width])
        yield own, flat[starts[begins[own]][:, None] + np.arange(size * width)].reshape(len(own), size, width)


def window_errors(windows: DataFrame, model, *, window: str = "window") -> DataFrame:
    """M-10: mse (over steps and features) and feature_mse (over steps, an array) of each window, in place of the window. Windows are
    reconstructed and compared within Arrow batches, so that a cell is never a row. Empty windows have no error and are left out;
    features beyond the reconstruction's width are inputs alone."""
    held = windows.sparkSession.sparkContext.broadcast(model)
    at = windows.columns.index(window)
    names = [c for c in windows.columns if c != window]

    def run(batches):
        for batch in batches:
            made: list = [None] * batch.num_rows
            for own, x in _by_shape(batch.column(at)):
                y = held.value(x)
                for i, e in zip(own.tolist(), ((x[:, :, : y.shape[2]] - y) ** 2).mean(1), strict=True):
                    made[i] = e
            rows = [*(batch.column(k) for k in range(batch.num_columns) if k != at), pa.array([None if e is None else e.mean() for e in made], pa.float64()), pa.array(made, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(rows, [*names, "mse", "feature_mse"])

    fields = [*(f for f in windows.schema.fields if f.name != window), T.StructField("mse", T.DoubleType()), T.StructField("feature_mse", T.ArrayType(T.DoubleType()))]
    return windows.mapInArrow(run, T.StructType(fields)).filter("mse is not null")


def id_window_scores(windows: DataFrame, model, vectors: Mapping[int, np.ndarray], size: int, *, window: str = "window", out: str = "score", at_once: int = 1024) -> DataFrame:
    """M-03, M-07: the score (mean squared error of all steps and features that the model reconstructs, plus 1e-8) of windows of ids of one
    length, in place of the window. A step's features are its id's vector of `size` numbers, zeros if it has none. Vectors are looked up,
    reconstructed and compared within Arrow batches, so that neither a vector nor a cell is ever a row."""
    ids = np.array(sorted(vectors), np.int64)
    table = np.array([*(vectors[i] for i in ids.tolist()), np.zeros(size)], np.float64)
    held = windows.sparkSession.sparkContext.broadcast((model, ids, table))
    at = windows.columns.index(window)
    names = [c for c in windows.columns if c != window]

    def run(batches):
        model, ids, table = held.value
        for batch in batches:
            column = batch.column(at)
            if not len(column):
                continue
            flat = column.flatten().to_numpy(zero_copy_only=False)
            place = np.searchsorted(ids, flat)
            place[(place == len(ids)) | (np.r_[ids, 0][place] != flat)] = len(ids)
            place = place.reshape(len(column), -1)
            scores = np.empty(len(column))
            for i in range(0, len(column), at_once):
                x = table[place[i : i + at_once]]
                y = model(x)
                scores[i : i + at_once] = ((x[:, :, : y.shape[2]] - y) ** 2).mean((1, 2)) + SHIFT
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != at), pa.array(scores)], [*names, out])

    return windows.mapInArrow(run, T.StructType([*(f for f in windows.schema.fields if f.name != window), T.StructField(out, T.DoubleType())]))

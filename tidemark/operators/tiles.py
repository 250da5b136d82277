"""Statistics over all pairs of a table of vectors, whose pairs are never rows: blocks of vectors meet in tiles, and only counts leave a tile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import dropped, written

#: Up to this number of blocks (each vector is sent as many times), as long as a block stays under MOST_BYTES.
BLOCKS = 64
BLOCK_ROWS = 1024
MOST_BYTES = 2 << 20
#: Pairs that are compared at once, so that they stay in a core's cache.
AT_ONCE = 1 << 16
#: Distances are counted by their bits, 1,024 bins for each power of two from 2 ** -54 on; what is at 4 or over is NaN.
SHIFT = 42
LOW = int(np.float64(2.0**-54).view(np.int64))
NONE = int(np.float64(4.0).view(np.int64))
FINE = 12


def _packed(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int] | None:
    """The vectors as one row for each block (b, m, data: ranks of keys, then components by column), with the numbers of blocks and of pairs.
    Rows of a key share a block, so that only pairs within a block can be of one key. Null keys meet nothing; null vectors, empty ones
    and those with null components have no distance, but their pairs count."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null")
    rows = rows.withColumn("v", F.when((F.size("v") > 0) & ~F.exists("v", F.isnull), F.col("v")))
    size = F.when(F.col("v").isNotNull(), F.size("v"))
    keys = rows.groupBy("k").agg(F.count("*").cast("decimal(18, 0)").alias("n"), F.count("v").alias("good"), F.min(size).alias("least"), F.max(size).alias("most"))
    r = keys.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("good").alias("good"), F.min("least").alias("least"), F.max("most").alias("most")).first()
    pairs = (int(r["n"] or 0) ** 2 - int(r["same"] or 0)) // 2
    if not r["good"]:
        return None if not pairs else (df.sparkSession.createDataFrame([], "b int, m long, data binary"), 0, pairs)
    width = r["most"]
    if r["least"] != width:
        raise ValueError(f"vectors have {r['least']} to {width} components")
    blocks = max(min(BLOCKS, -(-r["good"] // BLOCK_ROWS)), -(-r["good"] * (width + 1) * 8 // MOST_BYTES))
    ranked = rows.filter("v is not null").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("r", F.dense_rank().over(Window.partitionBy("b").orderBy("k")).cast("long"))

    def block(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("r", kind="stable")
        x = np.stack(f["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"b": f["b"].iloc[:1].to_numpy(), "m": [len(f)], "data": [f["r"].to_numpy(np.int64).tobytes() + np.ascontiguousarray(x.T).tobytes()]})

    return written(ranked.select("b", "r", "v").groupBy("b").applyInPandas(block, "b int, m long, data binary"), "vector-blocks"), blocks, pairs


def _tiles(packed: DataFrame, blocks: int) -> DataFrame:
    """Each pair of blocks once. Few tiles for each task, dealt by number, since their work is not in their bytes."""
    n = blocks * (blocks + 1) // 2
    xy = packed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int"))).alias("y"))
    a = packed.select(F.col("b").alias("x"), F.col("m").alias("m"), F.col("data").alias("a"))
    b = packed.select(F.col("b").alias("y"), F.col("m").alias("n"), F.col("data").alias("c"))
    return xy.join(a, "x").join(b, "y").select("x", "y", "m", "a", "n", "c").repartition(max(min(n, 128), n // 16))


def _block(data: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, columns and norms."""
    x = np.frombuffer(data, np.float64).reshape(-1, m)[1:]
    square = np.zeros(m)
    for c in x:
        square += c * c
    return np.frombuffer(data, np.int64, m), x, np.sqrt(square)


def _distances(batch):
    """1 - cosine of the pairs of each tile, in stretches, not under 0; sums go by component in order, so that each pass sees the same bits."""
    for x, y, m, a, n, c in zip(*(batch.column(i) for i in range(6)), strict=True):
        ra, va, na = _block(a.as_buffer(), m.as_py())
        rc, vc, nc = _block(c.as_buffer(), n.as_py())
        one, step = x.as_py() == y.as_py(), max(1, AT_ONCE // len(rc))
        for i in range(0, len(ra), step):
            own = slice(i, i + step)
            for j in range(0, len(rc), AT_ONCE):
                other = slice(j, j + AT_ONCE)
                with np.errstate(all="ignore"):
                    d = va[0, own, None] * vc[0, other]
                    part = np.empty_like(d)
                    for p, q in zip(va[1:], vc[1:], strict=True):
                        d += np.multiply(p[own, None], q[other], out=part)
                    d /= np.multiply(na[own, None], nc[other], out=part)
                    np.subtract(1.0, d, out=d)
                    np.maximum(d, 0.0, out=d)
                d = d[ra[own, None] < rc[other]] if one else d.ravel()
                if np.isnan(d.sum()):
                    d[np.isnan(d)] = np.nan  # of one sign
                if len(d):
                    yield d


def _coarse(tiny: float):
    """bin, n, over of each task's pairs; as bin -1 the number under tiny, with the least distance over tiny as over."""
    bins = ((NONE - LOW) >> SHIFT) + 2

    def run(batches):
        import pyarrow as pa

        counts, under, over = np.zeros(bins, np.int64), 0, math.inf
        for batch in batches:
            for d in _distances(batch):
                under += int(np.count_nonzero(d < tiny))
                near = d > tiny
                near &= d < over
                if near.any():
                    over = float(d[near].min())
                at = d.view(np.int64) - LOW
                at >>= SHIFT
                at += 1
                np.clip(at, 0, bins - 1, out=at)
                counts += np.bincount(at, minlength=bins)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[counts[at], under]), pa.array([None] * len(at) + [over], pa.float64())], ["bin", "n", "over"])

    return run


def _fine(ranges: list[tuple[int, int, int]]):
    """range, bin, n: the pairs whose bits are in the ranges (low, high, shift)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in ranges]
            for d in _distances(batch):
                bits = d.view(np.int64)
                for (low, high, shift), f in zip(ranges, found, strict=True):
                    near = bits >= low
                    near &= bits < high
                    some = bits[near]
                    if len(some):
                        f.append((some - low) >> shift)
                    if len(f) > 256:
                        f[:] = [np.concatenate(f)]
            for k, f in enumerate(found):
                if f:
                    at, n = np.unique(np.concatenate(f), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(at), pa.array(n.astype(np.int64))], ["range", "bin", "n"])

    return run


def _at(bits: int) -> float:
    return float(np.int64(bits).view(np.float64))


def _ranked(tiles: DataFrame, coarse: dict[int, int], ranks: list[int], few: int) -> dict[int, float]:
    """The distances at the ranks. A bin that holds one is cut again and again, until it has few pairs or is one number."""
    found, wanted, top = {}, {}, ((NONE - LOW) >> SHIFT) + 1
    at, before = sorted(coarse), 0
    for b in at:
        for r in (r for r in ranks if before <= r < before + coarse[b]):
            if b == top:
                found[r] = math.nan
            else:
                low = LOW + ((b - 1) << SHIFT)
                wanted.setdefault((0, LOW) if b == 0 else (low, low + (1 << SHIFT)), [coarse[b], []])[1].append((r, r - before))
        before += coarse[b]
    while wanted:
        ranges = [(low, high, 0 if n <= few else max(0, (high - low - 1).bit_length() - FINE)) for (low, high), (n, _) in wanted.items()]
        counts: list[dict[int, int]] = [{} for _ in ranges]
        for r in tiles.mapInArrow(_fine(ranges), "range long, bin long, n long").groupBy("range", "bin").agg(F.sum("n").alias("n")).collect():  # bins, or few numbers
            counts[r["range"]][r["bin"]] = r["n"]
        rest: dict = {}
        for (low, _, shift), (_, asked), bins in zip(ranges, wanted.values(), counts, strict=True):
            before = 0
            for b in sorted(bins):
                for r, k in ((r, k) for r, k in asked if before <= k < before + bins[b]):
                    if shift == 0:
                        found[r] = _at(low + b)
                    else:
                        rest.setdefault((low + (b << shift), low + ((b + 1) << shift)), [bins[b], []])[1].append((r, k - before))
                before += bins[b]
        wanted = rest
    return found


def distance_stats(df: DataFrame, *, key: str, vector: str, tiny: float = 1e-4, few: int = 100_000) -> DataFrame:
    """M-16, M-17: lower median, least, least over tiny, 0.1 quantile and share under tiny of 1 - cosine over all pairs of a table of vectors
    with different keys (left < right), exact. Pairs of a vector that is null have no distance, and those of a zero vector NaN, which is
    over all numbers.

    All pairs are compared, in as many passes as the ranks need: one that counts by bins, one that cuts the bins of the wanted ranks, and
    one that reads what is left of them. Each vector is sent BLOCKS times at most, until a block has MOST_BYTES."""
    spark = df.sparkSession
    got = _packed(df, key, vector)
    median = least = least_over = q10 = share = None
    if got is not None:
        packed, blocks, pairs = got
        coarse: dict[int, int] = {}
        under, over = 0, math.inf
        tiles = _tiles(packed, blocks) if blocks else None
        if tiles is not None:
            for r in tiles.mapInArrow(_coarse(tiny), "bin long, n long, over double").groupBy("bin").agg(F.sum("n").alias("n"), F.min("over").alias("over")).collect():  # bins
                if r["bin"] == -1:
                    under, over = r["n"], r["over"]
                else:
                    coarse[r["bin"]] = r["n"]
        n = sum(coarse.values())
        if n:
            p = 0.1 * (n - 1)
            low, high = math.floor(p), math.ceil(p)
            at = _ranked(tiles, coarse, sorted({0, low, high, (n - 1) // 2}), few)
            at = {k: min(v, 2.0) if v == v else v for k, v in at.items()}
            median, least = at[(n - 1) // 2], at[0]
            q10 = at[low] if low == high else (high - p) * at[low] + (p - low) * at[high]
            least_over = min(over, 2.0) if over < math.inf else math.nan if coarse.get(((NONE - LOW) >> SHIFT) + 1) else None
        share = under / pairs if pairs else None
        if tiles is not None:
            dropped(packed)
    return spark.createDataFrame([(median, least, least_over, q10, share)], "median double, least double, least_over double, q10 double, share_under double")

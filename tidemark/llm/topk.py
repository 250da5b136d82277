"""Exact top-k search by inner product of integer vectors: KD-trees per shard, best-first with box bounds.

A shard is a bounded number of rows. Its tree splits at medians of the widest side and keeps tight boxes; a query opens boxes in the
order of the highest score that any point of them could have, and stops when that is below its k-th score. Queries go in blocks, which meet
shards by a join: neither queries nor rows ever come together in one place, and a task builds the trees of its shards once. Some
shards are searched first; the k-th scores found there go with the queries to all others, which answer with better rows only.

Vectors that are null, or hold null or non-finite components, and rows with a null id take no part; nor do vectors with a component so
large that a score could leave 64 bits (floor(scale * x) beyond the root of 2 ** 63 over the dimension). Vectors of another dimension than a
query's are no candidates for it. A row is never its own candidate, nor are repeated rows of its id; repeated candidates are ranked
one after another. Of the inputs only vec_id and embedding are read, whatever other columns there are. An empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.vectors import packed_vectors


class KDTree:
    """Nodes as arrays: boxes, children (leaves: -1) and spans of rows. Rows of a leaf are in order of id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        lo, hi, left, right, span = [], [], [], [], []

        def grow(rows: np.ndarray, at: int) -> int:
            me = len(lo)
            p = points[rows]
            lo.append(p.min(0))
            hi.append(p.max(0))
            left.append(-1)
            right.append(-1)
            span.append((at, at + len(rows)))
            axis = int(np.argmax(hi[me] - lo[me]))
            if len(rows) > leaf and hi[me][axis] > lo[me][axis]:
                half = np.argsort(p[:, axis], kind="stable")
                cut = len(rows) // 2
                a, b = np.sort(half[:cut]), np.sort(half[cut:])
                left[me] = grow(rows[a], at)
                right[me] = grow(rows[b], at + cut)
            else:
                order[at : at + len(rows)] = rows
            return me

        if len(points):
            grow(order.copy(), 0)
        self.lo, self.hi, self.left, self.right, self.span = np.array(lo), np.array(hi), left, right, span
        self.points, self.ids = points[order], ids[order]

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The highest (score, -id), highest first, without scores under the floor: what the k-th score elsewhere shows to be too low. Boxes
        whose bound equals the k-th score are opened: a smaller id may be in them."""
        best: list[tuple[int, int]] = []
        if not len(self.points):
            return best
        bound = np.maximum(query * self.lo, query * self.hi).sum(1).tolist()
        heap = [(-bound[0], 0)]
        least = floor
        while heap:
            b, node = heappop(heap)
            if least is not None and -b < least:
                break
            if self.left[node] < 0:
                a, z = self.span[node]
                scores = self.points[a:z] @ query
                go = np.arange(z - a) if least is None else np.flatnonzero(scores >= least)
                found = [(s, -i) for s, i in zip(scores[go].tolist(), self.ids[a:z][go].tolist(), strict=True) if i != own]
                if found:
                    best = sorted(best + found, reverse=True)[:k]
                    if len(best) == k:
                        least = best[-1][0]
            else:
                for c in (self.left[node], self.right[node]):
                    if least is None or bound[c] >= least:
                        heappush(heap, (-bound[c], c))
        return best


def _whole(raw: list[bytes], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension as integers, and which of them are small enough that no score leaves 64 bits."""
    x = np.floor(scale * np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1))
    ok = (np.abs(x) < np.sqrt(2.0**63 / x.shape[1]) * 0.999).all(1)
    return np.where(ok[:, None], x, 0).astype(np.int64), ok


def _shards(data: DataFrame, scale: int, shard: int) -> DataFrame:
    """shard, dim, ids, points: rows of (vec_id, vec) in blocks of one dimension."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def row(size: int) -> pa.RecordBatch:
            nonlocal number
            ids, raw = held.pop(size)
            points, ok = _whole(raw, scale)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size // 8], pa.int32()), pa.array([np.array(ids, "<i8")[ok].tobytes()], pa.binary()), pa.array([points[ok].astype("<i8").tobytes()], pa.binary())], ["shard", "dim", "ids", "points"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v:
                    ids, raw = held.setdefault(len(v), ([], []))
                    ids.append(i)
                    raw.append(v)
                    if len(ids) == shard:
                        yield row(len(v))
        for size in list(held):
            yield row(size)

    return data.select("vec_id", "vec").mapInArrow(pack, "shard long, dim int, ids binary, points binary")


def _met(shards: DataFrame, asked: DataFrame, floors: DataFrame | None, k: int, scale: int, shards_per_task: int) -> DataFrame:
    """query, query_id, vec_id, score: of each query and shard, the rows that may be among the k best. Shards are dealt to groups, and every
    block of queries goes to every group."""
    n = shards.count()
    if not n:
        return shards.sparkSession.createDataFrame([], "query long, query_id long, vec_id long, score long")
    groups = max(1, min(n, max(64, n // shards_per_task)))
    rows = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, "query", "left")
    blocks = rows.groupBy("block").agg(F.collect_list(F.struct("query", "vec_id", "vec", "floor")).alias("asked"))
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = shards.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups))).join(blocks, "group").select("shard", "dim", "ids", "points", "asked")

    def search(batches):
        trees: OrderedDict[int, KDTree] = OrderedDict()
        for batch in batches:
            for at in range(batch.num_rows):
                number, dim = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if number not in trees:
                    ids = np.frombuffer(batch.column(2)[at].as_py(), "<i8")
                    trees[number] = KDTree(np.frombuffer(batch.column(3)[at].as_py(), "<i8").reshape(-1, dim), ids)
                    if len(trees) > 4:
                        trees.popitem(last=False)
                own = [q for q in batch.column(4)[at].as_py() if len(q["vec"]) == 8 * dim]
                if not own:
                    continue
                vecs, ok = _whole([q["vec"] for q in own], scale)
                out = [(q["query"], q["vec_id"], -i, s) for q, v, fits in zip(own, vecs, ok, strict=True) if fits for s, i in trees[number].search(v, q["vec_id"], k, q["floor"])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(search, "query long, query_id long, vec_id long, score long")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, scale: int = 1024, shard: int = 4096, block: int = 4096, first: int = 16, shards_per_task: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and embedding; components are floor(scale * x). shard, block: rows of a shard
    and queries of a block, at most. One shard in `first` is searched first, for the k-th scores."""
    ready = lambda df: packed_vectors(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding", ("vec_id",)).filter("vec_id is not null and vec is not null")
    shards = written(_shards(ready(rows), scale, shard), "shards")
    asked = written(ready(queries).distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = asked.withColumn("block", F.floor(F.col("query") / block))
    early = F.pmod(F.xxhash64("shard", F.lit(3)), F.lit(first)) == 0
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = written(top(_met(shards.filter(early), asked, None, k, scale, shards_per_task)).drop("rank"), "found")
    floors = found.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k).select("query", "floor")
    rest = _met(shards.filter(~early), asked, floors, k, scale, shards_per_task)
    return top(found.unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows.filter("vec_id % 100 = 0"), rows)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

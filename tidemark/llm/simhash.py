"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with exclusive-or and bit counts of whole tiles. Distinct ones are sorted by their bit counts, of all 64 bits
and of four quarters; two tiles, or two blocks within tiles, are skipped if those counts alone put every pair beyond the radius. Copies
of a fingerprint are one node, and a pair of tiles returns a spanning forest of its links, never all pairs.

Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated rows each give a row. Rows with
a null id take part; a component's id is its smallest id that is not null. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mapped, table, written
from tidemark.llm.components import Forest, components


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer. Only A-Z are lower-cased; words are split by ASCII white space."""
    import xxhash

    split = (text or "").encode().lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()
    k = min(words, len(split))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, last[k - 1 :], strict=False)], "<u8")
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 4, seed: int = 42) -> DataFrame:
    """The kept columns and fp (long)."""

    return mapped(docs, text, keep, T.StructType([T.StructField("fp", T.LongType())]), lambda: lambda texts: [pa.array([fingerprint(t, words, seed) for t in texts], pa.int64())])


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


def _blocks(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest bit counts of the quarters in each block of a tile."""
    q, at = _quarters(fps), np.arange(0, len(fps), size)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints of tiles a and b (None: of a with itself) with the same components as all links within the radius."""
    fps = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    forest = Forest(len(fps))
    lo_a, hi_a = _blocks(a, block)
    lo_b, hi_b = (lo_a, hi_a) if b is None else _blocks(b, block)
    for i in range(len(lo_a)):
        apart = np.maximum(0, np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b)).sum(1)
        mine = a[i * block : (i + 1) * block, None]
        for j in np.flatnonzero(apart <= radius).tolist():
            if b is None and j < i:
                continue
            near = np.bitwise_count(mine ^ other[None, j * block : (j + 1) * block]) <= radius
            u, v = np.nonzero(near)
            u, v = u + i * block, v + j * block + shift
            if b is None:
                u, v = u[u < v], v[u < v]
            if u.size:
                forest.link(u, v)
    child, parent = forest.edges()
    return fps[child].view("<i8"), fps[parent].view("<i8")


def links(distinct: DataFrame, radius: int = 4, tile: int = 16_384, pairs_per_task: int = 8) -> DataFrame:
    """u, v: a forest of the links between distinct fingerprints (column fp) that differ in at most `radius` bits.

    A tile holds up to `tile` fingerprints of one bit count, so a pair of tiles is at most 16 * tile bytes in a task.
    """

    def cut(batches):
        from pyspark import TaskContext

        base, n, held = TaskContext.get().partitionId() << 32, 0, np.zeros(0, "<u8")

        def rows(parts: list[np.ndarray]):
            nonlocal n
            out = []
            for p in parts:
                q = _quarters(p)
                out.append((base | n, int(np.bitwise_count(p[0])), q.min(0).tolist(), q.max(0).tolist(), p.tobytes()))
                n += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema(kinds))

        for batch in batches:
            held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False).view("<u8")])
            ends = np.flatnonzero(np.diff(np.bitwise_count(held))) + 1
            parts = [x[at : at + tile] for x in np.split(held, ends) for at in range(0, len(x), tile)] if held.size else []
            if parts:
                held = parts.pop() if len(parts[-1]) < tile else np.zeros(0, "<u8")
            if parts:
                yield rows(parts)
        if held.size:
            yield rows([held])

    names = ["tile", "ones", "lo", "hi", "fps"]
    kinds = [("tile", pa.int64()), ("ones", pa.int32()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("fps", pa.binary())]
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    order = [F.bit_count("fp"), *quarters, F.col("fp")]
    tiles = written(distinct.select("fp").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "tile long, ones int, lo array<int>, hi array<int>, fps binary"), "tiles")
    heads = tiles.select("tile", "ones", "lo", "hi")
    left = heads.select(F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)).alias("ones"))
    apart = sum(F.greatest(F.lit(0), F.col("lo")[i] - F.col("ahi")[i], F.col("alo")[i] - F.col("hi")[i]) for i in range(4))
    pairs = left.join(heads.withColumnRenamed("tile", "b").withColumn("same", F.col("ones")), "ones").filter(apart <= radius)
    # among tiles of one bit count, each pair once; the explosion by differences 0 .. radius has the other pairs once already
    ones_of = heads.select(F.col("tile").alias("a"), F.col("ones").alias("a_ones"))
    pairs = written(pairs.join(ones_of, "a").filter("a_ones <> same or a <= b").select("a", "b"), "pairs")
    tasks = max(1, -(-pairs.count() // pairs_per_task))  # pairs are few bytes but much work: their number deals them, not their size
    both = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")

    def compare(batches):
        for batch in batches:
            for x, y, fa, fb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "fa", "fb")), strict=True):
                u, v = tile_forest(np.frombuffer(fa, "<u8"), None if x == y else np.frombuffer(fb, "<u8"), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return both.select("a", "b", "fa", "fb").repartition(tasks, "a", "b").mapInArrow(compare, "u long, v long")


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """fp, root, first: each distinct fingerprint with its component's smallest fingerprint and its own smallest id."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    fps = written(fingerprints(docs, text, ("doc_id",), words, seed), "fingerprints")
    classes = _classes(fps, radius)
    firsts = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of = classes.join(firsts, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """The rows of docs, one of each group: that with the smallest id (null ids come last; among rows of equal id and fingerprint, any
    one)."""
    whole = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), F.col(text).alias("text"))
    hashed = written(fingerprints(whole, "text", ("doc_id", "row", "text"), words, seed), "hashed")
    fps = hashed.select("doc_id", "fp")
    least = _classes(fps, radius).groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("fp"))).alias("m")).select(F.col("m.first").alias("id"), F.col("m.fp").alias("own"))
    copies = fps.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    stay = least.join(copies, least["id"].eqNullSafe(copies["doc_id"]) & (least["own"] == copies["fp"])).select("id", "own", "n")
    found = hashed.join(stay, (hashed["fp"] == stay["own"]) & hashed["doc_id"].eqNullSafe(stay["id"]))
    single = found.filter("n = 1").select("row", "text")
    repeated = found.filter("n > 1").groupBy("fp").agg(F.first(F.struct("row", "text")).alias("x")).select("x.row", "x.text")
    return single.unionByName(repeated).select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))

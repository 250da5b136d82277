"""Embedding near-duplicates by NN-descent: a neighbour graph is refined until it settles, and links at the threshold are kept.

1. Equal vectors of a label are one node. Nodes that fall on the same sides of random hyperplanes are compared in bounded groups: the
   first lists of k neighbours. A label's size sets its number of hyperplanes, and that the number of tables: two vectors at the
   threshold share a side in some table with probability `found`. A side of more than GROUP nodes is dealt by hash, in each table anew;
   there pairs meet less often, and the rounds have to find them.
2. Rounds of local joins: among the neighbours of a node, and those that have it as neighbour, all pairs are compared, and a pair goes
   to a list that it improves. Rounds end when few lists change. Links that any comparison sees stay, listed or not: of each group a
   spanning forest of its links.
3. A list is saturated if all its k neighbours are links. Its node then gets a second list, of the k most similar nodes outside its
   component, and the search goes on: close neighbours cannot crowd out a link that leads elsewhere. Within a component links are counted
   in tiles, exactly, however dense it is, and only counts leave a tile.
4. In the end all labels, of any size, are compared in tiles, which find the links between components that the graph lacks: the result is
   exact, and does not depend on the sizes of labels or on luck. Tiles are quadratic in a label's distinct vectors; a tile gets two
   blocks. Labels of more than `whole` nodes are audited before that: a sample of nodes is compared with all rows of their labels, and
   the recall is logged. With more than one audit, links that an audit finds are added and further hyperplanes and rounds follow, until a
   fresh sample lacks none and no list is saturated. Audits only leave the tiles less to find.

Only vectors with equal labels, not null, and equal dimension are compared. Vectors that are null, zero or hold null or non-finite
components, and rows without label, link with nothing: they are their own components. Rows with a null id take part, but never name a
component; alone, theirs is null and they are kept. Repeated rows link with each other. An empty table gives no rows.
"""

from __future__ import annotations

import logging
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.components import Forest, components
from tidemark.llm.vectors import packed_vectors

#: Nodes of a group that a task compares at once.
GROUP = 512
#: Nodes of a block of a tile, at least and at most; a label of up to 16 * BLOCKS[1] nodes has 16 blocks at most.
BLOCKS = 2048, 8192
_LOG = logging.getLogger(__name__)
#: kind: entry of a list of nodes outside the own component (0) or in it (1); a link that joins components (2).
_LISTS = "u long, v long, sim double, kind int"


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    with np.errstate(over="ignore", under="ignore"):
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _streamed(frames, key: int, work):
    """work(rows) for each run of equal keys in batches sorted by column `key`; rows as one table."""
    held: list[pa.RecordBatch] = []
    for batch in frames:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield from work(pa.Table.from_batches(held))
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from work(pa.Table.from_batches(held))


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, kind: np.ndarray | int):
    kind = np.broadcast_to(np.asarray(kind, np.int32), u.shape)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()), pa.array(kind, pa.int32())], ["u", "v", "sim", "kind"])


def _links(ids: np.ndarray, sim: np.ndarray, threshold: float):
    """A spanning forest of the links among compared nodes: it joins what all of them join."""
    u, v = np.nonzero(np.triu(sim >= threshold, 1))
    if len(u):
        forest = Forest(len(ids))
        forest.link(u, v)
        u, v = forest.edges()
        yield _best(np.maximum(ids[u], ids[v]), np.minimum(ids[u], ids[v]), sim[u, v], 2)


@lru_cache(4096)
def _shape(n: int, threshold: float, tables: int, found: float) -> tuple[int, int]:
    """Hyperplanes and tables, at least `tables`, for a label of n nodes. Vectors at an angle a are on one side of a hyperplane with
    probability 1 - a / pi."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / (GROUP / 4))))))
    meet = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return bits, max(tables, int(np.ceil(np.log(1 - found) / np.log1p(-meet)))) if 0 < meet < 1 else tables


def _first_lists(nodes: DataFrame, sizes: DataFrame, k: int, tables: int, seed: int, threshold: float, found: float = 0.999) -> DataFrame:
    """Lists, and links, from groups of nodes (node, part, root, vec) on the same sides of random hyperplanes. sizes: n nodes of a part."""

    def sides(batches):
        for batch in batches:
            out = []
            node, root, raw, n = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for i, part in enumerate(batch.column(1).to_pylist()):
                x = _unit([raw[i]])[0]
                bits, ways = _shape(n[i], threshold, tables, found)
                code = (_planes(len(x), ways * bits, seed) @ x > 0).reshape(ways, bits) @ (1 << np.arange(bits))
                out += [(node[i], f"{part}:{t}:{c}", root[i], raw[i]) for t, c in enumerate(code.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["node", "side", "root", "vec"])

    dealt = nodes.join(sizes, "part").select("node", "part", "root", "vec", "n").mapInArrow(sides, "node long, side string, root long, vec binary")
    full = dealt.groupBy("side").agg(F.count("*").alias("n"))
    # the side names the table: each table deals its overfull sides anew
    salted = dealt.join(full, "side").withColumn("place", F.xxhash64("side", F.pmod(F.xxhash64("node", "side", F.lit(seed)), F.ceil(F.col("n") / GROUP)))).select("place", "node", "root", "vec")

    def compare(rows):
        ids, root = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        for at in range(0, len(ids), 2 * GROUP):  # groups of about GROUP nodes, dealt by hash
            mine = ids[at : at + 2 * GROUP]
            if len(mine) < 2:
                continue
            x = _unit(rows.column(3).slice(at, len(mine)).to_pylist())
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            yield from _links(mine, sim, threshold)
            same = root[at : at + len(mine), None] == root[None, at : at + len(mine)]
            for kind in (0, 1) if same.sum() > len(mine) else (0,):
                s = np.where(same == bool(kind), sim, -2)
                top = np.argpartition(-s, min(k, len(mine) - 1) - 1, 1)[:, : min(k, len(mine) - 1)]
                u = np.repeat(np.arange(len(mine)), top.shape[1])
                v = top.ravel()
                ok = s[u, v] > -2
                yield _best(mine[u[ok]], mine[v[ok]], s[u[ok], v[ok]], kind)

    return salted.repartition("place").sortWithinPartitions("place").mapInArrow(lambda b: _streamed(b, 0, compare), _LISTS)


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    key = dim, n, seed
    if key not in _HELD:
        if len(_HELD) >= 32: 
            _HELD.clear()
        _HELD[key] = np.random.default_rng([seed, dim]).standard_normal((n, dim))
    return _HELD[key]


_HELD: dict = {}


def _cut(lists: DataFrame, k: int) -> DataFrame:
    """The k most similar of each list, and all links."""
    once = lists.groupBy("u", "v", "kind").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u", "kind", F.when(F.col("kind") == 2, F.col("v"))).orderBy(F.desc("sim"), "v")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("u", "v", "sim", "kind")


def _parted(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of these nodes (node, root), with the kind of their entries by today's components; links as they are."""
    of = [nodes.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv"]
    own = (F.col("u_root") == F.col("v_root")).cast("int")
    return lists.filter("kind < 2").join(of[0], "u").join(of[1], "v").select("u", "v", "sim", own.alias("kind")).unionByName(lists.filter("kind = 2"))


def _round(state: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Lists improved by a local join, and the links it sees. At most 2 * k of a kind that have a node as neighbour join at it, the most
    similar ones; saturated lists are not improved, as their nodes are searched outside their component later."""
    lists = state.filter("kind < 2")

    def low(kind: int) -> Column:
        n = F.count(F.when(F.col("kind") == kind, 1))
        least = F.min(F.when(F.col("kind") == kind, F.col("sim")))
        return F.when(n < k, F.lit(-2.0)).when(least >= threshold, F.lit(2.0)).otherwise(least).alias(f"low{kind}")

    floor = lists.groupBy(F.col("u").alias("b")).agg(low(0), low(1))
    back = lists.withColumn("r", F.row_number().over(Window.partitionBy("v", "kind").orderBy(F.desc("sim"), "u"))).filter(F.col("r") <= 2 * k)
    at = lists.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(back.select(F.col("v").alias("a"), F.col("u").alias("b"))).distinct()
    full = at.join(floor, "b").join(nodes.select(F.col("node").alias("b"), "root", "vec"), "b").select("a", "b", "root", "low0", "low1", "vec")

    def local(rows):
        ids, root, low0, low1 = (rows.column(i).to_numpy() for i in (1, 2, 3, 4))
        if len(ids) > 1:
            x = _unit(rows.column(5).to_pylist())
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            yield from _links(ids, sim, threshold)
            same = root[:, None] == root[None, :]
            u, v = np.nonzero(sim > np.where(same, low1[:, None], low0[:, None]))
            if len(u):
                yield _best(ids[u], ids[v], sim[u, v], same[u, v])

    found = full.repartition("a").sortWithinPartitions("a").mapInArrow(lambda b: _streamed(b, 0, local), _LISTS)
    return _cut(found.unionByName(state), k)


def _within(classes: DataFrame, threshold: float) -> DataFrame:
    """node, n_links: exact counts within each component (node, root, size, copies, vec). A component of more than GROUP nodes goes in
    blocks, and each pair of blocks meets once."""
    blocks = F.ceil(F.col("size") / GROUP)
    placed = classes.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    keyed = placed.withColumn("place", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).select("place", "root", "node", "copies", "block", (F.col("block") == F.col("other")).alias("same"), "vec")

    def count(rows):
        root, node, block = (rows.column(i).to_numpy() for i in (1, 2, 4))
        copies = rows.column(3).to_numpy()
        for r in np.unique(root):  # more than one only if hashes meet
            at = np.flatnonzero(root == r)
            x = _unit(rows.column(6).take(pa.array(at)).to_pylist())
            b, c = block[at], copies[at]
            n = np.zeros(len(at), np.int64)
            one = len(np.unique(b)) == 1
            for i in range(0, len(at), 1024):
                sim = x[i : i + 1024] @ x.T >= threshold
                sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = False
                if not one:
                    sim &= b[i : i + 1024, None] != b[None, :]
                n[i : i + 1024] = (sim * c).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n)], ["node", "n"])

    counted = keyed.repartition("place").sortWithinPartitions("place").mapInArrow(lambda b: _streamed(b, 0, count), "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n_links"))


def _tiles(nodes: DataFrame, threshold: float) -> DataFrame:
    """All links between components of nodes (node, part, root, vec), as spanning forests of roots: each pair of a label's blocks meets
    once."""
    sizes = nodes.groupBy("part").agg(F.ceil(F.count("*") / F.greatest(F.lit(BLOCKS[0]), F.least(F.lit(BLOCKS[1]), F.ceil(F.count("*") / 16)))).alias("blocks"))
    placed = nodes.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = placed.select(F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other")).alias("place"), "part", "root", "vec")

    def compare(rows):
        parts = np.array(rows.column(1).to_pylist(), object)
        for p in set(parts.tolist()):  # more than one only if hashes meet
            at = np.flatnonzero(parts == p)
            x = _unit(rows.column(3).take(pa.array(at)).to_pylist())
            ids, of = np.unique(rows.column(2).to_numpy()[at], return_inverse=True)
            forest = Forest(len(ids))
            for i in range(0, len(at), 256):
                u, v = np.nonzero((x[i : i + 256] @ x[i:].T >= threshold) & (of[i : i + 256, None] != of[None, i:]))
                forest.link(of[i + u], of[i + v])
            u, v = forest.edges()
            if len(u):
                yield _best(ids[u], ids[v], np.full(len(u), threshold), 2)

    return keyed.repartition("place").sortWithinPartitions("place").mapInArrow(lambda b: _streamed(b, 0, compare), _LISTS)


def _audit(nodes: DataFrame, threshold: float, sample: int, seed: int) -> DataFrame:
    """Of a sample of nodes (node, part, root, vec), the first by hash: links to any node outside their own component, as kind 2, and
    for each batch how many links were asked for, as v of a row of kind 3."""
    asked = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sample).collect()
    parts: dict[str, list] = {}
    for r in asked:
        parts.setdefault(r["part"], []).append(r)
    held = nodes.sparkSession.sparkContext.broadcast({p: (np.array([r["node"] for r in x]), np.array([r["root"] for r in x]), _unit([bytes(r["vec"]) for r in x])) for p, x in parts.items()})

    def search(batches):
        for batch in batches:
            part = np.array(batch.column(1).to_pylist(), object)
            n = 0
            for p, (ids, of_asked, q) in held.value.items():
                at = np.flatnonzero(part == p)
                if len(at):
                    x = _unit(batch.column(3).take(pa.array(at)).to_pylist())
                    sim = q @ x.T
                    node, root = (batch.column(c).take(pa.array(at)).to_numpy() for c in (0, 2))
                    link = (sim >= threshold) & (ids[:, None] != node)
                    n += int(link.sum())
                    i, j = np.nonzero(link & (of_asked[:, None] != root))
                    if len(i):
                        yield _best(ids[i], node[j], sim[i, j], 2)
            yield _best(np.array([-1]), np.array([n]), np.array([0.0]), 3)

    return nodes.select("node", "part", "root", "vec").mapInArrow(search, _LISTS)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, k: int = 12, tables: int = 10, rounds: int = 5, settled: float = 0.002, sample: int = 512, audits: int = 1, whole: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    raw = packed_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"), "embedding", ("vec_id", "label"))
    zero: Column = F.length(F.regexp_replace(F.hex("vec"), "^(0000000000000000|0000000000000080)*$", "")) == 0
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.length("vec") > 0) & ~zero, F.lit(False))
    held = written(raw.select("vec_id", F.concat_ws(":", "label", F.length("vec").cast("string")).alias("part"), "vec", usable.alias("usable")), "vectors")
    nodes = written(held.filter("usable").groupBy("part", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = written(nodes.groupBy("part").agg(F.count("*").alias("n")), "labels")
    large = not sizes.filter(F.col("n") > whole).isEmpty()

    def placed(roots: DataFrame | None, of: Column | None = None) -> DataFrame:
        """Nodes (of labels of these sizes) with their component's root."""
        some = nodes if of is None else nodes.join(sizes.filter(of), "part", "left_semi")
        return some.withColumn("root", F.col("node")) if roots is None else some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def joined(state: DataFrame, extra: DataFrame) -> DataFrame:
        return written(components(state.filter("kind = 2").unionByName(extra).select("u", "v")), "roots")

    state, roots, extra = None, None, nodes.sparkSession.createDataFrame([], _LISTS)
    for audit in range(audits):
        now = placed(roots, None if roots is None else F.col("n") > whole)
        fresh = _first_lists(now, sizes, k, tables, 11 + audit, threshold)
        state = written(_cut(fresh if state is None else fresh.unionByName(_parted(state, now)), k), "lists")
        total = state.filter("kind < 2").count()
        for _ in range(rounds):
            better = written(_round(state, now, k, threshold), "lists")
            changed = better.filter("kind < 2").join(state.filter("kind < 2").select("u", "v"), ["u", "v"], "left_anti").count()
            state = better
            if changed <= settled * total:
                break
        roots = joined(state, extra)
        if not large:
            break
        asked = written(_audit(placed(roots, F.col("n") > whole), threshold, sample, 7 + audit), "missed")
        missed, of = asked.filter("kind = 2"), asked.filter("kind = 3").agg(F.sum("v")).first()[0] or 0
        lacks = missed.count()
        _LOG.info("audit %d: %d of %d links of %d nodes were missed", audit + 1, lacks, of, sample)
        extra = extra.unionByName(missed)
        if audit + 1 == audits:
            break
        saturated = state.filter("kind = 0").join(placed(roots, F.col("n") > whole).select(F.col("node").alias("u")), "u", "left_semi").groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n")).filter((F.col("n") >= k) & (F.col("low") >= threshold))
        if not lacks and saturated.isEmpty():
            break
    extra = extra.unionByName(written(_tiles(placed(roots), threshold), "links"))
    if not extra.isEmpty():
        roots = joined(state, extra)
    classes = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").join(nodes, "node").select("node", "root", "size", "copies", "vec")
    firsts = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    known = roots.join(firsts, "root").select("node", "component_id").join(_within(classes, threshold), "node")
    facts = nodes.join(known, "node", "left").select("part", "vec", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    linked = held.filter("usable").join(facts, ["part", "vec"]).select("vec_id", "n_links", "component_id")
    alone = held.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.when(F.col("vec_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("vec_id") == F.col("component_id")))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
), c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

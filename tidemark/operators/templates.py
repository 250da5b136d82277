"""Message templates: a prefix tree of token patterns, fitted on distinct messages and matched in Spark."""

from __future__ import annotations

import configparser
import io
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import prepared
from tidemark.sources.shared import read_text, write_text

WILD = "<*>"


@dataclass
class MinerConfig:
    """L-05."""

    similarity: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = None
    parametrize_numeric_tokens: bool = True
    rules: list[tuple[str, str]] = field(default_factory=list)
    slice_length: int | None = None
    strip: bool = True

    def save(self, path: str) -> None:
        ini = configparser.ConfigParser()
        ini["MINER"] = {k: json.dumps(v).replace("%", "%%") for k, v in asdict(self).items()}
        out = io.StringIO()
        ini.write(out)
        write_text(out.getvalue(), path)

    @classmethod
    def load(cls, path: str) -> MinerConfig:
        ini = configparser.ConfigParser()
        ini.read_string(read_text(path))
        d = {k: json.loads(v) for k, v in ini["MINER"].items()}
        return cls(**{**d, "rules": [tuple(r) for r in d["rules"]]})


@dataclass
class Template:
    id: int
    tokens: list[str]
    size: int = 1


class TemplateTree:
    """A tree by number of tokens, then leading tokens; its leaves hold templates.

    add() takes the most similar template of its leaf if that reaches the similarity (ties: more parameters), and generalises the places
    that differ; else it makes a new one. match() needs every place to be equal or a parameter.
    """

    def __init__(self, config: MinerConfig | None = None):
        self.config = config or MinerConfig()
        self.templates: dict[int, Template] = {}
        self._root: dict = {}
        self._next = 1

    def _levels(self, tokens: list[str]) -> list[str]:
        return tokens[: max(0, self.config.depth - 2)]

    @staticmethod
    def _has_digit(token: str) -> bool:
        return any(c.isdigit() for c in token)

    def _leaf(self, tokens: list[str], grow: bool) -> list[int] | None:
        node = self._root.get(len(tokens))
        if node is None:
            if not grow:
                return None
            node = self._root[len(tokens)] = {"kids": {}, "ids": []}
        for token in self._levels(tokens):
            kids = node["kids"]
            key = token
            if key not in kids:
                key = WILD
                if grow and key not in kids or grow and not (self.config.parametrize_numeric_tokens and self._has_digit(token)):
                    named = sum(k != WILD for k in kids)
                    if not (self.config.parametrize_numeric_tokens and self._has_digit(token)) and named < self.config.max_children - 1:
                        key = token
                    if key not in kids:
                        kids[key] = {"kids": {}, "ids": []}
            if key not in kids:
                return None
            node = kids[key]
        return node["ids"]

    def _best(self, ids: Iterable[int], tokens: list[str], needed: float, wild_counts: bool) -> Template | None:
        best, top, most = None, -1.0, -1
        for i in ids:
            t = self.templates.get(i)
            if t is None:
                continue
            same = sum(a == b and a != WILD for a, b in zip(t.tokens, tokens, strict=True))
            wild = t.tokens.count(WILD)
            share = (same + wild * wild_counts) / len(tokens) if tokens else 1.0
            if (share, wild) > (top, most):
                best, top, most = t, share, wild
        return best if best is not None and top >= needed else None

    def add(self, message: str) -> int:
        tokens = message.split()
        ids = self._leaf(tokens, grow=True)
        found = self._best(ids, tokens, self.config.similarity, False)
        if found is None:
            found = Template(self._next, tokens)
            self._next += 1
            self.templates[found.id] = found
            ids.append(found.id)
            if self.config.max_clusters and len(self.templates) > self.config.max_clusters:
                del self.templates[min(self.templates)]
        else:
            found.tokens = [a if a == b else WILD for a, b in zip(found.tokens, tokens, strict=True)]
            found.size += 1
        return found.id

    def match(self, message: str) -> int:
        """L-07: the id, -1 without one."""
        tokens = message.split()
        ids = self._leaf(tokens, grow=False)
        found = self._best(ids, tokens, 1.0, True) if ids else None
        if found is None and len(tokens) in self._root:  # a template may have been filed under a parameter
            found = self._best(self._under(self._root[len(tokens)], self._levels(tokens)), tokens, 1.0, True)
        return found.id if found else -1

    def _under(self, node: dict, levels: list[str]) -> list[int]:
        if not levels:
            return node["ids"]
        return [i for k in (levels[0], WILD) if k in node["kids"] for i in self._under(node["kids"][k], levels[1:])]

    def discard(self, template_id: int) -> None:
        """L-10."""
        self.templates.pop(template_id, None)

    def to_json(self) -> str:
        return json.dumps({"config": asdict(self.config), "next": self._next, "templates": [asdict(t) for t in self.templates.values()], "root": {str(k): v for k, v in self._root.items()}})

    @classmethod
    def from_json(cls, text: str) -> TemplateTree:
        d = json.loads(text)
        tree = cls(MinerConfig(**{**d["config"], "rules": [tuple(r) for r in d["config"]["rules"]]}))
        tree._next, tree.templates = d["next"], {t["id"]: Template(**t) for t in d["templates"]}
        tree._root = {int(k): v for k, v in d["root"].items()}
        return tree


class TemplateMiner:
    """L-06 .. L-12: fitting and matching of a text column."""

    def __init__(self, config: MinerConfig | None = None, tree: TemplateTree | None = None):
        self.tree = tree or TemplateTree(config)
        self.config = self.tree.config

    def masked(self, c: str | Column) -> Column:
        return prepared(c, self.config.rules, self.config.slice_length, self.config.strip)

    def fit(self, df: DataFrame, column: str, order_by: str, distinct: str = "raw") -> TemplateMiner:
        """L-06, Q-22: distinct messages (raw: before masking; masked: after it) are added in the order in which they first come, on which a
        tree depends. Messages of another number of tokens never meet in it, so each number's part of the tree grows in a task of its
        own; the driver gets templates alone, and numbers new ones by the order in which they came. With max_clusters a template can push
        out one of another length: then the driver adds all distinct messages, one by one."""
        base = df.select(F.col(column).alias("message"), F.col(order_by).alias("_o")).filter("message is not null")
        if distinct == "masked":
            base = base.withColumn("message", self.masked("message"))
        first = base.groupBy("message").agg(F.min("_o").alias("_o"))
        rows = first.select((F.col("message") if distinct == "masked" else self.masked("message")).alias("m"), "_o", "message")
        if self.config.max_clusters:
            for row in rows.orderBy("_o", "message").toLocalIterator():
                self.tree.add(row["m"])
        else:
            self._grow(rows)
        return self

    def _grow(self, rows: DataFrame) -> None:
        held = rows.sparkSession.sparkContext.broadcast(self.tree.to_json())

        @F.pandas_udf("long")
        def length(messages: pd.Series) -> pd.Series:
            return messages.map(lambda m: len(m.split()))

        def grown(f: pd.DataFrame) -> pd.DataFrame:
            tree, born = TemplateTree.from_json(held.value), {}
            for m, o, raw in f.sort_values(["_o", "message"])[["m", "_o", "message"]].itertuples(index=False):
                known = tree._next
                tree.add(m)
                if tree._next > known:
                    born[known] = o, raw
            n = int(f["length"].iloc[0])
            own = [t for t in tree.templates.values() if len(t.tokens) == n]
            root = [json.dumps(tree._root[n])] + [None] * (len(own) - 1)
            return pd.DataFrame({"length": n, "root": root, "id": [t.id for t in own], "tokens": [t.tokens for t in own], "size": [t.size for t in own], "born": [t.id in born for t in own], "o": [born.get(t.id, (None, None))[0] for t in own], "raw": [born.get(t.id, (None, None))[1] for t in own]})

        schema = T.StructType().add("length", "long").add("root", "string").add("id", "long").add("tokens", T.ArrayType(T.StringType())).add("size", "long").add("born", "boolean").add("o", rows.schema["_o"].dataType).add("raw", "string")
        found = rows.withColumn("length", length("m")).groupBy("length").applyInPandas(grown, schema).collect()  # templates
        number = {}
        for i, r in enumerate(sorted((r for r in found if r["born"]), key=lambda r: (r["o"] is not None, r["o"], r["raw"]))):
            number[r["length"], r["id"]] = self.tree._next + i
        self.tree._next += len(number)

        def renamed(node: dict, n: int) -> dict:
            return {"kids": {k: renamed(v, n) for k, v in node["kids"].items()}, "ids": [number.get((n, i), i) for i in node["ids"]]}

        for r in sorted(found, key=lambda r: number.get((r["length"], r["id"]), r["id"])):
            i = number.get((r["length"], r["id"]), r["id"])
            self.tree.templates[i] = Template(i, list(r["tokens"]), r["size"])
            if r["root"] is not None:
                self.tree._root[r["length"]] = renamed(json.loads(r["root"]), r["length"])

    def predict(self, df: DataFrame, column: str, out: str = "template_id") -> DataFrame:
        """L-07 .. L-09, J-08: the template id of every row. Masked messages are matched in Arrow batches, each distinct one of a batch
        once; rows need no shuffle."""
        held = df.sparkSession.sparkContext.broadcast(self.tree.to_json())

        @F.pandas_udf("long")
        def matched(messages: pd.Series) -> pd.Series:
            tree = _tree(held.value)
            ids = {m: tree.match(m) for m in messages.dropna().unique()}
            return messages.map(ids).fillna(-1).astype("int64")

        return df.withColumn(out, matched(self.masked(column)))

    def fit_online(self, df: DataFrame, column: str, order_by: str, similarity: float | None = None) -> TemplateMiner:
        """L-14: messages without a template are fitted, by default or with another similarity for these only."""
        misses = self.predict(df, column).filter("template_id < 0")
        old = self.config.similarity
        self.config.similarity = similarity if similarity is not None else old
        try:
            return self.fit(misses, column, order_by, distinct="masked")
        finally:
            self.config.similarity = old

    def templates(self) -> list[tuple[int, str, int]]:
        """L-11: id, template, number of distinct messages fitted."""
        return [(t.id, " ".join(t.tokens), t.size) for t in self.tree.templates.values()]

    def templates_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.templates(), "ClusterId int, Template string, Occurrences long")

    def save(self, path: str) -> None:
        """L-12: in any file system that Spark reaches."""
        write_text(self.tree.to_json(), path)

    @classmethod
    def load(cls, path: str) -> TemplateMiner:
        return cls(tree=TemplateTree.from_json(read_text(path)))


_TREES: dict[str, TemplateTree] = {}


def _tree(text: str) -> TemplateTree:
    if text not in _TREES:
        _TREES.clear()
        _TREES[text] = TemplateTree.from_json(text)
    return _TREES[text]


def messages_of(spark, x, column: str = "message") -> DataFrame:
    """L-01: a frame, the path of a Parquet table, paths, a list or a one-dimensional array of messages, as a frame with a column of messages
    and their place (order), where the input has one. Anything else is a TypeError."""
    if isinstance(x, DataFrame):
        if column not in x.columns:
            raise TypeError(f"the frame has no column {column}")
        return x
    if isinstance(x, str):
        return messages_of(spark, spark.read.parquet(x), column)
    if hasattr(x, "tolist") and getattr(x, "ndim", 1) == 1:
        x = x.tolist()
    if isinstance(x, list | tuple) and x and all(isinstance(m, str) and m.endswith(".parquet") for m in x):
        return messages_of(spark, spark.read.parquet(*x), column)
    if isinstance(x, list | tuple) and all(m is None or isinstance(m, str) for m in x):
        return spark.createDataFrame(list(enumerate(x)), f"order long, {column} string")
    raise TypeError(f"no messages can be taken from {type(x).__name__}")


def hashed_embedding(c: str | Column, size: int = 64) -> Column:
    """X-05: a deterministic encoder of texts: counts of hashed tokens, with signs, by place."""
    tokens = F.split(F.col(c) if isinstance(c, str) else c, r"\s+")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.when(F.pmod(F.xxhash64(t), F.lit(size)) == i, F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))


def calinski_harabasz(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """L-13: the score of a clustering of vectors, as score; null with fewer than two clusters or no spread within them."""
    cells = df.select(cluster, F.posexplode(vector).alias("d", "x"))
    per = cells.groupBy(cluster, "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n"))
    dims = per.groupBy("d").agg(F.sum(F.col("v") * F.col("n")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"), F.count("*").alias("k"), F.sum("n").alias("n"))
    total = dims.agg(F.sum("within").alias("w"), F.sum("between").alias("b"), F.max("k").alias("k"), F.max("n").alias("n"))
    return total.select(F.when((F.col("k") > 1) & (F.col("w") > 0) & (F.col("n") > F.col("k")), F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("score"))


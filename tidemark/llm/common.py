"""What the operators of this subpackage share: tables, the shared folder, and bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import dropped, shared_dir, written

__all__ = ["Cache", "dropped", "fold", "mapped", "shared_dir", "stretches", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns (all, if none are named) of a table of the data set."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id, parts: int):
    """crc32 of doc_id as text, modulo parts; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def stretches(column: pa.Array, size: int = 1 << 20, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Where to cut a column of texts, for stretches of about `size` bytes and at most `rows` rows; a longer text is one of its own."""
    total = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    at = 0
    while at < len(column):
        stop = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + size, "right")) - 1))
        yield at, stop
        at = stop


def mapped(docs: DataFrame, text: str, keep: Sequence[str], fields: T.StructType, work: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """The kept columns and `fields`. work() is called once in each task; what it returns makes the columns of `fields` from a list of
    texts. Texts pass Python in stretches of bounded size, and only once, even if their column is kept. A kept column with a name that
    `fields` has (in any case) gives way to it."""
    taken = {f.name.lower() for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
    sent = [*(c for c in keep if c != text), text]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    names, at = schema.names, [sent.index(c) for c in keep]

    def run(batches):
        make = work()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, z in stretches(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, z - a) for i in at), *make(texts.slice(a, z - a).to_pylist())], names)

    return docs.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(run, schema)


class Cache:
    """A map of two generations with at most 2 * size entries: what was used in either generation survives a turnover."""

    def __init__(self, size: int = 150_000):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """The keys not held in the young generation or the old one; those of the old one become young."""
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    young[k] = v
        return out

    def turn(self) -> None:
        """To be called between batches: what is held for a batch stays until its end."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}

"""Vectors as bytes: what embedding operators read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def packed_vectors(df: DataFrame, vector: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and vec: the components as doubles, as bytes; null if the vector is null or holds a null or non-finite
    component."""

    def pack(batches):
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            flat = col.flatten()
            values = flat.to_numpy(zero_copy_only=False)
            size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(size)].tolist()
            finite = np.r_[0, np.cumsum(~np.isfinite(values))]
            none = col.is_null().to_pylist()
            raw = np.ascontiguousarray(values, "<f8").tobytes()
            out = [None if none[i] or finite[at[i + 1]] > finite[at[i]] else raw[8 * at[i] : 8 * at[i + 1]] for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names)

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("vec", T.BinaryType())])
    names = schema.names
    return df.select(*keep, F.col(vector).cast("array<double>")).mapInArrow(pack, schema)

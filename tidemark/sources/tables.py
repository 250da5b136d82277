"""Readers and writers."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import parsed_datetime
from tidemark.sources.shared import read_bytes, read_text, write_bytes, write_text

#: Formats of Spark itself; others (delta, iceberg, avro, excel) work where their package is on the class path.
FORMATS = ("parquet", "csv", "json", "ndjson", "orc", "text", "avro", "delta", "iceberg", "xml")
_NAMES = {"ndjson": "json"}


def load(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", *, date_columns: Sequence[str] = (), date_format: str | None = None, time_zone: str | None = None, **options) -> DataFrame:
    """S-01, S-02: a table from one or several paths, with date columns parsed."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    df = spark.read.format(_NAMES.get(fmt, fmt)).options(**options).load(path if isinstance(path, str) else list(path))
    for c in date_columns:
        df = parsed_datetime(df, c, date_format, time_zone)
    return df


def schema_of(spark: SparkSession, path: str, fmt: str = "parquet", **options):
    """S-02: the schema alone."""
    return load(spark, path, fmt, **options).schema


def create(spark: SparkSession, data, schema=None, date_columns: Sequence[str] = (), date_format: str | None = None) -> DataFrame:
    """S-03: from rows, dictionaries, a dictionary of columns, or a pandas frame."""
    if isinstance(data, dict):
        data = [dict(zip(data, row, strict=True)) for row in zip(*data.values(), strict=True)]
    df = spark.createDataFrame(data, schema)
    for c in date_columns:
        df = parsed_datetime(df, c, date_format)
    return df


def save(df: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "overwrite", partition_by: Sequence[str] = (), **options) -> None:
    """S-04, S-09: partition_by in place of one file for each group."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.format(_NAMES.get(fmt, fmt)).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_grouped(df: DataFrame, path: str, *, partition_by: Sequence[str], sort_by: Sequence[str]) -> None:
    """S-09: rows of a partition together and sorted within files."""
    df.repartition(*partition_by, sort_by[0]).sortWithinPartitions(*partition_by, *sort_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_matrix(df: DataFrame, path: str, column: str) -> None:
    """S-04, S-10, S-16: a matrix as a Parquet table with one array column."""
    df.select(column).write.mode("overwrite").parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def save_next(df: DataFrame, path: str, base: str = "dataset") -> str:
    """S-05: writes base_<n>.parquet with the next free number, the first is 0; base may contain underscores."""
    taken = [int(m[1]) for f in _files(df.sparkSession, path) if (m := re.fullmatch(rf"{re.escape(base)}_(\d+)\.parquet", f))]
    out = f"{path.rstrip('/')}/{base}_{max(taken, default=-1) + 1}.parquet"
    df.write.parquet(out)
    return out


def read_lines(spark: SparkSession, path: str, line_id: bool = True) -> DataFrame:
    """S-06: raw text, one row for each line, with file and line_id: the line's place in its file. Numbering goes by file and by the
    offset of the block that Spark read, so no single task sees all lines."""
    df = spark.read.text(path).withColumnRenamed("value", "raw")
    if not line_id:
        return df
    df = df.select("raw", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))
    own = df.withColumn("_r", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_m")))
    sizes = own.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.join(before, ["file", "_block"]).select("raw", "file", (F.col("_before") + F.col("_r") - 1).alias("line_id"))


def read_labels(spark: SparkSession, path: str, key: str = "BlockId", renamed: str = "source") -> DataFrame:
    """S-07."""
    return spark.read.csv(path, header=True).withColumnRenamed(key, renamed)


def row_counts(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """S-08, S-12: file, rows: no column is read."""
    return load(spark, path, fmt).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def stacked(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """S-11: matrices of several tables one below another; rows of different width make the query fail."""
    df = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file"), column)
    width = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if width["a"] != width["b"]:
        raise ValueError(f"rows have {width['a']} to {width['b']} columns")
    return df


def matching_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """S-18: names of the files in a folder that a glob matches."""
    import fnmatch

    return sorted(f for f in _files(spark, path) if fnmatch.fnmatch(f, pattern))


def rows_from_files(df: DataFrame, starts: Sequence[str] = (), ends: Sequence[str] = ()) -> DataFrame:
    """S-18, Q-28: rows whose file's name starts with one of starts and ends with one of ends; empty lists don't filter."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    for options, test in ((starts, F.startswith), (ends, F.endswith)):
        if options:
            cond = F.lit(False)
            for o in options:
                cond = cond | test(name, F.lit(o))
            df = df.filter(cond)
    return df


def save_json(value: dict, path: str) -> None:
    """S-15, S-17, C-20: in any file system that Spark reaches."""
    write_text(json.dumps(value, indent=2, default=str), path)


def load_json(path: str) -> dict:
    """C-20."""
    return json.loads(read_text(path))


def metadata_of(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S-02: file, bytes, changed and rows of each file of a table, without reading a column."""
    m = "_metadata"
    return load(spark, path, fmt).groupBy(F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_size").alias("bytes"), F.col(f"{m}.file_modification_time").alias("changed")).agg(F.count("*").alias("rows"))


def batches(df: DataFrame, rows: int):
    """S-02: a table in batches of at most that many rows, as lists, one partition at a time on the driver: for small consumers."""
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def save_npy(df: DataFrame, path: str, column: str, order_by: str, limit_mb: int = 256) -> None:
    """S-04: a matrix as one NumPy file. Its size is checked first: one file means one writer, the driver."""
    import io

    import numpy as np

    n, width = df.agg(F.count("*"), F.max(F.size(column))).first()
    if 8 * n * (width or 0) > limit_mb << 20:
        raise ValueError(f"a matrix of {n} rows and {width} columns is beyond {limit_mb} MB; save_matrix writes a table")
    out = io.BytesIO()
    np.save(out, np.array([r[0] for r in df.orderBy(order_by).select(column).collect()], np.float64))
    write_bytes(out.getvalue(), path, df.sparkSession)


def row_locations(spark: SparkSession, paths: Sequence[str], positions: DataFrame, position: str = "position") -> DataFrame:
    """S-12: position, file, row: where rows of several tables, taken one after another in this order, lie. Counts alone are read; a position
    beyond the last row has file "" and row -1."""
    counts = row_counts(spark, paths).withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    order = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "place int, path string").withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    per = counts.join(F.broadcast(order), F.col("file").startswith(F.col("path")))  # few files of few paths
    w = Window.orderBy("place", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    spans = per.select("file", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("_from"), "rows")
    found = positions.join(F.broadcast(spans), (F.col(position) >= F.col("_from")) & (F.col(position) < F.col("_from") + F.col("rows")), "left")
    return found.select(position, F.coalesce("file", F.lit("")).alias("file"), F.coalesce(F.col(position) - F.col("_from"), F.lit(-1)).cast("long").alias("row"))


def load_windows(spark: SparkSession, windows: str, embeddings: str, *, window_id: str = "window_id", ids: str = "ids", key: str = "template_id", vector: str = "vector") -> DataFrame:
    """S-13: windows of ids with the vectors of these, from a Parquet table each."""
    from tidemark.operators.joins import gather_vectors

    return gather_vectors(spark.read.parquet(windows), spark.read.parquet(embeddings), window_id=window_id, ids=ids, key=key, vector=vector)


def load_training_texts(spark: SparkSession, path: str | Sequence[str], column: str = "text") -> DataFrame:
    """S-14: anchor and positive: each distinct text beside itself, as a contrastive training set takes them."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col(column).alias("anchor")).filter("anchor is not null").distinct()
    return df.withColumn("positive", F.col("anchor"))


def copied(spark: SparkSession, source: str, target: str) -> None:
    """S-18: copies a folder or file in place of the target."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    b.getFileSystem(conf).delete(b, True)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def unpacked(spark: SparkSession, archive: str, target: str) -> list[str]:
    """S-18: the files of a tar archive, written into a folder; names that point outside are refused."""
    import io
    import posixpath
    import tarfile

    out = []
    with tarfile.open(fileobj=io.BytesIO(read_bytes(archive, spark))) as tar:
        for m in tar:
            if m.isfile():
                name = posixpath.normpath(m.name)
                if name.startswith(("/", "..")):
                    raise ValueError(f"{m.name} points outside")
                write_bytes(tar.extractfile(m).read(), f"{target.rstrip('/')}/{name}", spark)
                out.append(name)
    return sorted(out)

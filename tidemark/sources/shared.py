"""Tables in the folder that driver and executors share: what is written there is computed once, and outlives any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a temporary folder stands in, but only if driver and
    executors are one process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if base or held.isDefined():
        return (base or held.get()).rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if "local" not in _FOLDER:
        _FOLDER["local"] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return _FOLDER["local"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _session(spark: SparkSession | None) -> SparkSession:
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise ValueError("there is no session to reach files with")
    return found


def write_bytes(data: bytes, path: str, spark: SparkSession | None = None) -> None:
    """Something small as one file, in any file system that Spark reaches; an older file is replaced."""
    spark = _session(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    return bytes(_session(spark).read.format("binaryFile").load(path).first()["content"])


def write_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    write_bytes(text.encode(), path, spark)


def read_text(path: str, spark: SparkSession | None = None) -> str:
    return read_bytes(path, spark).decode()

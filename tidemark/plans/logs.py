"""Log lines: from raw lines to windows of templates, scores and verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import filter_incidents
from tidemark.operators.order import with_row_index
from tidemark.operators.scoring import id_window_scores, verdicts
from tidemark.operators.templates import TemplateMiner, hashed_embedding
from tidemark.operators.windows import WHOLE, generate_windows, node_windows


def prepared(lines: DataFrame, incidents: DataFrame | None = None, *, datetime_column: str, logs_column: str, order_by, partition_by, delta_thr: float = 10, sequence_length: int = 2, incident_buffer: int | None = None, mode: str = "outside") -> tuple[DataFrame, DataFrame]:
    """L-15: the lines outside incidents with a row index within partition_by (WHOLE: over all), and windows of indices within sessions."""
    kept = filter_incidents(lines, incidents, datetime_column=datetime_column, logs_column=logs_column, incident_buffer=incident_buffer, mode=mode, order_by=order_by)
    indexed = with_row_index(kept, order_by, partition_by=() if partition_by == WHOLE else partition_by)
    return indexed, generate_windows(indexed, column=datetime_column, order_by="index", partition_by=partition_by, delta_thr=delta_thr, sequence_length=sequence_length)


def template_table(miner: TemplateMiner, spark, size: int = 64, encoder=None) -> DataFrame:
    """M-05, X-05: ClusterId, Template, vector: templates with their encoding. encoder: from a column of texts to one of arrays, such as a
    Pandas UDF around a trained model; without it, hashed tokens are counted."""
    return miner.templates_frame(spark).withColumn("vector", (encoder or (lambda c: hashed_embedding(c, size)))(F.col("Template")))


def missing_templates(ids: DataFrame, table: DataFrame, key: str = "ClusterId") -> DataFrame:
    """M-05: ids that the table of vectors lacks."""
    return ids.select(key).distinct().join(table.select(key), key, "left_anti")


def block_verdicts(lines: DataFrame, miner: TemplateMiner, *, block: str, message: str, line_id: str, length: int, model, threshold: float) -> DataFrame:
    """M-06, M-07, A-17: max_score, n_windows and anomaly of each block. Short blocks are padded with zero vectors, which count. Templates'
    vectors go to all tasks, as the tree itself does."""
    ids = miner.predict(lines.select(block, line_id, message), message).select(block, line_id, "template_id")
    windows = node_windows(ids, node=block, line_id=line_id, length=length, value="template_id")
    vectors = {r["ClusterId"]: np.array(r["vector"]) for r in template_table(miner, lines.sparkSession).select("ClusterId", "vector").collect()}  # templates
    return verdicts(id_window_scores(windows.select(block, "window"), model, vectors, 64), group=block, score="score", threshold=threshold)

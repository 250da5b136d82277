"""A corpus pipeline: toxic documents go, unidentified languages go, one of each group of near duplicates stays, repeated passages are
cut out, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of docs.
Extra columns pass through, whatever their names. Null and empty texts pass toxicity, have no language and go there. No rows give no
rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, packing, simhash, suffix_dedup, toxicity
from tidemark.llm.common import fold, table, written


def _rows(docs: DataFrame) -> DataFrame:
    """Each row's text, and its other columns as one struct, so that no column's name can clash with an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")


def _columns(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in like.columns))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(fold(F.col("doc_id"), 4) != 2)
    model = toxicity.model_of(docs.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text"), labels)
    return _columns(toxicity.scored(_rows(docs), model, keep=("row", "text")).filter("predicted = 0"), docs)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.model_of(docs.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    return _columns(language.identified(_rows(docs), model, keep=("row", "text")).filter("not rejected"), docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.kept(docs)


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; n_chars is counted anew."""
    others = F.struct(F.col("text").isNotNull().alias("had_text"), F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row"))
    cleaned = suffix_dedup.cleaned(docs.select("doc_id", "text", others.alias("along")), outputs="text", carry="along").select("kept", "along.*")
    back = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.when(F.col("had_text"), F.col("kept"))}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.when(F.col("row.n_chars").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*(back[c].alias(c) for c in docs.columns))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", stage_toxicity),
    ("language_id", stage_language),
    ("simhash_near_dedup", stage_simhash),
    ("suffix_array_dedup", stage_suffix_dedup),
    ("best_fit_packing", stage_packing),
]

#: The stages' models, fingerprints and tokens are beyond SQL; tests/llm holds the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

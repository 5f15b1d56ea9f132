"""Stages that clean and pack a training corpus. Each reads what the one before it wrote.

Every stage judges rows, not ids: rows with a null id, and rows that repeat an id, are documents of their own. A null text counts as
empty; columns beyond ``doc_id`` and ``text`` pass through, whatever their names; an empty table stays empty. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import toxicity
from cladespark.llm.decontaminate import decontaminate
from cladespark.llm.exact_dedup import exact_dedup
from cladespark.llm.jaccard_join import jaccard_components
from cladespark.llm.packing import pack
from cladespark.llm.runtime import forget, keyed, new_path, read, small_side
from cladespark.llm.tokens import vocabulary


def _without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose key is in ``dropped``: by a broadcast while they are few (counted), else by a shuffle."""
    return rows.join(small_side(dropped.select(F.col(dropped.columns[0]).alias(key))), key, "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. The model is fitted to labelled documents of this stage's input.

    Rows without an id have no label, but are scored; rows that share an id share its label. Empty texts are scored as texts without marks.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, one with the largest id; null ids lose to all others. Empty and null texts are equal."""
    rows, key = keyed(docs, "doc_id")
    found = exact_dedup(rows, id_col=key)
    return _without(rows, key, found.where(~F.col("kept")).select("doc_id")).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link, directly or through others, one row stays, one with the smallest id; null ids
    lose to all others. Texts without words link with nothing and stay."""
    rows, key = keyed(docs, "doc_id", nulls_last=True)
    found = jaccard_components(rows, id_col=key)
    return _without(rows, key, found.where("doc_id <> component_id").select("doc_id")).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item, or with the whole of a shorter item, go. Each row is judged by its own text."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place; each row, also of an empty text, is a document, and keeps its id."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot fit the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet to the shared folder and read again, and its table
    deleted when the next stage's is written. The last one's input stays until the result has been read."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            forget(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

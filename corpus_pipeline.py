"""Cleaning of a corpus: stages that each read what the one before kept.

A stage takes (spark, docs, sf_dir) and returns documents with the same columns, the last one token windows. Null texts pass as they are, empty tables stay
empty, repeated rows are near duplicates of each other, and columns beyond those of documents come along."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm.decontaminate import without_items
from statweave.llm.neardup import near_duplicates
from statweave.llm.packing import pack_documents, ranks_and_pattern
from statweave.llm.pii import redact
from statweave.llm.shared import cut, table
from statweave.llm.toxicity import fit, learnable, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7."""
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return score(docs.withColumnRenamed("score", "_score"), model).filter("score < 0.7").drop("score").withColumnRenamed("_score", "score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id; of rows that are equal in doc_id and text, one. Rows with one doc_id and different texts
    go only if each of them has to."""
    gone = cut(near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the documents, with the ids of every piece."""
    return pack_documents(docs, *ranks_and_pattern(), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal data", mask_personal_data), ("packing", pack)]
#: Training, connected components and packing are beyond SQL; tests/llm/test_pipeline.py holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: each stage reads what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reprise.llm import line_rules, near_dedup, packing, toxicity
from reprise.llm.common import ship, staged, table
from reprise.llm.queries import bpe_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict toxic; it learns from the labels of these documents. A null
    text has no words and stays."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.classify(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the line and word rules, each with its text without the lines that too many documents of its host
    hold; ``n_chars`` of a text that lost lines is counted anew."""
    ship(spark)
    rows = line_rules.without_lines(docs, COLUMNS).where("kept")
    size = F.when(F.col("n_removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", size).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest doc_id, a row without one only where all have none.
    Rows are compared by their own texts, so rows of equal or no doc_id go only as copies."""
    ship(spark)
    d = staged(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS))
    of = near_dedup.classes(d, "_row").select(F.col("id").alias("_row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = d.select("_row", "doc_id").join(of, "_row").groupBy("class_id").agg(F.min(order).alias("x")).select(F.col("x._row").alias("_row"))
    return d.join(first, "_row", "left_semi").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, placed in sequences."""
    ship(spark)
    return packing.pack(docs, bpe_files())


STAGES: list[tuple[str, Stage]] = [("toxicity", clean), ("quality rules", quality), ("near duplicates", distinct), ("best-fit packing", packed)]

#: The toxicity model and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

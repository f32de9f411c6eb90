"""Corpus pipeline: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return
the columns of ``documents`` unchanged. ``run`` applies them to the whole table.

1. quality: a classifier fitted on the labelled documents of the input rejects
   documents below the threshold;
2. language: texts without letters, and texts farther from every language than
   training texts of their length, are rejected;
3. near_duplicates: one document of each component stays, whatever its id; texts
   without words are linked with nothing and stay;
4. packing: what is left, packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import langid, ngram_join, packing, quality
from rankfold.llm.common import materialise, read_table
from rankfold.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (all, if nothing is labelled)."""
    stats = materialise(quality.with_statistics(docs.select("doc_id", "text")), "pipeline-quality")
    labelled = materialise(quality.with_labels(stats, read_table(spark, sf_dir, "labels")), "pipeline-labelled")
    model = quality.fit(labelled)
    return docs if model.weights is None else quality.keep_good(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language (all with a letter, if no language is learned)."""
    model = langid.fit(docs)
    if model.idf is None:
        return docs
    named = docs.select(F.struct(*docs.columns).alias("d"), F.col("text").alias("_text"))
    return langid.predict(named, model, text="_text").where("not rejected").select("d.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id. If an id
    is null or repeated, rows are told apart by a number of their own instead, and the
    first row of a component stays; which documents are linked does not depend on it."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    row, rows = "doc_id", docs
    if n["rows"] != n["ids"]:
        row = "_row"
        while row in docs.columns:
            row += "_"
        rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    comp = ngram_join.near_duplicates(rows, row)
    copies = materialise(comp.where(F.col(row) != F.col("component_id")).select(row), "pipeline-copies")
    return rows.join(copies, row, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each), ("packing", packed)]

#: a classifier and a tokenizer are no SQL; tests hold run() against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

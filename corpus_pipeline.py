"""From raw documents to packed training sequences, as stages of the operators in `quorumlens.llm`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`.  `run`
writes the rows of a stage as Parquet in the shared folder and reads them back for the next.  Columns beyond doc_id, text,
lang and n_chars pass through unchanged; n_chars, if it is there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlens.llm.decontaminate import contamination, is_contaminated
from quorumlens.llm.langid import UNKNOWN, identify
from quorumlens.llm.linededup import drop_repeated_lines
from quorumlens.llm.neardup import near_duplicates
from quorumlens.llm.pack import pack
from quorumlens.llm.store import stored
from quorumlens.llm.tokens import VOCABULARY

# Documents whose best language has a smaller share of the score are rejected; with four languages chance is 0.25.
LEAST_SCORE = 0.3


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Whether a row of `a`, a document, is one of `b` (doc_id, text_key): a decision holds for the id, null too, and the text."""
    return a["doc_id"].cast("long").eqNullSafe(b["doc_id"]) & (F.xxhash64(a["text"].cast("string")) == b["text_key"])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose id and text aren't among the rejected."""
    gone = rejected.select("doc_id", "text_key").distinct()
    return docs.join(gone, _same(docs, gone), "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that resemble no language of the labelled ones."""
    found = identify(docs)
    return _without(docs, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document of which only blank lines are left goes."""
    found = drop_repeated_lines(docs).filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(size))
    return found.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays; rows without an id all stay.

    Rows that share a doc_id stand for themselves: one of another text than its class's stays.  Of rows alike in id and text
    that have the least doc_id one stays, whatever their other columns hold.
    """
    found = near_duplicates(docs).filter("doc_id = class_id")
    kept = found.groupBy("class_key", "doc_id").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key").distinct()
    rows = docs.filter("doc_id IS NOT NULL")
    alike = Window.partitionBy("doc_id", F.xxhash64(F.col("text").cast("string"))).orderBy(F.xxhash64(*docs.columns))
    one = rows.join(kept, _same(rows, kept), "left_semi").withColumn("_copy", F.row_number().over(alike)).filter("_copy = 1")
    return one.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more stands in windows of benchmark items."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    # The operator carries one name of a row through: here one of id and text.
    name = F.xxhash64("doc_id", F.col("text").cast("string"))
    found = contamination(docs.select(name.alias("doc_id"), "text"), items).filter(is_contaminated())
    gone = found.select(F.col("doc_id").alias("_name")).distinct()
    return docs.join(gone, name == F.col("_name"), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens."""
    return pack(docs, VOCABULARY)


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark), ("packing", packing)]

# Weighted sampling, kernels and tokens can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

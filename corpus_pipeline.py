"""A corpus pipeline over `documents`: quality, boilerplate, near duplicates, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the
next stage's docs. All stages but the last return the columns of documents.

A row is known by a hash of its doc_id and its text, so that rows without an id, or of different texts under one id,
are judged each by itself. Defined results, in all stages: an empty table gives no rows; extra columns come through,
whatever their names; rows that repeat id and text are judged alike, and of those that repeat a row that stays, all
stay but for near duplicates, where one does; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm.arrow import free_names, row_key
from hexloom.llm.decontam import decontaminate
from hexloom.llm.importance import importance_resample
from hexloom.llm.linededup import dedup_lines
from hexloom.llm.packing import best_fit_packing
from hexloom.llm.simjoin import BROADCAST_IDS, similarity_components
from hexloom.session import stage, table


def _without(docs: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """docs without the rows of the given row_keys; they are broadcast while they are few, and else joined by."""
    (name,) = free_names(docs.columns, "row_key")
    keys = stage(keys.select(F.col("row_key").alias(name)).distinct(), rows=rows)
    few = keys.count() <= BROADCAST_IDS
    return docs.withColumn(name, row_key()).join(F.broadcast(keys) if few else keys, name, "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps. Null and blank texts have no weight and go."""
    found = stage(importance_resample(docs, table(spark, sf_dir, "labels")).filter("not kept").select("row_key"))
    return _without(docs, found, found.count())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share; n_chars follows.

    A document of which no word would be left is no page with boilerplate on it but a copy of a whole document: it
    stays as it is, and the next stage leaves one of its copies. Null texts stay null.
    """
    (whole,) = free_names(docs.columns, "whole")
    text = F.col("text")
    found = dedup_lines(docs.withColumn(whole, text))
    cut = (F.col(found.columns[-1]) > 0) & (F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) > 0)
    columns = {c.lower(): c for c in docs.columns}
    new = {columns["text"]: F.when(cut, text).otherwise(F.col(whole))}
    if "n_chars" in columns:
        new[columns["n_chars"]] = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id (null last), then row key.

    Documents without a word are in no group and stay, each of them.
    """
    found = stage(similarity_components(docs).select("row_key", "is_first", "n_shingles"))
    size = found.count()
    left = _without(docs, found.filter("not is_first"), size)
    again = stage(found.filter("is_first and n_shingles > 0").groupBy("row_key").count().filter("count > 1").select("row_key"), rows=size)
    if again.isEmpty():
        return left
    # rows that repeat both id and text: one of each stays
    (name,) = free_names(docs.columns, "row_key")
    keyed = left.withColumn(name, row_key())
    repeated = keyed.join(again.withColumnRenamed("row_key", name), name, "left_semi").dropDuplicates([name]).select(*docs.columns)
    return _without(left, again, size).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and blank texts have none and stay."""
    found = stage(decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("row_key"))
    return _without(docs, found, found.count())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and offsets."""
    return best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL cannot express the fitted models, the components and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs

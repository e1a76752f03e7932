"""From documents to packed training sequences: five stages, each written and read again before the next.

All stages but the last return COLUMNS; other columns of docs, whatever their names, go with the first. Every stage takes null
ids and texts, repeated rows and empty tables: what becomes of them is said at each, and in the operator it calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, mixing, ngram_join, packing
from tidemark.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that two lines may differ in at most; the operator's own default allows more, at several times the cost.
LINE_EDITS = 2
#: A prediction must have this share of the probability to be relied on.
LEAST_SCORE = 0.5


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letters (so null and empty texts too), or no language clearly the likeliest. A missing lang is
    filled in. Repeated rows are judged alike; where nothing is labelled, nothing can be told, and all go."""
    out = language_id.identify(docs)
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, wherever they first stood; n_chars follows the text. All documents stay, those with
    a null text or id and rows that repeat both as well."""
    out = line_dedup.drop_repeated_lines(docs, LINE_EDITS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8) the document of smallest id stays. Texts without words, and rows
    with a null id, stay; of rows that repeat an id all stay or go."""
    classes = ngram_join.ngram_classes(docs, 5, 80)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, as many tokens as came in; a document may come in two epochs. A null
    lang or source is a leaf of its own."""
    return mixing.mix(docs).select(*COLUMNS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences. A null text is the end token alone; repeated rows are packed each time."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("ngram_join", stage_near_copies),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL can express neither the language model nor the tokenizer; tests hold each stage against what is planted in small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage has read isn't needed any more
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs

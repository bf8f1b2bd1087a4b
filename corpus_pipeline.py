"""The corpus pipeline: five stages, each works on all that its predecessor kept.

Needs ``tracewarden.llm`` and is removed with it. Null texts count as empty: the quality rules reject
them. Rows without an id are kept apart from all others by the stages that join on ids. Of rows
that share an id each is judged by its own text, and rows equal in id and text become one at
the second stage. Very long texts are worked on whole. Empty tables give empty results. All
columns of the documents, whatever their names are, go through the first four stages unchanged,
but for text, and n_chars, which stays the length of the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm import ngram_join, packing, pii, quality_rules, suffix_array_dedup
from tracewarden.llm.shared import NO_ID, work_dir

#: What the suffix-array stage removes: strings of so many bytes that stand elsewhere too, and passages of more than so many words.
REPEAT_BYTES, PASSAGE_WORDS = 400, 50


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as long as the texts now are."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id; rows without an id stay.

    Rows that share an id are one document; of rows equal in id and text one stays, the least by a
    hash of all its columns.
    """
    ids = ngram_join.join(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("kept_id")).distinct()
    kept = docs.join(ids, F.coalesce(docs["doc_id"], F.lit(NO_ID)) == ids["kept_id"], "left_semi")
    named = Window.partitionBy("doc_id", F.md5("text")).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    one = kept.where("doc_id is not null").withColumn("__row", F.row_number().over(named)).where("__row = 1").drop("__row")
    return one.unionByName(kept.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEAT_BYTES`` bytes that stand elsewhere too, and shorter passages of more than ``PASSAGE_WORDS`` words, are taken out of the texts."""
    return _measured(suffix_array_dedup.cleaned(docs, REPEAT_BYTES, PASSAGE_WORDS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return _measured(pii.cleaned(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]

#: Jaccard components, suffix arrays and byte-pair coding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{work_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents: five stages, each one operator of ``colloquy.llm``.

Every stage reads what the one before kept, as Parquet; its decisions take
effect there. All but the last return the columns of ``documents``
(``n_chars`` follows the text). Each begins by having the executors give back
what the one before filled.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import linededup, neardup, packing, pii, toxicity
from colloquy.llm.shared import small, stage, tidy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go; the score needs no join back to the text."""
    tidy(spark, executors=True)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = toxicity.with_score(docs.select(*COLUMNS), labels)
    return kept.where(F.col("__toxicity") < 0.5).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats on more than a tenth of its different pages go; exact copies of a page count once."""
    tidy(spark, executors=True)
    return _columns(linededup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), copies_once=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    Rows are compared and decided one by one, so rows that share an id stay
    unless their texts are near-duplicates too; of a group the row with the
    smallest id stays. Blank texts go only where id and text repeat; rows with
    a null id all stay.
    """
    tidy(spark, executors=True)
    key = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    docs = stage(docs.select(*COLUMNS).withColumn("__row", key), "rows")
    found = stage(neardup.near_duplicates(docs, "__row").where("doc_id is not null").select(F.col("doc_id").alias("__row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component")), "near-duplicates")
    several = stage(found.where("component is not null").groupBy("component").agg(F.count("*").alias("c")).where("c > 1").select("component"), "several")
    blank = found.where("component is null")
    members = stage(found.join(small(several), "component").select("__row", "component").unionByName(blank.select("__row", "component")), "members")
    group = F.coalesce(F.col("component").cast("string"), F.concat_ws(":", "doc_id", F.coalesce(F.md5("text"), F.lit("")), F.lit("blank")))
    order = F.struct("doc_id", F.md5("text").alias("text"), "lang", "source", "__row")
    ranked = stage(docs.join(small(members), "__row").select(group.alias("group"), order.alias("place")), "ranked")
    first = ranked.groupBy("group").agg(F.min("place").alias("place")).select(F.col("place.__row").alias("__row"))
    gone = stage(ranked.select(F.col("place.__row").alias("__row")).join(first, "__row", "left_anti"), "gone")
    return docs.join(small(gone), "__row", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    tidy(spark, executors=True)
    return _columns(pii.redact(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of at most 4096 tokens."""
    tidy(spark, executors=True)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores and tokenisation have no SQL; tests compare the stages one by one with ``run`` and the operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs

"""Compiled messages read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import MESSAGE


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path)

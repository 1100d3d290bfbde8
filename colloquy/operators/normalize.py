"""Normalisation of redacted messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trim_end


def normalize(df: DataFrame) -> DataFrame:
    """Fills a zero ``original_length`` with the length in bytes, then trims the end of ``content``; the hash stays."""
    length = F.when(F.col("original_length") == 0, F.octet_length("content").cast("bigint")).otherwise(F.col("original_length"))
    return df.withColumns({"original_length": length, "content": trim_end(F.col("content"))})

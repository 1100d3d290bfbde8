"""Scores, score and age filters, and ranks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal_score
from ..storage import stage

#: Ages beyond which a cutoff would leave the calendar are as good as none.
MOST_DAYS = 700_000


def with_score(df: DataFrame, now: datetime) -> DataFrame:
    return df.withColumn("signal_score", signal_score(F.col("hits"), F.col("created_at"), F.col("role"), now))


def recent(created_at: Column, now: datetime, days: int) -> Column:
    """Whether a message is at most ``days`` old, the last moment included."""
    return created_at >= F.lit(now - timedelta(days=min(days, MOST_DAYS)))


def strong(score: Column, least: float) -> Column:
    return score >= F.lit(least).cast("float")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with ranks from 1 in a total order, without gathering all rows in one task.

    Rows are range-partitioned by the order; a rank is the rows of the ranges
    before plus the place within the range. Only one count per range meets in
    one place.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = dealt.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + place).cast("bigint"))
    return out.drop("__range", "__before")


def rank_by_score(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Best score first; equal scores keep input order."""
    return ranked(df, F.desc("signal_score"), F.asc(seq))

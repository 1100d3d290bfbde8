"""The fixed order of stages from messages to ranked messages and counters.

Ages are judged after folding on purpose: an old first copy absorbs a fresh
one and is then dropped with it.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.dedup import dedup
from ..operators.normalize import normalize
from ..operators.scrub import scrub
from ..operators.signals import rank_by_score, recent, strong, with_score
from ..schema import MESSAGE_COLUMNS
from ..storage import stage

STATS = ("total_input", "scrubbed", "total_redactions", "exact_dropped", "fuzzy_dropped", "age_dropped", "signal_dropped", "output")


class PipelineOutput(NamedTuple):
    """``messages`` carry ``rank`` (from 1) beside the message columns; ``stats`` is one row."""

    messages: DataFrame
    stats: DataFrame

    def one_line(self) -> str:
        return one_line(self.stats)


def one_line(stats: DataFrame) -> str:
    r = stats.first()
    names = ("in", "out", "scrubbed", "redactions", "dedup_exact", "dedup_fuzzy", "age_drop", "signal_drop")
    columns = ("total_input", "output", "scrubbed", "total_redactions", "exact_dropped", "fuzzy_dropped", "age_dropped", "signal_dropped")
    return " ".join(f"{n}={r[c]}" for n, c in zip(names, columns, strict=True))


class Pipeline:
    def __init__(self, config: PipelineConfig):
        self._config = config

    @classmethod
    def with_safe_defaults(cls) -> Pipeline:
        return cls(PipelineConfig.with_safe_defaults())

    @property
    def config(self) -> PipelineConfig:
        return self._config

    def run(self, messages: DataFrame, now: datetime, seq: str = "seq") -> PipelineOutput:
        """Compile ``messages``; ``seq`` is a unique long column that gives input order.

        ``total_redactions`` counts kinds a message, not occurrences.
        """
        if seq not in messages.columns:
            raise ValueError(f"messages need a unique order column; there is no {seq!r}")
        c = self._config
        prepared = stage(normalize(scrub(messages.select(*MESSAGE_COLUMNS, F.col(seq).alias("seq")), c.secret_patterns)), "prepared")
        result = dedup(prepared.drop("redacted_kinds"), c.dedup_threshold)
        scored = stage(with_score(result.survivors, now).withColumn("__recent", recent(F.col("created_at"), now, c.max_thread_age_days)), "scored")
        kept = scored.where("__recent").where(strong(F.col("signal_score"), c.signal_min))
        tail = scored.agg(
            F.count_if(~F.col("__recent")).alias("age_dropped"),
            F.count_if(F.col("__recent") & ~strong(F.col("signal_score"), c.signal_min)).alias("signal_dropped"),
            F.count_if(F.col("__recent") & strong(F.col("signal_score"), c.signal_min)).alias("output"),
        )
        head = prepared.agg(F.count("*").alias("total_input"), F.count_if(F.size("redacted_kinds") > 0).alias("scrubbed"), F.coalesce(F.sum(F.size("redacted_kinds")), F.lit(0)).cast("bigint").alias("total_redactions"))
        dropped = head.withColumns({"exact_dropped": F.lit(result.exact_dropped).cast("bigint"), "fuzzy_dropped": F.lit(result.fuzzy_dropped).cast("bigint")})
        stats = dropped.join(F.broadcast(tail)).select(*STATS)  # one row each
        return PipelineOutput(rank_by_score(kept.drop("__recent")).select("rank", *MESSAGE_COLUMNS), stats)

"""Threads: grouping, headers and Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rfc3339, slugify

#: The project of messages that have none.
NO_PROJECT = "_untitled"


def thread_groups(df: DataFrame) -> DataFrame:
    """One row for each (project, thread_id) of ranked messages.

    ``title`` and ``hint`` are the first non-null ones by rank; ``created``
    and ``updated`` belong to the first and last message by rank, not by time.
    """
    project = F.coalesce("project_hint", F.lit(NO_PROJECT))
    titled, hinted = F.when(F.col("thread_title").isNotNull(), F.col("rank")), F.when(F.col("project_hint").isNotNull(), F.col("rank"))
    return df.groupBy(project.alias("project"), "thread_id").agg(
        F.coalesce(F.min_by("thread_title", titled), F.first("thread_id")).alias("title"),
        F.min_by("project_hint", hinted).alias("hint"),
        F.min_by("source", "rank").alias("source"),
        F.min_by("created_at", "rank").alias("created"),
        F.max_by("created_at", "rank").alias("updated"),
        F.count("*").alias("messages"),
        F.min("rank").alias("first_rank"),
        F.sort_array(F.collect_list(F.struct("rank", "role", "created_at", "content"))).alias("items"),
    )


def render(groups: DataFrame) -> DataFrame:
    """``groups`` with the Markdown ``body`` of each thread and its ``path`` below the output folder."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    header = F.array_compact(
        F.array(
            F.concat(F.lit("# "), F.col("title")),
            F.lit(""),
            F.lit("<!-- metadata"),
            line("thread_id", F.col("thread_id")),
            line("source", F.col("source")),
            line("created", rfc3339(F.col("created"))),
            line("updated", rfc3339(F.col("updated"))),
            line("messages", F.col("messages").cast("string")),
            F.when(F.col("hint").isNotNull(), line("project_hint", F.col("hint"))),
            F.lit("-->"),
            F.lit(""),
        )
    )
    blocks = F.transform("items", lambda m: F.concat(F.lit("## "), m["role"], F.lit(" ("), rfc3339(m["created_at"]), F.lit(")\n\n"), m["content"], F.lit("\n\n")))
    path = F.concat(slugify(F.col("project")), F.lit("/"), slugify(F.col("title")), F.lit(".md"))
    return groups.withColumns({"body": F.concat(F.array_join(header, "\n"), F.lit("\n"), F.array_join(blocks, "")), "path": path})


def files(rendered: DataFrame) -> DataFrame:
    """(path, body, threads): one row for each file; of threads with one path the last by (project, thread_id) stays."""
    return rendered.groupBy("path").agg(F.max_by("body", F.struct("project", "thread_id")).alias("body"), F.count("*").alias("threads"))

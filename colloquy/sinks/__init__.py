"""Files: one JSON line a message, one Markdown file a thread."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.threads import files, render, thread_groups
from ..schema import MESSAGE_COLUMNS, OutputFormat
from ..storage import stage

log = logging.getLogger(__name__)

#: Bytes that the joining of parts holds at a time.
COPY_BYTES = 1 << 20
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def json_lines(messages: DataFrame) -> DataFrame:
    """(rank, value): each ranked message as JSON, nulls written."""
    return messages.select("rank", F.to_json(F.struct(*MESSAGE_COLUMNS), JSON_OPTIONS).alias("value"))


def write_jsonl(path: str, messages: DataFrame) -> str:
    """One file of JSON lines in rank order; an existing one is replaced.

    Ranges of ranks are turned into lines, sorted and written in parallel; the
    driver's JVM then streams the parts, in order, into the single file that
    the format wants.
    """
    spark = messages.sparkSession
    parts = f"{path}.parts"
    json_lines(messages).repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(parts)
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    written = sorted((s.getPath() for s in fs.listStatus(_path(spark, parts)) if s.getPath().getName().startswith("part-")), key=lambda part: part.getName())
    target, whole = _path(spark, path), _path(spark, f"{parts}/whole")
    joined = fs.create(whole)
    try:
        for part in written:
            lines = fs.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, joined, COPY_BYTES, False)
            finally:
                lines.close()
    finally:
        joined.close()
    fs.delete(target, False)
    fs.rename(whole, target)
    fs.delete(_path(spark, parts), True)
    return path


def _writer(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            store, base = fs.FileSystem.from_uri(root)
        else:
            store, base = fs.LocalFileSystem(), root
        for rows in batches:
            for path, body in zip(rows["path"], rows["body"], strict=True):
                full = f"{base}/{path}"
                store.create_dir(full.rpartition("/")[0], recursive=True)
                with store.open_output_stream(full) as f:
                    f.write(body.encode())
            yield rows[["path", "threads"]]

    return run


def write_markdown(root: str, messages: DataFrame) -> list[str]:
    """One file for each thread of ranked messages, written where the rows are; ``root`` is a shared folder.

    Threads whose project and title have equal slugs share a file: the last
    one by (project, thread_id) stays, and the others are logged.
    """
    todo = files(render(thread_groups(messages)))
    done = stage(todo.mapInPandas(_writer(root.rstrip("/")), "path string, threads long"), "written")
    lost = done.agg(F.coalesce(F.sum(F.col("threads") - 1), F.lit(0)).alias("n")).first()["n"]
    if lost:
        log.warning("%d threads were overwritten by others of the same project and title", lost)
    return sorted(f"{root.rstrip('/')}/{r.path}" for r in done.select("path").toLocalIterator())


def write_all(root: str, messages: DataFrame, fmt: OutputFormat) -> list[str]:
    """The files of a format, sorted by path."""
    out = []
    if fmt in (OutputFormat.JSONL, OutputFormat.BOTH):
        out.append(write_jsonl(f"{root.rstrip('/')}/memory.jsonl", messages))
    if fmt in (OutputFormat.MARKDOWN, OutputFormat.BOTH):
        out += write_markdown(root, messages)
    return sorted(out)

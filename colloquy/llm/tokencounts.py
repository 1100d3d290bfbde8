"""Token counts by section, attributed through character offsets.

A document is encoded once, as a whole; the character span of each token is
then located among the section spans (a vectorised interval join within the
document). A token whose characters lie in several sections is allocated by
a named rule, so the sections' counts always add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe, text_slices

RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of each token; section i spans [bounds[i], bounds[i + 1]).

    ``first``: the section of the token's first character; ``last``: of its
    last one; ``most``: the section with most of its characters, the earliest
    of several. Empty sections get nothing.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        inner = np.arange(first[i], last[i] + 1)
        share = np.minimum(bounds[inner + 1], ends[i]) - np.maximum(bounds[inner], starts[i])
        out[i] = inner[np.argmax(share)]
    return out


def line_bounds(text: str) -> np.ndarray:
    """Section bounds of lines; each line holds the line feed that ends it."""
    at, out = text.find("\n"), [0]
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*out, len(text)], np.int64)


def _count(path: str, pattern: str, rule: str, by_field: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            lengths = batch.column("lengths").to_pylist() if by_field else None
            for first, texts in text_slices(batch):
                n, crossing, counts = [], [], []
                for k, (text, (ids, starts, ends)) in enumerate(zip(texts, bpe.encode_with_offsets(texts), strict=True)):
                    bounds = np.concatenate(([0], np.cumsum(lengths[first + k]))) if by_field else line_bounds(text)
                    bounds[-1] = max(bounds[-1], len(text))
                    place = attribute(starts, ends, bounds, rule)
                    counts.append(np.bincount(place, minlength=len(bounds) - 1).tolist())
                    n.append(len(ids))
                    crossing.append(int(np.count_nonzero(np.searchsorted(bounds, starts, "right") != np.searchsorted(bounds, np.maximum(ends - 1, starts), "right"))))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(map(len, counts), pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.int64()))],
                    ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
                )
        bpe.forget()

    return run


_SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens), one row for each input row.

    Sections are the lines of ``text_col``, each with its line feed;
    ``n_crossing`` tokens lie in more than one. An empty or null text has one
    section without tokens. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_count(path, pattern, rule, False), _SCHEMA)


def field_token_counts(
    rows: DataFrame, path: str, pattern: str, id_col: str, fields: Sequence[str], separator: str = "\n", rule: str = "most"
) -> DataFrame:
    """As ``token_counts`` with ``fields`` as sections: the row is encoded as its
    fields joined by ``separator``, which belongs to the field before it. A null
    field is empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(p, F.lit(separator)) for p in parts[:-1]] + parts[-1:]
    source = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*(F.char_length(p) for p in parts)).alias("lengths"))
    return source.mapInArrow(_count(path, pattern, rule, True), _SCHEMA)

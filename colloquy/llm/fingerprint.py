"""Document fingerprints by locally consistent parsing.

Method: a text's code points are parsed into phrases by deterministic coin
tossing. Each symbol takes as label the lowest bit in which it differs from
its left neighbour (and that bit's value); a few rounds shrink labels to
fewer than eight values; phrases start at local maxima. A phrase's name is a
hash of its symbols' names, and the names are parsed again, level upon
level, until one is left. Whether a phrase starts somewhere depends on a few
neighbours only, so equal substrings get equal names inside, wherever they
stand. The fingerprint is a MinHash sketch of the names of all phrases of at
least ``LEAST_SPAN`` code points (fewer in short texts) and of the root, so likeness estimates
the share of common phrases.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release
from .words import mix64

#: Sketch coordinates, each of 16 bits (four hexadecimal digits).
COORDINATES = 128
#: Code points that a phrase must span to count; in short texts an eighth of them, but four at least.
LEAST_SPAN, SHORT_SPAN = 16, 4
#: Fingerprint of a text without code points.
EMPTY = "0" * (4 * COORDINATES)
SLICE_CHARS = 1 << 19

_rng = np.random.default_rng(77003)
_PLACE = _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_LOW_BIT = np.array([(v & -v).bit_length() - 1 if v else 0 for v in range(256)], np.uint8)
_ONE = np.uint64(1)


def _collapse_runs(names: np.ndarray, span: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol become one symbol named by it and the length."""
    head = np.empty(len(names), bool)
    head[0] = True
    np.not_equal(names[1:], names[:-1], out=head[1:])
    head[starts] = True
    if head.all():
        return names, span, starts
    at = np.flatnonzero(head)
    length = np.diff(at, append=len(names))
    out = names[at]
    long = length > 1
    out[long] = mix64(out[long] ^ mix64(length[long].astype(np.uint64)))
    return out, np.add.reduceat(span, at), np.searchsorted(at, starts)


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Four rounds of coin tossing: labels below eight, distinct between neighbours of one text."""

    def left(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[starts] = ~x[starts]
        return out

    differ = names ^ left(names)
    bit = np.bitwise_count((differ & (~differ + _ONE)) - _ONE)
    label = (bit << 1) | ((names >> bit.astype(np.uint64)) & _ONE).astype(np.uint8)
    for _ in range(3):
        bit = _LOW_BIT[label ^ left(label)]
        label = (bit << 1) | ((label >> bit) & 1)
    return label


def _parse(names: np.ndarray, span: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, span, starts = _collapse_runs(names, span, starts)
    label = _labels(names, starts)
    right = np.zeros_like(label)
    right[:-1] = label[1:]
    right[starts[1:] - 1] = 0
    peak = label >= right
    peak[1:] &= label[1:] > label[:-1]
    peak[starts] = True
    at = np.flatnonzero(peak)
    length = np.diff(at, append=len(names))
    place = np.arange(len(names)) - np.repeat(at, length)
    with np.errstate(over="ignore"):
        out = mix64(np.add.reduceat(names * _PLACE[place & 4095], at))
    return out, np.add.reduceat(span, at), np.searchsorted(at, starts)


def phrases(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, name) of the phrases that count, of all levels, for non-empty texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names = mix64(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    span = np.ones(len(names), np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    index = np.arange(len(texts))
    least = np.clip(sizes // 8, SHORT_SPAN, LEAST_SPAN)
    owners, found = [], []
    while len(index):
        names, span, starts = _parse(names, span, starts)
        owner = np.repeat(np.arange(len(index)), np.diff(starts, append=len(names)))
        single = np.diff(starts, append=len(names)) == 1
        counts = (span >= least[index][owner]) | single[owner]
        owners.append(index[owner[counts]])
        found.append(names[counts])
        if single.any():  # roots are done
            stay = ~single[owner]
            names, span = names[stay], span[stay]
            kept = owner[stay]
            index = index[~single]
            starts = np.flatnonzero(np.diff(kept, prepend=-1)) if len(kept) else np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(found)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text; equal texts have equal ones."""
    out = [EMPTY] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    owner, name = phrases([texts[i] for i in full])
    order = np.argsort(owner, kind="stable")
    base = (name[order] >> np.uint64(32)).astype(np.uint32)
    starts = np.searchsorted(owner[order], np.arange(len(full)))
    table = np.empty((len(full), COORDINATES), np.uint16)
    y, z = np.empty_like(base), np.empty_like(base)
    for k in range(COORDINATES):
        np.add(base, np.uint32((k * 0x9E3779B9) & 0xFFFFFFFF), out=y)
        np.multiply(y, np.uint32(0x85EBCA6B), out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0xC2B2AE35), out=y)
        low = np.minimum.reduceat(y, starts)
        table[:, k] = ((low * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.uint16)
    for row, i in enumerate(full):
        out[i] = table[row].astype(">u2").tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal coordinates, 0 to 1: estimates the resemblance of the phrase sets."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint16), np.frombuffer(bytes.fromhex(b), np.uint16)
    return float(np.count_nonzero(x == y)) / COORDINATES


def edit(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) is replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A place in the order of documents: whether the id is not null, the id, the hash of the text.
Place = tuple[bool, int, int]
LEAST_TIE = -1
#: Quantiles are exact up to here; beyond, they may fall between the values.
EXACT = 2**53


def _tie(text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text_col), 11)


def _existing(source: DataFrame, cuts: list[int]) -> list[int]:
    """For each cut the smallest id that is not below it, if there is one."""
    edges = np.array(sorted(set(cuts)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(np.asarray(batch.column("doc_id").drop_null(), np.int64))
            part, at = np.unique(np.searchsorted(edges, ids, "right"), return_index=True)
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(ids[at])], ["part", "least"])

    least = source.select("doc_id").mapInArrow(run, "part int, least long").groupBy("part").agg(F.min("least").alias("least")).orderBy("part").collect()
    parts = [r["part"] for r in least]
    at = [bisect_left(parts, int(np.searchsorted(edges, c)) + 1) for c in cuts]
    return [least[k]["least"] for k in at if k < len(least)]


def _bounds(source: DataFrame, n: int) -> list[Place]:
    """Where each of about ``n`` ranges of documents starts, in order.

    The starts are ids of quantiles. An id that several quantiles fall on, and
    null where nulls fill several ranges, is cut again at the quantiles of its
    hashes, so no id needs to fit into one range. Even a start may occur
    several times: that many ranges share the rows which are alike in id and text.
    """
    accuracy = max(10_000, 20 * n)
    row = source.agg(
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
        F.count("*").alias("rows"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
        F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], accuracy).alias("cuts"),
    ).first()
    cuts = (row["cuts"] or []) if n > 1 else []
    if cuts and max(-row["low"], row["high"]) > EXACT:
        cuts = _existing(source, cuts)
    parts: dict[int | None, int] = {}
    if row["nulls"]:
        parts[None] = max(1, round(n * row["nulls"] / row["rows"]))
    if row["low"] is not None:
        parts[row["low"]] = 1
    for cut in cuts:
        parts[cut] = parts.get(cut, 0) + 1
    hot = [i for i, m in parts.items() if m > 1]
    ties: dict[int | None, list[int]] = {}
    if hot:
        most = max(parts[i] for i in hot)
        among = F.col("doc_id").isin([i for i in hot if i is not None])
        among = among | F.col("doc_id").isNull() if None in hot else among
        found = source.where(among).groupBy("doc_id").agg(F.min("tie").alias("least"), F.percentile_approx("tie", [k / most for k in range(1, most)], accuracy).alias("ties"))
        ties = {r["doc_id"]: [r["least"], *(r["ties"][k * most // parts[r["doc_id"]] - 1] for k in range(1, parts[r["doc_id"]]))] for r in found.collect()}
    return sorted((i is not None, i or 0, tie) for i in parts for tie in ties.get(i, [LEAST_TIE])) or [(False, 0, LEAST_TIE)]


def _deal(bounds: list[Place]):
    """Rows with the range of their place; a range's first document goes to the range before as well."""
    first = [bisect_left(bounds, b) for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, ties = batch.column("doc_id"), batch.column("tie")
            bucket, heads, shared = [], {}, {}
            for at, (i, tie) in enumerate(zip(ids.to_pylist(), ties.to_pylist(), strict=True)):
                place = (i is not None, i or 0, tie)
                last = bisect_right(bounds, place) - 1
                bound = bounds[last]
                if bound[:2] == place[:2] and (last not in heads or tie < heads[last][0]):
                    heads[last] = (tie, at)
                if bound == place and first[last] < last:  # alike rows: the last range has one at least
                    turn = shared[last] = shared.get(last, -1) + 1
                    last -= turn % (last - first[last] + 1)
                bucket.append(last)
            tails = [((b - 1) % len(bounds), at) for last, (_, at) in heads.items() for b in range(first[last], last + 1)]
            rows = pa.array([*range(len(batch)), *(at for _, at in tails)], pa.int64())
            text = pa.array([pack.compress(x.as_buffer()) if x.is_valid else pack.compress(b"") for x in batch.column("text")], pa.binary())
            yield pa.record_batch(
                [
                    pa.array(bucket + [b for b, _ in tails], pa.int32()),
                    pa.array([0] * len(batch) + [1] * len(tails), pa.int32()),
                    ids.take(rows),
                    ties.take(rows),
                    text.take(rows),
                ],
                ["bucket", "tail", "doc_id", "tie", "text"],
            )

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, str]]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for b, t, i, x in zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            yield b, t, i, unpack.decompress(x.as_buffer()).decode()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, text of the next document)."""
    held = None
    for row in _rows(batches):
        if held is not None and held[0] == row[0]:
            yield held[2], held[3], row[3]
        held = None if row[1] else row


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(part: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edited = [edit(text, following) for _, text, following in part]
        wanted = dict.fromkeys([x for _, text, following in part for x in (text, following)] + edited)
        names = list(wanted)
        known = dict(zip(names, fingerprints(names), strict=True))
        rows = []
        for (i, text, following), new in zip(part, edited, strict=True):
            own, other = known[text], known[new]
            rows.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, known[following])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    part, size = [], 0
    for row in _pairs(batches):
        part.append(row)
        size += len(row[1])
        if size > SLICE_CHARS:
            yield out(part)
            part, size = [], 0
    if part:
        yield out(part)
    release()


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row for each input row. The next document is the next row by id (null
    ids first), rows of one id by a hash of the text; the last row's is the
    first. Null texts count as empty; an empty text resembles only another.
    Other columns are ignored; an empty table gives an empty result.

    The order is cut at quantiles, within one id too where it holds many rows,
    so each range is dealt to one task of its own with the first document of
    the range after it, and every text travels once, compressed.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), _tie(text_col).alias("tie"), F.col(text_col).alias("text"))
    bounds = _bounds(source, buckets or source.rdd.getNumPartitions())
    dealt = source.mapInArrow(_deal(bounds), "bucket int, tail int, doc_id long, tie long, text binary")
    near = dealt.repartitionById(len(bounds), F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "tie")
    return near.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        out = [f for at in range(0, len(texts), 100) for f in fingerprints(texts[at : at + 100])]
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row for each input row, without a shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint, "doc_id long, fingerprint string")

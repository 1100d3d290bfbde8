"""MinHash near-duplicate components with circulant permutations.

Method: a first permutation scatters the shingles over [0, 2**32); a second
one, shifted circularly by k, gives signature coordinate k (C-MinHash). The
coordinates are banded; documents that share a band are candidates, and a
candidate pair counts only after the exact comparison of both full shingle
sets.

How groups stay bounded:

* documents with equal shingle sets form one class and enter once;
* round 1 compares each class with one other class only, the smallest id
  among its bands, and contracts what is confirmed;
* round 2 compares, within each band bucket that still holds several
  components, the members outside the largest component with one member of
  that component, another one in each bucket, and contracts again: a member
  of a group of near copies meets many of the others so;
* round 3 compares, within the buckets that are mixed even then, the members
  outside the largest component with all members of other components, so a bucket of m members of which all but s are already
  linked costs s * m comparisons instead of m * m; a bound from 1024 shingle
  parities, exact in that it never exceeds the true difference of two sets,
  settles most of them before any set is fetched;
* a bucket for which even that exceeds ``BUCKET_PAIRS`` is taken apart
  exactly: its members are indexed by the rarest shingles that any set at
  the wanted similarity must share (prefix filtering), which separates
  documents that merely have a common passage.

With 32 bands of 5 rows a pair at exactly 0.8 shares no band with
probability 3e-6, at 0.85 with 2e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .shared import BROADCAST_ROWS, modest_batches, release, small, stage, tidy

BANDS, ROWS = 32, 5
#: 64-bit words of shingle parities kept for the bound in ``_can_link``.
PARITY_WORDS = 16
_PARITY = [f"p{k}" for k in range(PARITY_WORDS)]
#: Members of a bucket that one task compares with those outside the largest component.
PART = 512
#: Comparisons in one bucket (each a few popcounts) beyond which it is taken apart by prefix filtering.
BUCKET_PAIRS = 4_000_000


def circulant_signature(sets: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(k, documents) uint32 signature of concatenated shingle hashes; no set may be empty."""
    out = np.empty((k, len(starts)), dtype=np.uint32)
    scattered = (W.mix64(sets) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    y, z = np.empty_like(scattered), np.empty_like(scattered)
    for shift in range(k):
        np.subtract(scattered, np.uint32(shift), out=y)  # the second, circularly shifted
        np.multiply(y, np.uint32(0x85EBCA6B), out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0xC2B2AE35), out=y)
        np.right_shift(y, np.uint32(16), out=z)
        np.bitwise_xor(y, z, out=y)
        out[shift] = np.minimum.reduceat(y, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) int64 bucket keys."""
    keys = np.empty((signature.shape[1], bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(signature.shape[1], b + 1, dtype=np.uint64)
            for r in range(rows):
                h = W.mix64(h * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
            keys[:, b] = h
    return keys.view(np.int64)


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = list(W.shingles(part, size))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                digests: list[bytes | None] = [None] * len(sets)
                keys: list[bytes | None] = [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    table = band_keys(circulant_signature(flat, starts, bands * rows), bands, rows)
                    for row, i in enumerate(full):
                        digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        keys[i] = table[row].tobytes()
                ids = batch.column("doc_id").slice(part.first, len(sets))
                yield pa.record_batch([ids, pa.array(n), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "digest", "keys"])
        release()

    return run


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            raw, offs = W.string_buffers(part.column("keys"))
            keys = np.frombuffer(raw[offs[0] : offs[-1]].tobytes(), dtype=np.int64)
            each = np.diff(offs) // 8
            yield pa.record_batch([pa.array(keys), pa.array(np.repeat(part.column("node").to_numpy(), each)), pa.array(np.repeat(part.column("n").to_numpy(), each))], ["key", "node", "n"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = [s.tobytes() for s in W.shingles(part, size)]
                yield pa.record_batch([batch.column("node").slice(part.first, len(sets)), pa.array(sets, pa.binary())], ["node", "shingles"])
        release()

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("left_set"), batch.column("right_set")
            keep = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))
        release()

    return run


def _texts_of(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, text) of the wanted classes; ``reps`` has the text of every document."""
    return reps.join(small(nodes), "node", "left_semi")


def _sets_of(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Staged (node, shingles) of the wanted classes."""
    return stage(_texts_of(nodes, texts).mapInArrow(_sets(size), "node long, shingles binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The staged pairs(u, v) whose full sets pass."""
    joined = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("left_set")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("right_set")), "v")
        .select("u", "v", "left_set", "right_set")
    )
    return stage(joined.mapInArrow(_confirm(percent), "u long, v long").distinct(), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")


def _explode_sets(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("shingles").alias("keys"), "node", F.lit(0).cast("long").alias("n")).mapInArrow(_explode_keys, "key long, node long, n long")


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.zeros((len(batch), 64 * PARITY_WORDS), np.uint8)
        for i, raw in enumerate(batch.column("shingles")):
            place = np.frombuffer(raw.as_buffer(), np.uint64) >> np.uint64(17)
            table[i] = np.bincount((place % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
        words = np.packbits(table, axis=1).view(np.int64)
        yield pa.record_batch([batch.column("node"), *(pa.array(words[:, k]) for k in range(PARITY_WORDS))], ["node", *_PARITY])
    release()


def _sketched(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the parity words of their node; nodes of several texts get none."""
    words = sets.mapInArrow(_parities, "node long, " + ", ".join(f"{c} long" for c in _PARITY))
    one = words.groupBy("node").agg(F.count("*").alias("texts"), *(F.min(c).alias(c) for c in _PARITY)).where("texts = 1").drop("texts")
    return rows.join(stage(one, "parities"), "node", "left")


def _can_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parities leave room for a link.

    Each shingle that only one of two sets has flips one parity, so as many
    differ at least as parities do; a link allows (n + m) * (100 - percent) /
    (100 + percent) of them.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _PARITY])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & F.coalesce((100 + percent) * differ <= (100 - percent) * (n + m), F.lit(True))


def _across(rows: DataFrame, percent: int, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(pairs, nodes of buckets beyond the limit) for rows(key, node, n, component, pos, parities).

    Pairs join the members outside a bucket's largest component with the
    members of other components. A bucket's members are dealt to parts of
    about ``PART``, each of which meets all those outside, so that one
    bucket is not one task's work. ``pos`` is null, or the place of
    the key in the node's ordered set.
    """
    per = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    cost = per.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("component", "c").alias("major"), F.count("*").alias("k")).where("k > 1")
    cost = stage(cost.select("key", "major", (F.col("m") * (F.col("m") - F.col("most"))).alias("pairs"), F.ceil(F.col("m") / PART).cast("int").alias("parts")), "buckets")
    tagged = rows.join(small(cost), "key")
    fits = tagged if limit is None else tagged.where(F.col("pairs") <= limit)
    left = fits.where("component <> major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("a")
    right = fits.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("b")
    on = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.part") == F.col("b.part"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("b.component") == F.col("b.major")) | (F.col("a.node") < F.col("b.node")))
        & _can_link("a", "b", percent)
        & _can_overlap("a", "b", percent)
    )
    pairs = left.join(right, on).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    beyond = tagged.where(F.lit(False) if limit is None else F.col("pairs") > limit)
    return pairs.distinct(), beyond.drop("key", "major", "pairs", "parts", "pos").distinct()


def _can_overlap(a: str, b: str, percent: int) -> Column:
    """Whether enough can follow the place of a shared key.

    At the first key that two ordered sets share nothing before it is shared,
    so one more than what follows in the shorter rest bounds the overlap; a
    link of sizes n and m needs percent * (n + m) / (100 + percent).
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return F.coalesce((100 + percent) * rest >= percent * (n + m), F.lit(True))


def _with_major(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs(u, v) of each member outside its bucket's largest component with one member of it, where sizes and parities allow a link."""
    one = F.min_by(F.struct("node", "n", *_PARITY), F.xxhash64("node", "key"))
    per = rows.groupBy("key", "component").agg(F.count("*").alias("c"), one.alias("one"))
    major = per.groupBy("key").agg(F.max_by(F.struct("component", "one"), "c").alias("x")).select("key", "x.component", "x.one.*")
    a, b = rows.alias("a"), small(stage(major, "major"), BROADCAST_ROWS // 10).alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & _can_link("a", "b", percent))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _prefix_rows(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows keyed by the shingles of which any two sets at ``percent`` share one.

    Shingles are ordered by rarity within ``hot``; of n shingles the first
    n - ceil(percent * n / 100) + 1 are indexed, with their place (nodes of
    several texts have none).
    """
    each = stage(_explode_sets(sets.join(hot.select("node").distinct(), "node", "left_semi")), "hot-shingles")
    rarity = each.groupBy("key").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    keep = F.expr(f"cast(size(s) - ceil({percent} * cast(size(s) as bigint) / 100.0) + 1 as int)")
    keys = ranked.select("node", F.size("s").cast("long").alias("size"), F.posexplode(F.slice("s", 1, keep)).alias("pos", "x")).select(F.col("x.key").alias("key"), "node", "pos", "size")
    return keys.join(hot, "node").withColumn("pos", F.when(F.col("p0").isNotNull() & (F.col("size") == F.col("n")), F.col("pos"))).drop("size")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bucket_pairs: int = BUCKET_PAIRS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their
    sets of distinct ``size``-word shingles; a component is what links reach,
    named by its smallest id. A document with fewer words has its whole
    sequence as one shingle; an empty, blank or null text has none and is a
    component of its own. Equal sets always link. Rows that share an id are
    one vertex (any of their texts links it); rows with a null id never link
    and come back with a null component and ``kept`` true. Other columns of
    ``docs`` are ignored.
    """
    modest_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(source.mapInArrow(_signatures(size, bands, rows), "doc_id long, n_shingles long, digest binary, keys binary"), "signatures")
    usable = signed.where("doc_id is not null and digest is not null")
    classes = stage(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("keys").alias("keys")), "classes")
    texts = source.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")

    each = classes.select("node", "n", "keys").mapInArrow(_explode_keys, "key long, node long, n long")
    multi = stage(each.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("key", "pivot"), "multi")
    shared = stage(each.join(multi, "key"), "shared")
    first = stage(shared.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("u")).select("u", F.col("node").alias("v")), "first")
    links = _verified(first, _sets_of(_ends(first), texts, size), percent)
    found = stage(connected_components(links), "components")

    tidy(docs.sparkSession, executors=True)
    bucketed = stage(shared.select("key", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "bucketed")
    mixed = bucketed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    members = stage(bucketed.join(mixed, "key"), "mixed")
    sets = _sets_of(stage(members.select("node").distinct(), "nodes"), texts, size)
    members = stage(_sketched(members, sets).withColumn("pos", F.lit(None).cast("int")), "sketched")
    tried = stage(_with_major(members, percent).join(first, ["u", "v"], "left_anti"), "tried")
    links = stage(links.unionByName(_verified(tried, sets, percent)), "links")
    found = stage(connected_components(links), "components")
    tidy(docs.sparkSession, executors=True)
    members = stage(members.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    pairs, hot = _across(members, percent, bucket_pairs)
    hot = stage(hot, "hot")
    if not hot.isEmpty():
        more, _ = _across(stage(_prefix_rows(hot, sets, percent), "prefixes"), percent, None)
        pairs = pairs.unionByName(more)
    second = stage(pairs.distinct().join(first.unionByName(tried), ["u", "v"], "left_anti"), "second")
    links = links.unionByName(_verified(second, sets, percent))
    # classes whose smallest document is shared, and rows that repeat an id, meet here
    member = usable.join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    repeated = member.where("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    ids = member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    links = links.unionByName(repeated.join(ids.select(F.col("doc_id").alias("v")), "v", "left_semi").select("u", "v"))
    final = stage(connected_components(links), "components")
    tidy(docs.sparkSession, executors=True)

    named = classes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    bare = signed.select("doc_id", "n_shingles", "digest")
    out = bare.where("digest is not null").join(named, "digest", "left").unionByName(bare.where("digest is null").withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

"""Encoding, token counts, packing and fingerprints, against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import bpe, fingerprint, packing, tokencounts

RANKS, PATTERN, WORDS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("word_bpe_49k.json")
TEXTS = ["", None, "  a", "a b \n c\t d ", "x\x1c y  \x1c z", "l'été d'e  ", "🙂🙂 👩‍👩‍👧", " \n\n x", "can't WON'T 's  's", "<|endoftext|> a", "a" * 5000, " " * 300 + "x", "１２３ ٣ Ⅷ²", "one two\nthree\n\n\nfour " * 2000, "a b", "a b"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture
def frame(spark):
    rows = [(i if i else None, t, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_tiktoken(reference, text):
    encoder = bpe.byte_bpe(RANKS, PATTERN)
    ids = next(iter(encoder.encode([text]))).tolist()
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()
    assert "".join(encoder.decode_text(ids)) == text


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n\t'sé🙂", max_size=40))
def test_offsets_equal_the_library(text):
    encoder = bpe.byte_bpe(RANKS, PATTERN)
    ids, starts, ends = next(iter(encoder.encode_with_offsets([text])))
    whole = encoder.tokenizer.encode(text, add_special_tokens=False)
    assert ids.tolist() == whole.ids
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == whole.offsets


def test_round_trip_query(frame, reference):
    rows = bpe.round_trip(frame, RANKS, PATTERN).collect()
    expected = []
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        expected.append((i if i else None, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert bpe.round_trip(frame.limit(0), RANKS, PATTERN).collect() == []


def test_encode_then_decode(frame):
    tokens = bpe.encode(frame, RANKS, PATTERN)
    assert sorted((r.text for r in bpe.decode(tokens, RANKS, PATTERN).collect())) == sorted(t or "" for t in TEXTS)


def test_decoding_repairs_broken_characters(spark):
    encoder = bpe.byte_bpe(RANKS, PATTERN)
    ids = next(iter(encoder.encode(["🙂"]))).tolist()
    assert "".join(encoder.decode_text(ids[:1])) == "�"


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts_equal_brute_force(frame, rule):
    encoder = bpe.byte_bpe(RANKS, PATTERN)
    for row in tokencounts.token_counts(frame, RANKS, PATTERN, rule=rule).collect():
        text = TEXTS[row.doc_id or 0] or ""
        starts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"]
        counts, crossing = [0] * len(starts), 0
        line = np.cumsum([0] + [c == "\n" for c in text])
        for a, b in encoder.tokenizer.encode(text, add_special_tokens=False).offsets:
            held = [int(line[k]) for k in range(a, b)]
            crossing += len(set(held)) > 1
            counts[{"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]] += 1
        assert (row.section_tokens, row.n_crossing, row.n_sections) == (counts, crossing, len(starts))
        assert row.n_tokens == sum(counts)


def test_field_counts_add_up(spark):
    rows = spark.createDataFrame([(1, "Title here", None, "body text"), (2, "", "", "")], "id long, title string, note string, body string")
    found = {r.doc_id: r for r in tokencounts.field_token_counts(rows, RANKS, PATTERN, "id", ["title", "note", "body"]).collect()}
    assert sum(found[1].section_tokens) == found[1].n_tokens and len(found[1].section_tokens) == 3 and found[1].section_tokens[2] > 0
    with pytest.raises(ValueError):
        tokencounts.token_counts(rows, RANKS, PATTERN, rule="none")


def bins_of(lengths, capacity, full=0.0):
    where, offset, rank = packing.pack_items(np.array(lengths, np.int64), capacity, full)
    bins = {}
    for n, b, o in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        bins.setdefault(b, []).append((o, n))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return [sum(n for _, n in spans) for spans in bins.values()], rank.tolist()


def plain_best_fit(lengths, capacity):
    fills = []
    for n in sorted(lengths, reverse=True):
        fitting = [(f, i) for i, f in enumerate(fills) if f + n <= capacity]
        if fitting:
            fills[max(fitting)[1]] += n
        else:
            fills.append(n)
    return fills


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_places_everything_without_gaps(lengths):
    fills, rank = bins_of(lengths, 64)
    assert sorted(fills) == sorted(plain_best_fit(lengths, 64)) and set(rank) <= {-1}
    fills, rank = bins_of(lengths, 64, 0.95)
    alone = sorted((n, r) for n, r in zip(lengths, rank, strict=True) if r >= 0)
    assert all(f >= 0.95 * 64 for f in fills) or len(alone) >= sum(f < 0.95 * 64 for f in fills)
    assert alone == sorted((n, k) for n, c in Counter(n for n, _ in alone).items() for k in range(c))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 32)), min_size=1, max_size=80), st.sampled_from([0.0, 0.9]))
def test_merges_move_each_item_once(items, full):
    held = Counter(items)
    child, length, n = np.array([(*k, c) for k, c in held.items()], np.int64).T
    bins, stay, seen = {}, [], Counter()
    for c, size, low, high, into, shift, to_rank in zip(*(x.tolist() for x in packing.merge_counts(child, length, n, 32, full)), strict=True):
        for rank in range(low, high):
            seen[c, size, rank] += 1
            if into >= 0:
                bins.setdefault(into + rank - low, []).append((shift, size))
            else:
                stay.append((size, to_rank + rank - low))
    assert seen == Counter((c, size, k) for (c, size), m in held.items() for k in range(m))
    for spans in bins.values():
        at = 0
        for o, size in sorted(spans):
            assert o == at
            at += size
        assert full * 32 <= at <= 32
    assert sorted(stay) == sorted((size, k) for size, m in Counter(s for s, _ in stay).items() for k in range(m))
    if not full:
        assert len(bins) == len(plain_best_fit([size for _, size in items], 32)) and not stay


def test_a_tree_of_merges_is_as_good_as_one_best_fit():
    rng = np.random.default_rng(1)
    capacity, tasks = 4096, 512
    lengths = [np.clip(rng.lognormal(5.8, 1.3, 40).astype(int), 1, capacity) for _ in range(tasks)]
    level = []
    sequences = 0
    for task, some in enumerate(lengths):
        where, _, rank = packing.pack_items(some, capacity, packing.NEARLY_FULL)
        sequences += len(np.unique(where[rank < 0]))
        level += [(task, *x) for x in zip(*np.unique(some[rank >= 0], return_counts=True), strict=True)]
    top = tasks - 1
    while top:
        top >>= packing.FAN_BITS
        table, level = np.array(level), []
        for g in np.unique(table[:, 0] >> packing.FAN_BITS):
            _, length, low, high, into, shift, _ = packing.merge_counts(*table[table[:, 0] >> packing.FAN_BITS == g].T, capacity, packing.NEARLY_FULL if top else 0.0)
            sequences += int((high - low)[(into >= 0) & (shift == 0)].sum())
            level += [(g, size, (high - low)[(into < 0) & (length == size)].sum()) for size in np.unique(length[into < 0])]
    every = np.concatenate(lengths)
    assert sequences <= 1.002 * len(np.unique(packing.pack_items(every, capacity, 0.0)[0]))


def packed_rows(spark, texts, capacity, partitions):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(partitions)
    return packing.pack(frame, WORDS, capacity=capacity).collect()


def check_packing(texts, rows, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("partitions", [1, 40])  # 40: eight pieces each, so mostly merged
def test_packing_is_gapless_and_tight(spark, partitions):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "Beta's", "gamma,", "naïve", "12ab"], rng.integers(0, 30))) for _ in range(300)] + [None, "", "<|endoftext|> x", "word " * 500, " a b c"]
    texts += ["A<|endoftext|>B. <|ENDOFTEXT|> <|startoftext|>, É<|x", "A\u0301E\u0308. I\u0307 K\u030c word's", "É naïve\u0301 ǅ İI ß. ﬁ a\x1cb\x85c\u00a0d", "x" * 3000, "z." * 700]
    rows = packed_rows(spark, texts, 64, partitions)
    sequences = check_packing(texts, rows, 64)
    assert sequences <= 1.02 * len(plain_best_fit([r.length for r in rows], 64)) + 1  # 64 tokens leave few ways to fill a bin


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def test_fingerprints_are_local_and_stable():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(900)]
    a, b = " ".join(words[:400]), " ".join(words[400:800])
    half = fingerprint.edit(a, b)
    fa, fb, fh, moved = fingerprint.fingerprints([a, b, half, "some words in front " + a])
    assert fingerprint.likeness(fa, fa) == 1.0 and fa == fingerprint.fingerprints(["x", a])[1]
    assert fingerprint.likeness(fa, moved) > 0.8
    assert 0.15 < fingerprint.likeness(fa, fh) < 0.6
    assert fingerprint.likeness(fa, fb) < 0.05
    assert fingerprint.likeness(fingerprint.EMPTY, fa) == 0.0


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdef "), 3000))
    texts = ["".join(rng.choice(list("ghijk "), n)) + shared for n in (10, 137)]
    owner, name = fingerprint.phrases(texts)
    x, y = set(name[owner == 0].tolist()), set(name[owner == 1].tolist())
    assert len(x & y) > 0.8 * min(len(x), len(y)) * 0.9


@pytest.mark.parametrize("buckets", [1, 7])
def test_fingerprint_query_equals_brute_force(spark, buckets):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc déf🙂"), rng.integers(0, 200))) for _ in range(60)] + [None, "", "a", "aaaa" * 50, "z" * 50_000]
    rows = [(int(i) * 3, t, "clash") for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    found = {r.doc_id: r for r in fingerprint.fingerprint_edits(frame, buckets=buckets).collect()}
    ordered = sorted((i, t or "") for i, t, _ in rows)
    assert len(found) == len(rows)
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = fingerprint.edit(t, following)
        own, other, next_ = fingerprint.fingerprints([t, edited, following])
        r = found[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, other), fingerprint.likeness(own, next_))


def test_fingerprint_edge_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprint.fingerprint_edits(spark.createDataFrame([], schema)).collect() == []
    one = fingerprint.fingerprint_edits(spark.createDataFrame([(5, "abcd")], schema)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    odd = spark.createDataFrame([(None, "null id"), (2, "x"), (2, "x"), (2, "yy"), (None, None)], schema)
    assert len(fingerprint.fingerprint_edits(odd, buckets=3).collect()) == 5
    assert len(fingerprint.fingerprint(odd).collect()) == 5


@pytest.mark.parametrize("hot, far", [(None, 0), (7, 0), (None, 2**62)])
def test_fingerprints_of_a_hot_id(spark, hot, far):
    """Many rows of one id, a part of them alike, are dealt to many ranges and still follow one another."""
    rng = random.Random(5)
    rows = [(hot, f"row {k} {rng.random()}") for k in range(300)] + [(hot, "the same text again")] * 400 + [(hot, None)] * 20 + [(far + k * ((far >> 20) or 1) + k, f"document {k} {rng.random()}") for k in range(-20, 280) if k != 7]
    schema = "doc_id long, text string"
    frame = spark.createDataFrame(rows, schema).repartition(6)
    source = frame.select("doc_id", fingerprint._tie("text").alias("tie"), "text")
    bounds = fingerprint._bounds(source, 40)
    assert bounds == sorted(bounds) and len(bounds) > len(set(bounds)) > 20
    dealt = source.mapInArrow(fingerprint._deal(bounds), "bucket int, tail int, doc_id long, tie long, text binary")
    assert dealt.where("tail = 0").groupBy("bucket").count().agg(F.max("count")).first()[0] < 60
    found = fingerprint.fingerprint_edits(frame, buckets=40).collect()
    order = [(r.doc_id, r.text or "") for r in source.orderBy(F.col("doc_id").asc_nulls_first(), "tie").collect()]
    wanted = sorted((str(i), hashlib.sha256(fingerprint.edit(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in found) == wanted

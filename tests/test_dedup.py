"""Folding against a sequential model of its definition."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import content_hash
from colloquy.operators import dedup


def token_set(text):
    return {t for t in re.split(r"[\W_]+", text.lower()) if t}


def resemblance(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def model(texts, threshold):
    """hits by index, first exact then greedy."""
    first, hits = {}, {}
    for i, t in enumerate(texts):
        if t in first:
            hits[first[t]] += 1
        else:
            first[t] = i
            hits[i] = 1
    kept, more, sets = [], {}, {i: token_set(texts[i]) for i in hits}
    for i in sorted(hits):
        for k in kept:
            if resemblance(sets[i], sets[k]) > threshold:
                more[k] = more.get(k, 0) + 1
                break
        else:
            kept.append(i)
    return {i: hits[i] + more.get(i, 0) for i in kept}


def folded(spark, texts, threshold, partitions=3):
    frame = spark.createDataFrame([(i, t, 99) for i, t in enumerate(texts)], "seq long, content string, hits long").repartition(partitions)
    r = dedup.dedup(frame.withColumn("content_hash", content_hash(F.col("content"))), threshold)
    rows = {x.seq: x.hits for x in r.survivors.collect()}
    folds = r.folds.collect()
    assert len(folds) == r.exact_dropped + r.fuzzy_dropped == len(texts) - len(rows)
    return rows


@pytest.mark.parametrize("threshold", [-0.1, 0.0, 0.3, 0.5, 0.85, 1.0])
def test_random_sets_equal_the_model(spark, threshold):
    rng = random.Random(int(threshold * 100) + 7)
    words = [f"w{k}" for k in range(14)]
    texts = [" ".join(rng.sample(words, rng.randrange(0, 9))) + rng.choice(["", "!", " ?"]) for _ in range(90)]
    assert folded(spark, texts, threshold) == model(texts, threshold)


def test_long_chain(spark):
    base = [f"t{k}" for k in range(40)]
    texts = [" ".join(base[k : k + 20]) for k in range(15)]
    assert folded(spark, texts, 0.85) == model(texts, 0.85)


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    assert folded(spark, texts, 0.6, 1) == folded(spark, texts, 0.6, 11)


CASES = {
    "three copies": (["hello world"] * 3, 0.85, {0: 3}),
    "case and punctuation": (["How do I parse JSON in Rust?", "how do i parse json in rust", "An unrelated question"], 0.85, {0: 2, 2: 1}),
    "overlap kept": (["the quick brown fox", "the quick brown dog"], 0.85, {0: 1, 1: 1}),
    "overlap folded": (["the quick brown fox", "the quick brown dog"], 0.3, {0: 2}),
    "disjoint": (["alpha beta", "gamma delta"], 0.85, {0: 1, 1: 1}),
    "chain keeps both ends": (["a b c d", "a b c e", "a b e f"], 0.5, {0: 2, 2: 1}),
    "copies of a folded row are not counted": (["a b c d e f g", "A b c d e f g", "A b c d e f g", "A b c d e f g"], 0.85, {0: 2}),
    "no tokens": (["!!!", "???", "..."], 0.85, {0: 3}),
    "no tokens, threshold 1": (["!!!", "???"], 1.0, {0: 1, 1: 1}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    texts, threshold, expected = CASES[name]
    assert model(texts, threshold) == expected
    assert folded(spark, texts, threshold) == expected


def test_resolve_on_random_graphs(spark):
    rng = random.Random(11)
    for _ in range(3):
        n = 25
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.12]
        kept, keeper = [], {}
        for j in range(n):
            before = [i for i in kept if (i, j) in edges]
            if before:
                keeper[j] = min(before)
            else:
                kept.append(j)
        assert dict(map(tuple, dedup.resolve(spark.createDataFrame(edges, "i long, j long")).collect())) == keeper


def test_empty_table(spark):
    frame = spark.createDataFrame([], "seq long, content string, hits long, content_hash decimal(20,0)")
    r = dedup.dedup(frame, 0.85)
    assert (r.survivors.count(), r.exact_dropped, r.fuzzy_dropped) == (0, 0, 0)

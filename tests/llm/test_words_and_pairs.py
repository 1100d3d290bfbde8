"""Near-duplicates, line dedup and the pieces they share, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import linededup, neardup, words
from colloquy.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size=4, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is None or j is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}


def planted(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for base in range(n // 6):
        words_ = rng.choices(vocabulary, k=rng.choice([5, 40, 90]))
        for copy in range(6):
            w = list(words_)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + (f" {passage}" if base % 3 == 0 else "")))
    return rows


def test_word_splitting_follows_the_contract():
    texts = ["A b\tC", "", None, "\x0b\x0c x\r\ny ", "ÄB é\xa0z", "one"]
    found = list(words.slices(pa.array(texts), 3))
    hashes = np.concatenate([p.hashes for p in found])
    expected = [w for t in texts for w in (t or "").encode().split()]
    assert [int(h) for h in hashes] == [int(words.hash_word(w.lower())) for w in expected]
    assert sum(len(p.bounds) - 1 for p in found) == len(texts)


def test_signature_estimates_resemblance():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    s = neardup.circulant_signature(np.concatenate([a, b]), np.array([0, len(a)]), 1024)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.6) < 0.05


@pytest.mark.parametrize("seed,bucket_pairs", [(1, 10**6), (2, 0), (3, 3)])
def test_components_equal_brute_force(spark, seed, bucket_pairs):
    rows = planted(seed)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4, bucket_pairs=bucket_pairs).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingle_set(t, 4)) for i, t in rows}


def test_near_duplicate_edge_cases(spark):
    long_text = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (4, "a b", "x"), (5, "A  B", "x"), (None, "a b", "x"), (6, "a b c", "x"), (7, long_text, "x"), (8, long_text + " tail", "x"), (7, long_text, "x"), (9, "q r s t u", "x"), (9, "a b", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("component_id", F.lit("clash"))
    found = neardup.near_duplicates(frame, size=4).collect()
    assert len(found) == len(rows)
    component = {r.doc_id: r.component_id for r in found}
    assert component == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 6: 6, 7: 7, 8: 7, 9: 4}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)
    assert neardup.near_duplicates(frame.limit(0)).collect() == []


def test_connected_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (1, 0)]
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}


def brute_lines(rows, ratio, least, copies_once):
    hosts = {}
    for _, host, text in rows:
        hosts.setdefault(host, []).append(text or "")
    boiler = {}
    for host, texts in hosts.items():
        pages = list(set(texts)) if copies_once else texts
        count = {}
        for t in pages:
            for line in {x for x in t.split("\n") if x.strip(" ")}:
                count[line] = count.get(line, 0) + 1
        boiler[host] = {x for x, n in count.items() if n >= least and n > ratio * len(pages)}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x not in boiler[h])) for i, h, t in rows]


@pytest.mark.parametrize("copies_once", [False, True])
@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_line_dedup_equals_brute_force(spark, copies_once, broadcast, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", broadcast)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [rng.choice(["menu", "footer", "", " "]) for _ in range(rng.randrange(3))] + [f"line {rng.randrange(300)}" for _ in range(rng.randrange(4))]
        rows.append((i, host, rng.choice(["\n".join(lines), "\n".join(lines), "same page\nmenu"]) if i % 17 else None))
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit(1))
    found = linededup.drop_boilerplate(frame, F.col("source"), ratio=0.2, least_pages=5, copies_once=copies_once)
    assert found.columns == ["doc_id", "source", "text", "host", "__lines", "__dropped"]
    assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted(brute_lines(rows, 0.2, 5, copies_once))
    assert linededup.drop_boilerplate(frame.limit(0), F.col("source")).collect() == []


def test_line_dedup_runs_no_python(spark):
    frame = spark.createDataFrame([(1, "a", "x\ny")], "doc_id long, source string, text string")
    plan = linededup.drop_boilerplate(frame, F.col("source"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, "h", f"menu\npage {i}", "a", "b", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, __host string, __drop string, __lines int")
    out = linededup.drop_boilerplate(frame, F.col("source"))
    assert out.columns == ["doc_id", "source", "text", "__host", "__drop", "__lines", "__dropped"]
    found = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert found == {i: ("h", f"page {i}", "a", "b", 2, 1) for i in range(20)}

"""Toxicity, personal data, exact top-k, language model and the pipeline, against brute force."""

from __future__ import annotations

import json
import math
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import maxent, pii, shared, topk, toxicity
from colloquy.llm import words as W

# ---------------------------------------------------------------- toxicity

STEMS = ("vorlax", "grimst", "pelnu")


def labelled(n=900, seed=8):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(1, 120)))
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(0, len(words) + 1), rng.choice(STEMS) + rng.choice(["", "en", "ita", "os", "ura"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def auc(score, label):
    score, label = np.array(score), np.array(label)
    a, b = score[label == 1][:, None], score[label == 0][None, :]
    return ((a > b).mean() + (a == b).mean() / 2).item()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in found.items() if r.held_out) == sorted(held)
    assert auc([found[i].score for i in held], [truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = labelled(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (sorted(toxicity.score(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_edge_cases(spark):
    docs, labels = labelled(300)
    odd = [(None, "x y"), (9001, None), (9002, ""), (9002, ""), (9003, "word " * 50_000), (9004, "z" * 100_000)]
    found = toxicity.score(spark.createDataFrame(docs + odd, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (9001, None), (0, 0)], "doc_id long, toxic int")).collect()
    assert len(found) == 306 and all(r.score is not None for r in found)
    none = toxicity.score(spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_toxicity_splits_alike(spark):
    docs, labels = labelled()
    plain = "aeio ulnr " * 60
    runs = {
        9102: (plain + "vorlaxen grimstos").replace(" ", "\u00a0"),
        9103: plain + "VORLAXEN grimstos",
        9104: (plain + "vorlaxen grimstos").replace(" ", "\u3000"),
    }
    d = spark.createDataFrame(docs + list(runs.items()), "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert found[9102] == found[9103] == found[9104] > 0.5


def test_toxicity_learns_whole_runs():
    batch = pa.record_batch([pa.array(["x" * 300 + "QYZ"]), pa.array([1]), pa.array([0])], ["text", "toxic", "fold"])
    grams = {g for b in toxicity._gram_counts(iter([batch])) for g in b.column("gram").to_pylist()}
    assert "xxxqyz" in grams and "xxqyz\n" in grams


def test_evidence_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), n)).encode() for n in (1, 2, 7, 40, 5, 300)]
    grams = sorted({g for w in words for g in toxicity.grams_of(w.decode())})
    keys = np.sort(toxicity.hash_grams(grams))
    model = toxicity.Model(keys, rng.normal(size=len(keys)), *(np.zeros(0, t) for t in (np.uint64, float) * 3))
    whole = toxicity.word_evidence(model, words)
    value = dict(zip(keys.tolist(), model.gram_values, strict=True))
    expected = [sum(value[int(h)] for h in toxicity.hash_grams(list(toxicity.grams_of(w.decode())))) for w in words]
    assert np.allclose(whole, expected)
    monkeypatch.setattr(toxicity, "BLOCK_SYMBOLS", 11)
    assert np.allclose(toxicity.word_evidence(model, words), expected)


class Brute:
    """Both class models by recursion, from (toxic, ordinary) counts of n-grams and of word pairs."""

    def __init__(self, counts, pairs=()):
        self.counts, self.pairs = counts, dict(pairs)
        self.levels = [Counter() for _ in range(toxicity.ORDER + 1)]
        for g, n in counts.items():
            self.levels[len(g)][g] += sum(n)
        for k in range(toxicity.ORDER, 1, -1):
            for g in self.levels[k]:
                self.levels[k - 1][g[1:]] += 1
        self.total, self.kinds = Counter(), Counter()
        for level in self.levels:
            for g, n in level.items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]] += 1
        self.symbols = sorted(self.levels[1])
        self.sums, self.own = (Counter(), Counter()), (Counter(), Counter())
        for h, n in [(g[:-1], n) for g, n in counts.items()] + [((v,), n) for (v, _), n in self.pairs.items()]:
            for c in (0, 1):
                self.sums[c][h] += n[c]
                self.own[c][h] += n[c] > 0

    def shared(self, g):
        h = g[:-1]
        below = self.shared(g[1:]) if h else 1 / (len(self.symbols) + 1)
        if not self.total[h]:
            return below
        return (max(self.levels[len(g)][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * self.kinds[h] * below) / self.total[h]

    def mixed(self, c, h, n, below):
        if not self.sums[c][h]:
            return below
        return (max(n - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * self.own[c][h] * below) / self.sums[c][h]

    def symbol(self, c, g):
        return self.mixed(c, g[:-1], self.counts.get(g, (0, 0))[c], self.shared(g))

    def word(self, c, w):
        return math.prod(self.symbol(c, g) for g in toxicity.grams_of(w))

    def pair(self, c, v, w):
        after = [n for (a, _), n in self.pairs.items() if a == v]
        n = self.pairs.get((v, w), (0, 0))
        below = self.word(c, w)
        if after:
            below = (max(sum(n) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * below) / sum(map(sum, after))
        return self.mixed(c, (v,), n[c], below)


def counted(texts):
    """n-gram and pair counts of (words, class) texts."""
    grams, pairs = {}, {}
    for words, c in texts:
        for v, w in zip([None, *words], words):
            pairs.setdefault((v, w), [0, 0])[c] += 1
            for g in toxicity.grams_of(w):
                grams.setdefault(g, [0, 0])[c] += 1
    return grams, pairs


def sampled(texts):
    grams, pairs = counted(texts)
    names = sorted({w for _, w in pairs})
    hashed = {w: W.hash_word(w.encode()) for w in names} | {None: toxicity._BEGIN}
    order = np.argsort([hashed[w] for w in names])
    table = lambda counts, more=0: list(np.array([(t, 0, o, 0) for t, o in counts.values()] + [(0,) * 4] * more, np.float64).T)
    return toxicity.Sample(
        pa.array([*grams, "\nzz", "zzzzzz"]), table(grams, 2), np.array([hashed[v] for v, _ in pairs], np.uint64), np.array([hashed[w] for _, w in pairs], np.uint64), table(pairs),
        np.array([hashed[names[i]] for i in order], np.uint64), [names[i] for i in order],
    )


def small_corpus():
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcé🙂"), rng.integers(1, 9))) for _ in range(60)]
    return [(list(rng.choice(vocabulary[20 * int(rng.integers(0, 2)) :][:45], rng.integers(1, 12))), int(i % 3 > 0)) for i in range(120)]


def test_toxicity_estimates_equal_brute_force():
    texts = small_corpus()
    brute = Brute(*counted(texts))
    sample = sampled(texts)
    grams = toxicity.train_grams(sample.grams, sample.gram_counts[0], sample.gram_counts[2])
    found = dict(zip(grams.keys.tolist(), grams.logs.T, strict=True))
    assert len(found) == len(brute.counts)
    for g, h in zip(brute.counts, toxicity.hash_grams(list(brute.counts)).tolist(), strict=True):
        assert np.allclose(found[h], [math.log(brute.symbol(c, g)) for c in (0, 1)], atol=1e-9)
    back = dict(zip(grams.context_keys.tolist(), grams.context_values, strict=True))
    contexts = {g[:-1] for g in brute.counts}
    assert len(back) == len(contexts)
    logs = toxicity.word_logs(grams, sample.texts)
    assert np.allclose(logs, [[math.log(brute.word(c, w)) for w in sample.texts] for c in (0, 1)], atol=1e-9)


def test_toxicity_log_likelihoods_equal_brute_force():
    texts = small_corpus()
    brute = Brute(*counted(texts))
    model = toxicity.train(sampled(texts), (0,))
    docs = [texts[0][0], texts[1][0][::-1], ["abc", "new", texts[2][0][0], "ééé", "new", "abc"], ["zzzzzzzzz"], [("".join(texts[3][0]) * 300)[:230], "a"], []]  # runs of more than 200 symbols too
    column = pa.array([" ".join(d) for d in docs])
    at = 0
    for part in toxicity.words_of(column):
        raw = part.data.tobytes()
        value = toxicity.word_evidence(model, [raw[a:b] for a, b in zip(part.starts, part.ends, strict=True)])
        pairs = toxicity.pair_evidence(model, part, value)
        for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True):
            words = docs[at]
            at += 1
            own = [math.log(brute.word(0, w) / brute.word(1, w)) for w in words]
            both = [math.log(brute.pair(0, v, w) / brute.pair(1, v, w)) for v, w in zip([None, *words], words)]
            assert np.allclose(value[a:b], own, atol=1e-9) and np.allclose(pairs[a:b], both, atol=1e-5)
    assert at == len(docs)


def test_toxicity_probabilities_sum_to_one():
    texts = small_corpus()
    brute = Brute(*counted(texts))
    alphabet = brute.symbols
    for c in (0, 1):
        for h in ["", "\n", "a", "\na", "bc", "\nzz", "aab", *sorted({g[:-1] for g in brute.counts})[::40]]:
            unseen = brute.symbol(c, h[-toxicity.ORDER + 1 :] + "?")  # all symbols never seen share one place
            assert abs(sum(brute.symbol(c, h[-toxicity.ORDER + 1 :] + s) for s in alphabet) + unseen - 1) < 1e-9
        words = sorted({w for _, w in brute.pairs})
        for v in [None, *words[::9], "never"]:
            rest = 1 - sum(brute.word(c, w) for w in words)  # what words outside the vocabulary have
            seen = sum(brute.pair(c, v, w) for w in words)
            left = brute.pair(c, v, "abcabcab") / brute.word(c, "abcabcab")
            assert abs(seen + left * rest - 1) < 1e-9


def test_toxicity_sees_expressions_of_ordinary_words(spark):
    """Two words that only together mark a text as toxic."""
    rng = np.random.default_rng(12)
    pool = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(80)]
    docs, labels = [], []
    for i in range(1200):
        words = list(rng.choice(pool, 40))
        toxic = int(i % 4 == 0)
        for _ in range(3):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = ["crag", "bole"] if toxic else ["bole", "crag"]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in docs if found[i].held_out]
    assert auc([found[i].score for i in held], [labels[i][1] for i in held]) > 0.97


def test_toxicity_replaces_a_clashing_column(spark):
    docs, labels = labelled(120)
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, __toxicity string")
    out = toxicity.with_score(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == ["doc_id", "text", "__toxicity"] and out.where("__toxicity between 0 and 1").count() == 120


def test_toxicity_keeps_rare_grams(spark):
    rng = np.random.default_rng(7)
    docs = [(i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1200))) for i in range(500)]
    grams = {g for i, t in docs if zlib.crc32(str(i).encode()) % 5 for g in toxicity.grams_of(t)}
    assert len(grams) > 400_000
    model, _ = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 3 == 0) for i, _ in docs], "doc_id long, toxic boolean"))
    assert len(model.gram_keys) == len(grams)


# ----------------------------------------------------------- personal data


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind in ("email", "ip", "card", "phone"):
        for m in re.finditer(pii.PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII_TEXTS = [
    "mail a.b@c.de, and x%y@q-z.com.uk%d@e.f! @ @@ a@b a@b. c@d..e 🙂z@y.xx",
    "1.2.3.4 256.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8 9.9.9 12345.1.1.1 1.1.1.0300",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 12 4111111111111111 5 x4111 1111 1111 1111y",
    "+1 (988) 555-2485 +49.30.123456789 +1 +12 +123456789 +1 2 3 ( +99999999999999999999",
    "", None, "é" * 30 + "a@b.co" + "ñ" * 5, "1" * 40_000 + " a@b.cd", "a" * 40_000 + "@b.cd", ". " * 20_000 + "+1 (988) 555-2485",
    "4222222222222 0000000000000 6011000990139424 378282246310005 0" + " 0" * 30,
]


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = PII_TEXTS + ["".join(rng.choice(list("0123456789.+-@ ()ab%_é\n"), 60)) for _ in range(600)]
    texts += [f"{rng.integers(0, 300)}.{rng.integers(0, 300)}.{rng.integers(0, 300)}.{rng.integers(0, 300)}" for _ in range(50)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    names = {k.name for k in pii.BASE}
    for r in pii.find(frame).collect():
        found = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in names]
        assert found == brute_spans(texts[r.doc_id] or ""), texts[r.doc_id]
    assert pii.find(frame.limit(0)).collect() == []


def test_checksums_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "code GB83 WEST 1234 5698 7654 32.", "DE89370400440532013000 konto", "please call 030 1234 5678 now", "ratio 030 1234 5678 now"]
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: ["iban"], 1: [], 2: ["iban"], 3: ["local_phone"], 4: []}


def test_account_numbers_before_capitals_and_digits(spark):
    de, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    cases = [
        (f"IBAN {de} BIC COBADEFFXXX", [de]),
        (f"{de} Bank", [de]),
        (f"{gb} BIC: X", [gb]),
        (f"{de} I am", [de]),
        (f"🙂é {spaced} 2 days", [spaced]),
        (f"{de} {gb} AND {spaced} THEN 1234 5678 9012 3456 7890", [de, gb, spaced]),
        (f"PART AB12 {de}", [de]),
        (f"AB12 {spaced}", [spaced]),
        (f"NO9386011117947 OSLO {de}.", ["NO9386011117947", de]),
        (f"{de}A {de}a x{de} {de[:-1]}1 BIC", []),
        ("MT84MALT011000012345MTLCAST001S MALTA", ["MT84MALT011000012345MTLCAST001S"]),
    ]
    rows = pii.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    found = {r.doc_id: [cases[r.doc_id][0][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in rows}
    assert found == {i: e for i, (_, e) in enumerate(cases)}
    out = pii.redact(spark.createDataFrame([(f"to {de} BIC COBADEFFXXX",)], "text string"))
    assert out.collect()[0][0] == "to [IBAN] BIC COBADEFFXXX"


def test_redaction_and_native_plan(spark):
    rows = [(1, "a a@b.co b 1.2.3.4", 7), (2, None, 7), (3, "clean", 7), (4, "+1 (988) 555-2485", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int")
    out = pii.redact(frame)
    assert sorted(map(tuple, out.collect())) == [(1, "a [EMAIL] b [IP]", 7), (2, None, 7), (3, "clean", 7), (4, "[PHONE]", 7)]
    assert out.columns == frame.columns
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_fold_carries_positions_across_blocks_in_linear_time(spark):
    sizes = [0, 1, pii.BLOCK, pii.BLOCK + 1, 2 * pii.BLOCK, 200_000]

    def step(at, x):  # of ranges that begin at x, those that begin after the last one given out
        return F.when(x >= at, x + 1 + x % 2).otherwise(at), x >= at, F.struct(x.alias("x"), F.concat(F.lit("item "), x.cast("string")).alias("s"))

    frame = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", F.when(F.col("n") > 0, F.sequence(F.lit(1), "n")).otherwise(F.array().cast("array<int>")).alias("xs"))
    began = time.perf_counter()
    found = {r.n: (r.f.at, [tuple(o) for o in r.f.out]) for r in frame.select("n", pii._fold(F.col("xs"), "struct<x:int,s:string>", step).alias("f")).collect()}
    took = time.perf_counter() - began
    for n in sizes:
        at, out = 0, []
        for x in range(1, n + 1):
            if x >= at:
                at = x + 1 + x % 2
                out.append((x, f"item {x}"))
        assert found[n] == (at, out), n
    assert took < 20


def test_many_spans_in_one_text_cost_linear_time(spark):
    text = "é🙂 " + "".join(f"u{k}@ex.org {k % 250}.1.1.1 DE89370400440532013000 ? " for k in range(2_000)) + "tail"
    many = "".join(f"name{k}@example.org " for k in range(100_000))
    frame = spark.createDataFrame([(1, text), (2, many)], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.spans for r in pii.find(frame.where("doc_id = 1")).collect()}[1]
    base = [f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind != "iban"]
    assert base == brute_spans(text) and all(text[s.start : s.end] == "DE89370400440532013000" for s in found if s.kind == "iban")
    assert len(found) == 6_000
    redacted = pii.redact(frame.where("doc_id = 1")).collect()[0].text
    assert redacted == "é🙂 " + "[EMAIL] [IP] [IBAN] ? " * 2_000 + "tail"
    began = time.perf_counter()
    assert pii.redact(frame.where("doc_id = 2")).collect()[0].text == "[EMAIL] " * 100_000
    assert time.perf_counter() - began < 20


def test_personal_data_keeps_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a@b.co", "kept", 5)], "doc_id long, text string, __pii string, __PII_ int")
    out = pii.redact(frame)
    assert out.columns == frame.columns and [tuple(r) for r in out.collect()] == [(1, "[EMAIL]", "kept", 5)]


# -------------------------------------------------------------- exact top-k


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 9), st.integers(0, 10**6))
def test_index_is_exact(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(-spread, spread + 1, (n, dims)), rng.permutation(3 * n)[:n]
    index = topk.ImpactIndex(ids, x, levels=4)
    for i in range(min(n, 5)):
        s = x @ x[i]
        expected = sorted(((-int(a), int(b)) for a, b in zip(s, ids, strict=True) if b != ids[i]))[:5]
        assert index.search(x[i], i, 5) == [(-a, b) for a, b in expected]


@pytest.mark.parametrize("block", [100, 10**6])
def test_top_k_query(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (500, 8))
    x[100:300] = x[100]  # one vector many times: ties
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    bad = [(1000, None, ""), (1050, [1.0, None], ""), (1100, [math.nan] * 8, ""), (1150, [math.inf] * 8, ""), (None, [1.0] * 8, "")]
    more = [(7, [9.0] * 8, ""), (7, [9.0] * 8, ""), (50, [2.0, -1.0], ""), (50, [float(v) for v in x[50]], "")]  # ids that repeat, queries among them
    found = topk.exact_top_k(spark.createDataFrame(rows + bad + more, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 50 == 0).collect()
    table = [(i, np.floor(256 * np.float32(v + [0.0] * (8 - len(v))).astype(np.float64)).astype(np.int64)) for i, v, _ in rows + more]
    expected = []
    for at, (i, q) in enumerate(table):
        if i % 50 == 0:
            best = sorted((-int(v @ q), j) for other, (j, v) in enumerate(table) if other != at)[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.exact_top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    found = topk.exact_top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2 * 256 * 256)]


# ---------------------------------------------------------- language model


def lm_docs():
    rng = np.random.default_rng(9)
    langs = [["".join(rng.choice(list(letters), rng.integers(2, 6))) + end for _ in range(120)] for letters, end in (("abcdef", "ing"), ("ghijkl", "eau"), ("mnopqr", "ung"))]
    docs = [(i, " ".join(rng.choice(langs[i % 3], rng.integers(0, 60))).capitalize()) for i in range(600)]
    return docs + [(700, None), (701, ""), (701, ""), (None, "Anything else"), (702, "novel words only here"), (703, "long " * 30_000)]


@pytest.mark.parametrize("head", [10**6, 20])
def test_language_model_base_equals_brute_force(spark, head):
    docs = lm_docs()
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string")
    found = maxent.score(frame, head=head).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t in docs if i is not None and not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = [(i, held(i), len(tokens(t)), sum(x in c for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in docs]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str) == sorted(expected, key=str)
    out = [r for r in found if r.held_out and r.doc_id < 700]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95  # less negative


def test_language_model_edge_tables(spark):
    assert maxent.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = maxent.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row] == [(only, True, 3, 0, 0, 0.0, 0.0)]


def toy_model(k=5, hashes=64, seed=1):
    rng = np.random.default_rng(seed)
    classes = maxent.numbered(np.concatenate((rng.integers(0, k, maxent.ENDINGS), [k, k])))
    outer = rng.normal(size=(maxent.offsets(hashes)[-1], k + 1)).astype(np.float32)
    inner = rng.normal(size=(maxent._INNER[-1], maxent.ENDINGS + 1)).astype(np.float32)
    return maxent.Model(classes, hashes, maxent.Weights(outer, inner), np.zeros(maxent.ENDINGS + 2), np.zeros(1, np.uint64), np.zeros(1))


def toy_stream():
    column = pa.array(["one two three two one", "", "alpha", "two one two, three! four five", None])
    (part,) = W.slices(column)
    return maxent.stream(part)


def brute_ending(m, f, g, i):
    """{ending: probability} of token i by definition."""
    z = [sum(float(m.weights.outer[row[i], c]) for row in f) for c in range(m.weights.outer.shape[1])]
    total = sum(map(math.exp, z))
    out = {}
    for c in range(len(z)):
        members = [b for b in range(maxent.ENDINGS + 1) if m.classes.of[b] == c]
        y = {b: math.exp(sum(float(m.weights.inner[row[i], m.classes.place[b]]) for row in g)) for b in members}
        out |= {b: math.exp(z[c]) / total * v / sum(y.values()) for b, v in y.items()}
    return out


def test_language_model_factors_equal_brute_force():
    m, s = toy_model(), toy_stream()
    f, g = maxent.features(s, m.hashes)
    logs = maxent.history_logs(m, s)
    for i, b in enumerate(s.buckets):
        p = brute_ending(m, f, g, i)
        assert len(p) == maxent.ENDINGS + 1 and abs(sum(p.values()) - 1) < 1e-9
        assert abs(logs[i] - math.log10(p[int(b)])) < 1e-4


def test_language_model_gradient_equals_brute_force():
    m, s = toy_model(), toy_stream()
    f, g = maxent.features(s, m.hashes)
    outer, inner = np.zeros(m.weights.outer.shape), np.zeros(m.weights.inner.shape)
    for i, b in enumerate(s.buckets.tolist()):
        p = brute_ending(m, f, g, i)
        c = m.classes.of[b]
        own = sum(v for e, v in p.items() if m.classes.of[e] == c)
        for e, v in p.items():
            for row in f:
                outer[row[i], m.classes.of[e]] -= v
            if m.classes.of[e] == c:
                for row in g:
                    inner[row[i], m.classes.place[e]] -= v / own
        for row in f:
            outer[row[i], c] += 1
        for row in g:
            inner[row[i], m.classes.place[b]] += 1
    sums = maxent.Weights(*(np.zeros(w.shape[::-1]) for w in m.weights))
    maxent.add_gradients(m.weights, f, g, m.classes, s.buckets, m.hashes, sums)
    assert np.allclose(sums.outer.T, outer, atol=1e-4) and np.allclose(sums.inner.T, inner, atol=1e-4)
    w, squares = m.weights.outer.copy(), np.ones(m.weights.outer.shape, np.float32)
    maxent.step(w, sums.outer, squares)
    assert np.allclose(w, m.weights.outer + maxent.RATE * outer / np.sqrt(1 + outer**2 + maxent.DAMPING), atol=1e-4) and not sums.outer.any()


def test_language_model_does_not_depend_on_chunks(monkeypatch):
    m, s = toy_model(), toy_stream()
    f, g = maxent.features(s, m.hashes)

    def found():
        sums = maxent.Weights(*(np.zeros(w.shape[::-1]) for w in m.weights))
        maxent.add_gradients(m.weights, f, g, m.classes, s.buckets, m.hashes, sums)
        return *sums, maxent.history_logs(m, s)

    whole = found()
    monkeypatch.setattr(maxent, "CHUNK", 3)
    assert len(s.tokens) > 6 and [len(p) for _, p in maxent.probabilities(m.weights.outer, f)][:2] == [3, 3]
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, found(), strict=True))


def test_language_model_counts_a_tokens_rows_together(monkeypatch):
    """A token has one row for many batches and slices, and none is lost where they are handed on earlier."""
    texts = [["one two two", None, "three one"], ["two"], [], ["", "four Two one"]]
    batches = [pa.record_batch([pa.array(t, pa.string())], ["text"]) for t in texts]
    expected = Counter(int(W.hash_word(w.encode())) for t in texts for x in t for w in (x or "").lower().split()) + Counter({int(maxent.END): 6})

    def found():
        rows = [r for b in maxent._token_counts(iter(batches)) for r in b.to_pylist() if r["kind"] == 0]
        total = Counter()
        for r in rows:
            total[r["key"] % 2**64] += r["n"]
        assert total == expected
        return len(rows)

    assert found() == len(expected)
    monkeypatch.setattr(maxent, "COUNT_TOKENS", 1)
    assert found() > len(expected)


def test_language_model_weights_are_averaged_by_feature(spark):
    m = toy_model()
    k = m.weights.outer.shape[1]
    rows = [(0, 3, 2, [2.0 * 2] * k), (0, 3, 6, [4.0 * 6] * k), (0, 5, 1, [7.0] * k), (1, 3, 4, [1.0 * 4] * (maxent.ENDINGS + 1))]
    out = maxent.mixed(spark.createDataFrame(rows * 3, "kind int, feature long, seen long, values array<float>").repartition(5), m.weights)
    expected = [m.weights.outer.copy(), m.weights.inner.copy()]
    expected[0][3], expected[0][5], expected[1][3] = 3.5, 7.0, 1.0
    assert all(np.allclose(a, b) for a, b in zip(out, expected, strict=True))


def test_language_model_untrained_score_equals_brute_force(spark):
    """Without rounds a token's probability is its ending's share times its own share of the ending."""
    docs = [(i, t) for i, t in lm_docs() if i is not None and i < 703]
    found = {r.doc_id: r for r in maxent.score(spark.createDataFrame([d for d in docs if d[0] != 701], "doc_id long, text string"), rounds=0).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]

    def ending(w):
        if w is None:
            return maxent.ENDINGS
        return int(maxent.endings(W.split(np.frombuffer(w, np.uint8), np.array([0, len(w)])))[0])

    c = Counter(x for i, t in docs if i != 701 and zlib.crc32(str(i).encode()) % 7 != 2 for x in tokens(t))
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[ending(w)] += k
        v[ending(w)] += 1
    every = sum(n[b] + 0.5 for b in range(maxent.ENDINGS + 1))
    for i, t in docs[::20]:
        expected = sum(math.log10((n[ending(w)] + 0.5) / every * (c[w] + 1) / (n[ending(w)] + v[ending(w)] + 1)) for w in tokens(t))
        assert abs(found[i].score - expected) < 1e-3 * max(1, abs(expected))


def test_language_model_learns_with_each_round(spark):
    frame = spark.createDataFrame(lm_docs(), "doc_id long, text string")
    scores = [frame.sparkSession.createDataFrame(maxent.score(frame, rounds=n).where("held_out and doc_id < 700").collect()).agg(F.sum("score")).first()[0] for n in (0, 1, 2)]
    assert scores[0] < scores[1] < scores[2]


def small_tables(monkeypatch):
    """Tables of 64 buckets a template, for 352 distinct words: ``lm_docs`` has more."""
    for name, value in (("LEAST_HASHES", 64), ("MOST_HASHES", 64), ("WORDS_PER_HASH", 5.5)):
        monkeypatch.setattr(maxent, name, value)


def test_language_model_hash_space_has_no_upper_bound(spark, monkeypatch):
    """What a small table learns of words that follow each other is little; more blocks of that size learn more."""
    small_tables(monkeypatch)
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(360)]
    after = rng.integers(0, 360, 360)
    docs = []
    for i in range(400):
        w = [int(rng.integers(0, 360))]
        while len(w) < 40:
            w += [int(after[w[-1]]), int(rng.integers(0, 360))]
        docs.append((i, " ".join(words[k] for k in w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = maxent.score(frame, rounds=2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.86 * out[1]  # less negative; one table reaches 0.894


@pytest.mark.parametrize("rounds", [0, 1])
def test_language_model_in_blocks_loses_no_token(spark, monkeypatch, rounds):
    docs = [d for d in lm_docs() if d[0] is None or d[0] < 150 or d[0] >= 700]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = lambda r: sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in r.collect()), key=str)
    whole = maxent.score(frame, rounds=rounds)
    expected, likelihood = rows(whole), {(r.doc_id, r.n_tokens): r.score for r in whole.collect()}
    small_tables(monkeypatch)
    monkeypatch.setattr(maxent, "PIECE", 1000)
    blocks = maxent.score(frame, rounds=rounds)
    assert rows(blocks) == expected
    for r in blocks.collect():
        # untrained, blocks have the same weights as one table
        assert abs(r.score - likelihood[r.doc_id, r.n_tokens]) < (1e-6 if rounds == 0 else 0.2) * max(1, abs(r.score))


def test_language_model_blocks_follow_the_vocabulary():
    assert maxent.sized([(1, 10)]) == (maxent.LEAST_HASHES, 1)
    limit = maxent.WORDS_PER_HASH * maxent.MOST_HASHES
    assert maxent.sized([(7, limit)]) == (maxent.MOST_HASHES, 1)
    assert maxent.sized([(1, 4 * limit)]) == (maxent.MOST_HASHES, 4)
    # words of many occurrences are in all blocks, so more are needed
    assert maxent.sized([(50, limit), (1, limit)])[1] > 4


def test_language_model_dealt_tokens_keep_their_features():
    s, hashes, blocks = toy_stream(), 64, 4
    f, g = maxent.features(s, hashes)
    n = np.diff(s.starts, append=len(s.tokens))
    batch = maxent.deal(s, np.arange(len(n)) + 100, np.arange(len(n)) % 2 == 0, hashes, blocks)
    owner = np.repeat(np.arange(len(n)) + 100, n)
    expected = sorted((int(r), int(b), *map(int, f[:, i]), *map(int, g[:, i])) for i, (r, b) in enumerate(zip(owner, s.buckets, strict=True)))
    found, block_of = [], {}
    for k in range(len(batch)):
        part = batch.slice(k, 1)
        (dealt,) = maxent.dealt_examples(iter([part]), hashes)
        f2, g2, buckets, rows = dealt
        assert all((r % 2 == 0) == part.column("teaches")[0].as_py() for r in rows)
        found += [(int(r), int(b), *map(int, f2[:, i]), *map(int, g2[:, i])) for i, (r, b) in enumerate(zip(rows, buckets, strict=True))]
        for i in range(len(rows)):  # the word before decides the block
            assert block_of.setdefault((int(f2[1, i]), int(g2[2, i])), part.column("block")[0].as_py()) == part.column("block")[0].as_py()
    assert sorted(found) == expected and len(set(block_of.values())) > 1
    (again,) = maxent.dealt_examples(iter([batch]), hashes)
    assert again[0].shape == f.shape


# ----------------------------------------------------------------- pipeline


def test_pipeline_takes_effect_stage_by_stage(spark, tmp_path):
    docs, labels = labelled(600)
    pool = [w for i, t in docs if i % 6 for w in t.split()]
    rng = np.random.default_rng(4)
    copy = list(rng.choice(pool, 200))
    extra = [
        (5000, "lure sole nail\nturn its rest outer a@b.co satin urn"),
        (5001, " ".join(copy)),
        (5002, " ".join(copy) + " tail"),
        (5003, None),
        (5004, ""),
        (5005, "sole nail"),
        (5005, "sole nail"),
    ] + [(6000 + k, f"lure sole nail\nsatin " + " ".join(rng.choice(pool, 20))) for k in range(90)]
    rows = [(i, t, "en", "site", len(t or "")) for i, t in docs + extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        frame = function(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert frame.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    truth = dict(labels)
    gone = {i for i, _ in docs + extra} - set(kept["toxicity"])
    assert len([i for i in gone if truth.get(i) == 1]) > 60 and len([i for i in gone if not truth.get(i)]) < 25
    assert "lure sole" not in kept["line_dedup"][6003] and "lure sole" in kept["toxicity"][6003]
    assert 5001 in kept["near_duplicates"] and 5002 not in kept["near_duplicates"] and 5003 in kept["near_duplicates"]
    assert kept["near_duplicates"][5000].endswith("a@b.co satin urn") and "[EMAIL]" in kept["personal_data"][5000]
    assert frame.where("doc_id = 5005").count() == 1
    packed = corpus_pipeline.pack_sequences(spark, frame, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["personal_data"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again) == key(packed)


def test_near_duplicates_go_by_row_not_by_id(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta theta", "iota kappa lambda mu nu xi omicron pi rho", "sigma tau upsilon phi chi psi omega aleph bet")
    rows = [
        (1, one), (9, one), (9, two), (9, three),  # only the near-duplicate of 1 goes
        (4, three + " gimel dalet he vav"), (7, two), (7, two),  # of equal rows one stays, unless a smaller id has it
        (3, ""), (3, ""), (3, " "), (2, None), (2, None), (5, ""),
        (None, one), (None, one),
    ]
    frame = spark.createDataFrame([(i, t, "en", "site", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()), key=str)
    assert found == sorted([(1, one), (9, three), (4, three + " gimel dalet he vav"), (7, two), (3, ""), (3, " "), (2, None), (5, ""), (None, one), (None, one)], key=str)


COLLECTS = """
import os, sys
from pathlib import Path

import pyspark

root, home = sys.argv[1], Path(sys.argv[1], "home")
home.mkdir()
for p in Path(pyspark.__file__).parent.iterdir():  # executors write to work in Spark's home
    if p.name != "work":
        (home / p.name).symlink_to(p)
os.environ |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": root}
from pyspark.sql import SparkSession

import corpus_pipeline

conf = {"spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.executor.extraJavaOptions": f"-Xlog:gc:file={root}/gc-%p.log"}
spark = SparkSession.builder.master("local-cluster[2,2,512]").config(map=conf).getOrCreate()
docs = spark.createDataFrame([(1, "a 1.2.3.4", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
for name in ("drop_boilerplate_lines", "redact_personal_data"):
    getattr(corpus_pipeline, name)(spark, docs, "")
    print([p.read_text().count("Pause Full (System.gc())") for p in sorted(Path(root).glob("gc-*.log"))])
"""


def test_pipeline_stages_have_every_executor_give_memory_back(tmp_path):
    """Else a later stage's workers come on top of heaps that earlier stages filled."""
    done = subprocess.run([sys.executable, "-c", COLLECTS, str(tmp_path)], capture_output=True, text=True, timeout=180)
    first, second = (json.loads(x) for x in done.stdout.splitlines() if x.startswith("["))
    # executors that start while the session ends have logs of their own
    assert sum(n >= 1 for n in first) >= 2, (first, done.stderr[-2000:])
    assert sum(n >= 2 for n in second) >= 2, second


LINE_DEDUP_COLLECTS = COLLECTS.partition("docs = ")[0] + """
from colloquy.llm import catalog

spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string").write.parquet(f"file://{root}/documents.parquet")
catalog.op1_line_dedup(spark, f"file://{root}")
print([p.read_text().count("Pause Full (System.gc())") for p in sorted(Path(root).glob("gc-*.log"))])
"""


def test_line_dedup_query_has_every_executor_give_memory_back(tmp_path):
    """Else a small input is read with the heaps that a larger one before it filled."""
    done = subprocess.run([sys.executable, "-c", LINE_DEDUP_COLLECTS, str(tmp_path)], capture_output=True, text=True, timeout=180)
    collected = [json.loads(x) for x in done.stdout.splitlines() if x.startswith("[")]
    assert len(collected) == 1, done.stderr[-2000:]
    assert sum(n >= 1 for n in collected[0]) >= 2, collected


def test_driver_gives_freed_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def held() -> float:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024

    jvm.System.gc()
    native = [jvm.java.util.zip.Deflater() for _ in range(600)]  # about 0.25 MB each, none of it in the heap
    full = held()
    for d in native[:-1]:
        d.end()  # the last one keeps the arena from shrinking by itself
    jvm.System.gc()
    freed = held()
    shared.tidy(spark)
    after = held()
    native[-1].end()
    assert after < min(full, freed) - 50, (full, freed, after)

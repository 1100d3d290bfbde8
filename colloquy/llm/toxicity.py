"""Toxicity by class-conditional Kneser-Ney models of words and of word pairs.

Method: a word (a run without Unicode white space, lower-cased, whole, split
in one way in training and in scoring) is modelled symbol by symbol, given up
to ``ORDER - 1`` symbols of the same word; a word after another by their pair,
which backs off to the word's own probability. At both levels the toxic and
the ordinary model discount their own counts and hand the freed mass to one
shared backoff estimated from both, so an expression that is rare, or that
only resembles one seen (an inflected insult), leans on shared counts; all
conditional probabilities sum to one. A text's
evidence is its length-normalised log-likelihood difference by its words, and what pairs
add to it, over the
whole text and over its most toxic stretches of a fixed number of words; a
logistic calibration, fitted on documents whose own counts were held out,
turns it into a score.

The fit uses bounded samples of labelled rows (``MAX_DOCS`` for words,
``MAX_PAIR_DOCS`` of these for pairs, chosen by a hash of the id) and every
n-gram and pair of theirs. Counts are aggregated by Spark, estimates made in
numpy arrays, and workers get hashes and values alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import modest_batches, release, stage, tidy

ORDER = 6
DISCOUNT = 0.75
#: Labelled rows of the fit, and how many of them the pairs are counted in.
MAX_DOCS, MAX_PAIR_DOCS = 20_000, 4_000
#: Words in a stretch whose mean decides how toxic its worst part is.
STRETCHES = (1, 3, 12)
CACHE_ENTRIES = 150_000
SLICE_BYTES = 1 << 19
#: Symbols whose hashes are held at a time.
BLOCK_SYMBOLS = 1 << 15
#: Distinct n-grams after which a task hands on the counts it holds.
FLUSH_GRAMS = 100_000
#: White space as ``str.split`` has it, beyond what separates words in ``words.py``.
_OTHER_SPACE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
FOLDS = ("t0", "t1", "o0", "o1")


#: The word before a text's first.
_BEGIN = np.uint64(0x2545F4914F6CDD1D)


def words_of(column: pa.Array) -> Iterator[W.Words]:
    """Lower-cased words of a string array, some whole documents at a time."""
    for first, some in W.text_slices(column, SLICE_BYTES):
        yield from (part._replace(first=first + part.first) for part in W.slices(pc.replace_substring_regex(pc.utf8_lower(some), _OTHER_SPACE, " "), 2 * SLICE_BYTES))


def before(part: W.Words) -> np.ndarray:
    """The hash of the word before each word."""
    out = np.empty_like(part.hashes)
    out[1:] = part.hashes[:-1]
    first = part.bounds[:-1]
    out[first[first < len(out)]] = _BEGIN
    return out


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def grams_of(word: str) -> Iterator[str]:
    """The n-gram of each symbol of a word and of its end; a line feed marks both ends."""
    s = f"\n{word}\n"
    for i in range(1, len(s)):
        yield s[max(0, i - ORDER + 1) : i + 1]


def _slots(batch: pa.RecordBatch) -> np.ndarray:
    """The place in ``FOLDS`` of each document."""
    return np.where(batch.column("toxic").to_numpy() > 0, 0, 2) + batch.column("fold").to_numpy()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = _slots(batch)
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for part in words_of(batch.column("text")):
            raw = part.data.tobytes()
            slot = np.repeat(slots[part.first : part.first + len(part.bounds) - 1], np.diff(part.bounds))
            for k in np.unique(slot):
                own = np.flatnonzero(slot == k)
                _, at, n = np.unique(part.hashes[own], return_index=True, return_counts=True)
                for a, b, times in zip(part.starts[own[at]].tolist(), part.ends[own[at]].tolist(), n.tolist(), strict=True):
                    for gram in grams_of(raw[a:b].decode()):
                        counts[gram][k] += times
                    if len(counts) > FLUSH_GRAMS:
                        yield _count_batch(counts)
                        counts.clear()
        yield _count_batch(counts)
    release()


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = _slots(batch)
        for part in words_of(batch.column("text")):
            slot = np.repeat(slots[part.first : part.first + len(part.bounds) - 1], np.diff(part.bounds))
            first = before(part)
            _, at, back = np.unique(pair_key(first, part.hashes), return_index=True, return_inverse=True)
            n = np.bincount(4 * back + slot, minlength=4 * len(at)).reshape(-1, 4).astype(np.int32)
            yield pa.record_batch([pa.array(first[at].view(np.int64)), pa.array(part.hashes[at].view(np.int64)), *(pa.array(n[:, k]) for k in range(4))], ["v", "w", *FOLDS])
    release()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words_of(batch.column("text")):
            raw = part.data.tobytes()
            hashes, at = np.unique(part.hashes, return_index=True)
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array([raw[a:b].decode() for a, b in zip(part.starts[at].tolist(), part.ends[at].tolist(), strict=True)], pa.string())], ["w", "word"])
    release()


def _count_batch(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in (zip(*counts.values(), strict=True) if counts else ([],) * 4))], ["gram", *FOLDS])


class Model(NamedTuple):
    """Log-likelihood difference by hashed gram, and by hashed context for grams unseen after it; the same for pairs of words and for the word before."""

    gram_keys: np.ndarray
    gram_values: np.ndarray
    context_keys: np.ndarray
    context_values: np.ndarray
    pair_keys: np.ndarray
    pair_values: np.ndarray
    first_keys: np.ndarray
    first_values: np.ndarray


class _Shared(NamedTuple):
    """N-grams of one length with their shared counts; ``below`` is each one's place, less its first symbol, in the next shorter length."""

    symbols: np.ndarray
    count: np.ndarray
    below: np.ndarray


def _shared(symbols: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Interpolated Kneser-Ney probability of each n-gram's last symbol, by length, estimated from both classes."""
    levels: list[_Shared] = []
    longer, times = np.zeros((0, ORDER), np.uint32), np.zeros(0)
    for k in range(ORDER, 0, -1):
        every = np.concatenate((symbols[k], longer))  # a text's own grams of fewer symbols open a word, the others do not
        count = np.concatenate((counts[k], times))
        _, first, back, n = np.unique(hash_symbols(every[:, 1:]), return_index=True, return_inverse=True, return_counts=True)
        longer, times = every[first, 1:], n.astype(np.float64)  # continuation: contexts, not tokens
        levels.append(_Shared(every, count, back + (len(symbols[k - 1]) if k > 1 else 0)))
    out: list[np.ndarray] = []
    below = np.array([1 / (len(levels[-1].count) + 1)])
    for level in reversed(levels):
        _, context = np.unique(hash_symbols(level.symbols[:, :-1]), return_inverse=True)
        total, kinds = np.bincount(context, level.count), np.bincount(context)
        below = (np.maximum(level.count - DISCOUNT, 0) + DISCOUNT * kinds[context] * below[level.below]) / total[context]
        out.append(below)
    return [np.zeros(0), *(p[: len(symbols[k])] for k, p in enumerate(out, 1))]


def _mass(n: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(a class's count, the mass left for its backoff) of each context; one that it does not know it hands over whole."""
    total, kinds = np.bincount(context, n, contexts), np.bincount(context, n > 0, contexts)
    size = np.where(total > 0, total, 1)
    return size, np.where(total > 0, DISCOUNT * kinds / size, 1.0)


class Grams(NamedTuple):
    """Trained n-grams: hash and both log-probabilities, by hash; ``context_values`` are differences of what contexts leave."""

    keys: np.ndarray
    logs: np.ndarray
    context_keys: np.ndarray
    context_values: np.ndarray


def train_grams(grams: pa.Array, toxic: np.ndarray, ordinary: np.ndarray) -> Grams:
    used = toxic + ordinary > 0
    size = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
    place = [np.flatnonzero(used & (size == k)) for k in range(ORDER + 1)]
    symbols = [_symbols(grams, at, k) for k, at in enumerate(place)]
    shared = _shared(symbols, [toxic[at] + ordinary[at] for at in place])
    # n-grams that only the other fold has are unseen, as they would be in scoring
    keys, logs, contexts, values = [], [], [], []
    for k in range(1, ORDER + 1):
        known, context = np.unique(hash_symbols(symbols[k][:, :-1]), return_inverse=True)
        counts = (toxic[place[k]], ordinary[place[k]])
        left = [_mass(n, context, len(known)) for n in counts]
        own = [np.maximum(n - DISCOUNT, 0) / size[context] + mass[context] * shared[k] for n, (size, mass) in zip(counts, left, strict=True)]
        keys.append(hash_symbols(symbols[k]))
        logs.append(np.log(own))
        contexts.append(known)
        values.append(np.log(left[0][1] / left[1][1]))
    key, log = np.concatenate(keys), np.concatenate(logs, axis=1)
    order = np.argsort(key)
    return Grams(key[order], log[:, order], *_by_key(np.concatenate(contexts), np.concatenate(values)))


def train_pairs(first: np.ndarray, second: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, words: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair keys, values, first words, values) from the pairs' counts and the (2, words) log-probabilities of the sorted ``words``; blocks of pairs at a time."""
    used = np.flatnonzero(toxic + ordinary)
    first, second, toxic, ordinary = first[used], second[used], toxic[used], ordinary[used]
    known, context = np.unique(first, return_inverse=True)
    context = context.astype(np.int32)
    total, kinds = np.bincount(context, toxic) + np.bincount(context, ordinary), np.bincount(context)
    left = [_mass(n, context, len(known)) for n in (toxic, ordinary)]
    value = np.empty(len(first), np.float32)
    for a in range(0, len(first), BLOCK_SYMBOLS):
        at = slice(a, a + BLOCK_SYMBOLS)
        c, word = context[at], np.exp(logs[:, np.searchsorted(words, second[at])])
        shared = (np.maximum(toxic[at] + ordinary[at] - DISCOUNT, 0) + DISCOUNT * kinds[c] * word) / total[c]
        own = [np.maximum(n[at] - DISCOUNT, 0) / size[c] + mass[c] * s for n, (size, mass), s in zip((toxic, ordinary), left, shared, strict=True)]
        value[at] = np.log(own[0] / own[1])
    return *_by_key(pair_key(first, second), value), known, np.log(left[0][1] / left[1][1]).astype(np.float32)


def word_logs(grams: Grams, words: list[str]) -> np.ndarray:
    """(2, words) log-probabilities of words all of whose n-grams are trained."""
    out = np.zeros((2, len(words)))
    for a in range(0, len(words), 20_000):
        text = "\n" + "\n".join(words[a : a + 20_000]) + "\n"
        symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        gram, _ = _hashed(symbols)
        at = np.minimum(np.searchsorted(grams.keys, gram), len(grams.keys) - 1)
        found = np.where(grams.keys[at] == gram, grams.logs[:, at], 0.0)
        out[:, a : a + 20_000] = np.add.reduceat(found, np.flatnonzero(symbols == 10)[:-1], axis=1)
    return out


class Sample(NamedTuple):
    """Counts of the labelled sample, an array for each of ``FOLDS``."""

    grams: pa.Array
    gram_counts: list[np.ndarray]
    first: np.ndarray
    second: np.ndarray
    pair_counts: list[np.ndarray]
    words: np.ndarray
    texts: list[str]


def train(sample: Sample, folds: tuple[int, ...]) -> Model:
    """The model of the documents of some folds."""
    classes = lambda counts: [sum(counts[c + f] for f in folds) for c in (0, 2)]
    grams = train_grams(sample.grams, *classes(sample.gram_counts))
    pairs = train_pairs(sample.first, sample.second, *classes(sample.pair_counts), sample.words, word_logs(grams, sample.texts))
    release()
    return Model(grams.keys, grams.logs[0] - grams.logs[1], grams.context_keys, grams.context_values, *pairs)


def _by_key(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    return key[order], value[order]


def _symbols(grams: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """(n-grams, size) code points of the n-grams at some places, all of one size."""
    raw, offsets = W.string_buffers(grams.take(pa.array(at)))
    text = raw[offsets[0] : offsets[-1]].tobytes().decode()
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), size)


def _step(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix64(before * np.uint64(0x9E3779B97F4A7C15) + symbol + np.uint64(1))


def hash_symbols(symbols: np.ndarray) -> np.ndarray:
    """The hash of each row of code points."""
    h = np.zeros(len(symbols), np.uint64)
    for k in range(symbols.shape[1]):
        h = _step(h, symbols[:, k].astype(np.uint64))
    return h


def hash_grams(grams: list[str]) -> np.ndarray:
    out = np.zeros(len(grams), np.uint64)
    size = np.array([len(g) for g in grams], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = hash_symbols(np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n))
    return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


def word_evidence(model: Model, words: list[bytes]) -> np.ndarray:
    """Log-likelihood difference of each word."""
    if not words:
        return np.zeros(0)
    symbols = np.frombuffer(f"\n{b'\n'.join(words).decode()}\n".encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(symbols == 10)
    value = np.empty(len(symbols) - 1)
    for a in range(1, len(symbols), BLOCK_SYMBOLS):
        b, before = min(a + BLOCK_SYMBOLS, len(symbols)), max(a - ORDER, 0)
        value[a - 1 : b - 1] = _symbol_evidence(model, symbols[before:b].astype(np.uint64))[a - before - 1 :]
    return np.add.reduceat(value, ends[:-1])


def _hashed(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-gram and of the context of each symbol but the first; those that have ``ORDER`` symbols before them, or the mark that opens their word, are exact."""
    mark = symbols == 10
    opens = np.maximum.accumulate(np.where(mark, np.arange(len(symbols)), -ORDER))
    opens = np.concatenate(([0], opens[:-1]))  # the mark that opens the word of each later symbol
    at = np.arange(1, len(symbols))
    depth = np.minimum(np.minimum(at - opens[1:] + 1, at + 1), ORDER)
    # h[k]: hash of the k symbols that end at each place
    h = [np.zeros(len(symbols), np.uint64)]
    for _ in range(ORDER):
        left = np.concatenate((h[-1][:1] * 0, h[-1][:-1]))
        h.append(_step(left, symbols))
    table = np.stack(h)
    return table[depth, at], table[depth - 1, at - 1]


def _symbol_evidence(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Log-likelihood difference of each symbol but the first."""
    gram, context = _hashed(symbols)
    hit, value = _lookup(model.gram_keys, model.gram_values, gram)
    _, default = _lookup(model.context_keys, model.context_values, context)
    return np.where(hit, value, default)


def pair_evidence(model: Model, part: W.Words, evidence: np.ndarray) -> np.ndarray:
    """Log-likelihood difference of each word given the one before, from its own ``evidence``."""
    first = before(part)
    keys, back = np.unique(pair_key(first, part.hashes), return_inverse=True)
    hit, value = _lookup(model.pair_keys, model.pair_values, keys)
    kinds, of = np.unique(first, return_inverse=True)
    _, default = _lookup(model.first_keys, model.first_values, kinds)
    return np.where(hit[back], value[back], evidence + default[of])


def _features(evidence: np.ndarray) -> list[float]:
    """Length-normalised evidence: of the text, and of its worst stretches."""
    n = len(evidence)
    if not n:
        return [0.0] * (1 + len(STRETCHES))
    total = np.concatenate(([0.0], np.cumsum(evidence)))
    out = [float(total[-1] / n)]
    for size in STRETCHES:
        w = min(size, n)
        out.append(float((total[w:] - total[:-w]).max() / size))
    return out


def _evidence_of(model: Model, column: pa.Array, memory: dict[int, float]) -> Iterator[tuple[int, list[list[float]]]]:
    for part in words_of(column):
        hashes, first, back = np.unique(part.hashes, return_index=True, return_inverse=True)
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in memory]
        if len(memory) + len(new) > CACHE_ENTRIES:
            memory.clear()
            new = list(range(len(keys)))
        starts, ends = part.starts[first].tolist(), part.ends[first].tolist()
        raw = part.data.tobytes() if new else b""
        memory.update(zip([keys[i] for i in new], word_evidence(model, [raw[starts[i] : ends[i]] for i in new]).tolist(), strict=True))
        value = np.fromiter(map(memory.__getitem__, keys), np.float64, len(keys))[back]
        pairs = pair_evidence(model, part, value)
        yield part.first, [_features(value[a:b]) + _features(pairs[a:b] - value[a:b]) for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True)]


def _features_under(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[int, float] = {}
        for batch in batches:
            found = [x for _, xs in _evidence_of(model, batch.column("text"), memory) for x in xs]
            yield pa.record_batch([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])
        memory.clear()
        release()

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (the first for the constant), none below zero but the constant: more evidence never lowers a score.

    Newton steps on the penalised likelihood; while a weight is negative, the
    feature with the lowest is left out.
    """
    x = np.column_stack((np.ones(len(x)), x))
    used = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, used], y, ridge)
        low = int(np.argmin(w[1:])) + 1 if len(w) > 1 else 0
        if low and w[low] < 0:
            used.pop(low)
            continue
        out = np.zeros(x.shape[1])
        out[used] = w
        return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _prepared(x: np.ndarray) -> np.ndarray:
    """Features as the calibration sees them: signed square roots tame long tails."""
    return np.sign(x) * np.sqrt(np.abs(x))


def _scores(model: Model | None, weights: np.ndarray | None, column: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[int, float] = {}
        for batch in batches:
            if model is None:
                yield batch.append_column(out, pa.array(np.zeros(len(batch))))
                continue
            for first, found in _evidence_of(model, batch.column(column), memory):
                x = _prepared(np.array(found))
                score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -500, 500)))
                yield batch.slice(first, len(found)).append_column(out, pa.array(score))
        memory.clear()
        release()

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the id's crc32 (of its decimal text) is divisible by ``folds``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int, max_pair_docs: int) -> DataFrame:
    """Staged (text, toxic, fold, pairs) of the labelled rows that words, and that pairs too, are learnt from."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = stage(known.orderBy(*order).limit(max_docs), "chosen")
    for_pairs = chosen.orderBy(*order).limit(max_pair_docs).select("doc_id", F.lit(True).alias("pairs"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")
    rows = source.join(F.broadcast(chosen), "doc_id").join(F.broadcast(for_pairs), "doc_id", "left")  # both bounded by the limits
    return stage(rows.select("text", "toxic", fold.alias("fold"), F.coalesce("pairs", F.lit(False)).alias("pairs")), "sample")


def sample_counts(rows: DataFrame) -> Sample:
    """All n-grams and pairs of the sampled rows."""
    pair_rows, rows = rows.where("pairs").drop("pairs"), rows.drop("pairs")
    sums = [F.sum(c).alias(c) for c in FOLDS]
    grams = rows.mapInArrow(_gram_counts, "gram string, " + ", ".join(f"{c} long" for c in FOLDS)).groupBy("gram").agg(*sums).toArrow()
    gram_counts = [grams[c].to_numpy().astype(np.float64) for c in FOLDS]
    grams = grams["gram"].combine_chunks()
    pairs = pair_rows.mapInArrow(_pair_counts, "v long, w long, " + ", ".join(f"{c} int" for c in FOLDS)).groupBy("v", "w").agg(*(s.cast("int").alias(c) for s, c in zip(sums, FOLDS, strict=True))).toArrow()
    first, second, *pair_counts = (pairs[c].to_numpy() for c in ("v", "w", *FOLDS))
    del pairs
    words = pair_rows.mapInArrow(_vocabulary, "w long, word string").groupBy("w").agg(F.min("word").alias("word")).toArrow()
    hashes = words["w"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    sample = Sample(grams, gram_counts, first.view(np.uint64), second.view(np.uint64), pair_counts, hashes[order], words["word"].take(pa.array(order)).to_pylist())
    del words
    release()
    return sample


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_pair_docs: int = MAX_PAIR_DOCS) -> tuple[Model | None, np.ndarray | None]:
    """(model, calibration weights) from labelled rows that are not held out.

    Rows without a label or an id are not used; several labels of one id count
    as toxic if one is. Without rows of both classes in both folds there is no
    model. Several rows of a sampled id are all used.
    """
    rows = _sampled(docs, labels, id_col, text_col, max_docs, max_pair_docs)
    sample = sample_counts(rows)
    tidy(docs.sparkSession)
    if not all(n.sum() for n in sample.gram_counts):
        return None, None
    features = []
    for f in (0, 1):  # each half under the model of the other
        half = rows.where(F.col("fold") == f).select("toxic", "text")
        features.append(half.mapInArrow(_features_under(train(sample, (1 - f,))), "toxic int, x array<double>").toArrow())
    features = pa.concat_tables(features)
    x = _prepared(np.array(features["x"].to_pylist()))
    weights = fit_logistic(x, (features["toxic"].to_numpy() > 0).astype(float))
    model = train(sample, (0, 1))
    del sample, features, x
    tidy(docs.sparkSession)
    return model, weights


def with_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "__toxicity") -> DataFrame:
    """``docs`` and a score in ``column`` (which replaces one of that name), one row for each input row, without a shuffle.

    A null or empty text has no evidence and gets the calibration's constant.
    Rows with a null id are scored too; where labels give no model every score
    is 0. An empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)
    model, weights = fit(docs, labels, id_col, text_col)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(_scores(model, weights, text_col, column), schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row; see ``with_score``. Other columns are ignored."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = with_score(source, labels.withColumn("doc_id", F.col(id_col)))
    score_ = F.col("__toxicity")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_.alias("score"), (score_ >= 0.5).cast("int").alias("predicted"))

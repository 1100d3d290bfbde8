"""Language-model scores from a hashed maximum-entropy model.

Method: a token's probability is P(class | history) * P(ending | class,
history) * P(token | ending). Classes are groups of word endings that keep
similar company: endings are hashed to buckets and the buckets clustered by
their neighbours, so every word, seen or not, has an ending and a class. Both
factors that depend on the history are softmax models over hashed features of
it: n-grams of the words before and of their endings, and skips over one and
two words for the classes; the word before and its ending for the endings
within a class. The last factor is the smoothed relative frequency.

Every training document takes part in each of the passes:

1. token counts and ending-pair counts;
2. rounds of distributed gradient updates: each task starts from the round's
   weights, makes a gradient step (scaled by the gradients before, as AdaGrad does)
   after every ``STEP_TOKENS`` of its tokens, summed in sparse numpy batches, and hands in its weights; a
   feature's new weights are the mean of the tasks', weighted by how often
   each saw it.

The hash space of a template grows with the counted vocabulary. One table of
weights has at most ``MOST_HASHES`` buckets a template; a larger hash space is
divided into blocks of so many. The word before decides a token's block (so the
model stays a proper one), tokens are dealt to their blocks as feature numbers,
and one block after the other is trained and scored on all its tokens, by as
many tasks as it needs. So neither a worker nor the driver holds more than one
block's weights, and there is no upper bound.

Scoring looks frequent tokens up in a broadcast table of at most ``HEAD``
entries; counts of all other tokens come from a join on the tokens
themselves, so the vocabulary may outgrow any memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import modest_batches, release, shared_root, stage, tidy

#: Hash buckets of a template in a block, about one for ``WORDS_PER_HASH`` distinct tokens; the upper bound (15 bits at most) keeps the weights of a worker below 30 MB, and more tokens make more blocks.
LEAST_HASHES, MOST_HASHES, WORDS_PER_HASH = 1 << 12, 1 << 15, 64
ENDINGS = 256
CLASSES = 24
#: Hash buckets of the word before, in the softmax over endings within a class.
INNER_HASHES = 2048
ROUNDS = 1
#: Step, and what is added to the sum of squared gradients before the root.
RATE, DAMPING = 0.3, 16.0
#: Tokens whose counts are broadcast; the others are joined.
HEAD = 500_000
#: Tokens after which a task makes a step.
STEP_TOKENS = 250_000
SLICE_BYTES = 1 << 20
#: Tokens whose softmax over classes a processor's cache holds.
CHUNK = 1 << 12
#: Tokens that are counted at a time.
COUNT_TOKENS = 1 << 21
#: Tokens of a dealt row, and about half of the most that are trained or scored at a time.
PIECE = 1 << 16
#: Tokens for which a block gets one more training task: each hands in a whole table.
TASK_TOKENS = 3_000_000

END = np.uint64(0x0123456789ABCDEF)
BEFORE = np.uint64(0xFEDCBA9876543210)
_END_BUCKET, _BEFORE_BUCKET = ENDINGS, ENDINGS + 1


def sized(counts: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """(hash buckets of a template in a block, blocks) for pairs (occurrences, number of distinct tokens that occur so often).

    As many blocks, a power of two, as it takes for a block to have no more
    than ``WORDS_PER_HASH`` distinct tokens for each bucket: as many as are
    expected when each occurrence falls into any block alike.
    """
    n, words = np.array(list(counts), float).T
    hashes = 1 << int(np.clip(words.sum() // WORDS_PER_HASH, LEAST_HASHES, MOST_HASHES) - 1).bit_length()
    blocks = 1
    while words @ (1 - (1 - 1 / blocks) ** n) > WORDS_PER_HASH * MOST_HASHES:
        blocks *= 2
    return hashes, blocks


def offsets(hashes: int) -> np.ndarray:
    """Where each template's features begin, and their number: constant, word before, two before, skip one, skip two, ending before, two endings before."""
    return np.cumsum([0, 1, hashes, hashes, hashes, hashes, ENDINGS + 2, hashes])


#: The same for endings within a class: constant, ending before, word before.
_INNER = np.cumsum([0, 1, ENDINGS + 2, INNER_HASHES])
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?)\"'"]] = True


def endings(part: W.Words) -> np.ndarray:
    """The bucket of each word's last three bytes, final punctuation aside."""
    last = part.ends - 1
    trim = _PUNCTUATION[part.data[last]] & (last > part.starts)
    last = last - trim
    h = np.zeros(len(last), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(3):
            at = last - k
            inside = at >= part.starts
            byte = W._LOWER[part.data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1)
            h = h * np.uint64(0x100000001B3) + np.where(inside, byte, 0).astype(np.uint64)
    return (W.mix64(h) % np.uint64(ENDINGS)).astype(np.int64)


class Stream(NamedTuple):
    """Tokens of a slice of documents, an end token after each document's words."""

    tokens: np.ndarray
    buckets: np.ndarray
    starts: np.ndarray


def stream(part: W.Words) -> Stream:
    n_docs = len(part.bounds) - 1
    counts = np.diff(part.bounds)
    starts = part.bounds[:-1] + np.arange(n_docs)
    tokens = np.full(len(part.hashes) + n_docs, END, np.uint64)
    buckets = np.full(len(tokens), _END_BUCKET, np.int64)
    place = np.arange(len(part.hashes)) + np.repeat(np.arange(n_docs), counts)
    tokens[place] = part.hashes
    buckets[place] = endings(part)
    return Stream(tokens, buckets, starts)


def _back(values: np.ndarray, starts: np.ndarray, k: int, pad) -> np.ndarray:
    """Values ``k`` places before, ``pad`` where a document has not begun."""
    out = np.empty_like(values)
    out[:k] = pad
    out[k:] = values[:-k]
    for j in range(k):
        at = starts + j
        out[at[at < len(out)]] = pad
    return out


def features(s: Stream, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(templates, tokens) feature numbers for classes, and for endings."""
    one, two, three = (_back(s.tokens, s.starts, k, BEFORE) for k in (1, 2, 3))
    # a pad set for a short document may reach into the next one: its own starts reset it
    b1, b2 = (_back(s.buckets, s.starts, k, _BEFORE_BUCKET) for k in (1, 2))
    n = np.uint64(hashes)
    with np.errstate(over="ignore"):
        pair = W.mix64(one * np.uint64(3) + two * np.uint64(0x9E3779B97F4A7C15))
        skip = W.mix64(two ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        far = W.mix64(three ^ np.uint64(0x5A5A5A5A5A5A5A5A))
    return _numbered(one % n, pair % n, skip % n, far % n, b1, b2, (one >> np.uint64(20)) % np.uint64(INNER_HASHES), hashes)


def _numbered(one, pair, skip, far, b1, b2, word, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    ends = (b1 * 40_503 + b2 * 9_973) % hashes
    none = np.zeros(len(one), np.int64)
    outer = [none, one, pair, skip, far, b1, ends]
    inner = [none, b1, word]
    stacked = (np.stack([c.astype(np.int64) + o for c, o in zip(cs, at, strict=False)]) for cs, at in ((outer, offsets(hashes)), (inner, _INNER)))
    return next(stacked), next(stacked)


def _examples(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(class features, ending features, buckets) of the texts' tokens, some at a time."""
    for batch in batches:
        for part in W.slices(batch.column("text"), SLICE_BYTES // 2):
            s = stream(part)
            yield *features(s, hashes), s.buckets


_DEALT = "block int, teaches boolean, rows array<long>, times array<long>, examples binary"


def _packed(f: np.ndarray, g: np.ndarray, b2: np.ndarray, own: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """98 bits a token in 8, 4 and 1 bytes: four buckets of 15 bits, three endings of 9, a word's bucket of 11."""
    one, pair, skip, far = ((row - at).astype(np.uint64) << np.uint64(15 * k) for k, (row, at) in enumerate(zip(f[1:5], offsets(hashes)[1:5], strict=True)))
    b1, word = g[1] - _INNER[1], g[2] - _INNER[2]
    first = one | pair | skip | far | ((own & 15).astype(np.uint64) << np.uint64(60))
    return first, (own >> 4 | b1 << 5 | b2 << 14 | (word & 511) << 23).astype(np.uint32), (word >> 9).astype(np.uint8)


def _unpacked(data: pa.Buffer) -> tuple[np.ndarray, ...]:
    """(one, pair, skip, far, ending before, the one before it, word, own ending) of dealt tokens."""
    n = len(data) // 13
    first, second, third = (np.frombuffer(data, t, n, at * n) for t, at in ((np.uint64, 0), (np.uint32, 8), (np.uint8, 12)))
    buckets = [(first >> np.uint64(15 * k) & np.uint64(0x7FFF)).astype(np.int64) for k in range(4)]
    second = second.astype(np.int64)
    return *buckets, second >> 5 & 511, second >> 14 & 511, second >> 23 | third.astype(np.int64) << 9, (first >> np.uint64(60)).astype(np.int64) | (second & 31) << 4


def deal(s: Stream, rows: np.ndarray, teaches: np.ndarray, hashes: int, blocks: int) -> pa.RecordBatch:
    """The tokens of a slice by block: documents (``rows``), how many tokens each has there, and the tokens in 13 bytes each."""
    packed = _packed(*features(s, hashes), _back(s.buckets, s.starts, 2, _BEFORE_BUCKET), s.buckets, hashes)
    owner = np.repeat(np.arange(len(rows)), np.diff(s.starts, append=len(s.tokens)))
    block = (_back(s.tokens, s.starts, 1, BEFORE) >> np.uint64(40)) % np.uint64(blocks)
    group = block.astype(np.int64) * 2 + teaches[owner]
    order = np.argsort(group.astype(np.uint16) if blocks < 1 << 15 else group, kind="stable")  # a radix sort
    groups, cuts = np.unique(group[order], return_index=True)
    found = []
    for k, a, b in zip(groups.tolist(), cuts, np.append(cuts[1:], len(order)), strict=True):
        for at in (order[i : min(i + PIECE, b)] for i in range(a, b, PIECE)):
            own, times = np.unique(owner[at], return_counts=True)
            found.append((k // 2, bool(k % 2), rows[own], times, b"".join(p[at].tobytes() for p in packed)))
    types = (pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["block", "teaches", "rows", "times", "examples"])


def dealt_examples(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``_examples`` yields, of dealt tokens, and the document of each token."""
    waiting, n = [], 0

    def joined():
        *parts, own = (np.concatenate(p) for p in zip(*(_unpacked(data) for data, _ in waiting), strict=True))
        return *_numbered(*parts, hashes), own, np.concatenate([r for _, r in waiting])

    for batch in batches:
        rows, times, examples = (batch.column(c) for c in ("rows", "times", "examples"))
        for k in range(len(batch)):
            waiting.append((examples[k].as_buffer(), np.repeat(rows[k].values.to_numpy(), times[k].values.to_numpy())))
            n += len(waiting[-1][1])
            if n >= PIECE:
                yield joined()
                waiting, n = [], 0
    if waiting:
        yield joined()


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, bucket, n): kind 0 tokens, kind 1 pairs of neighbouring endings."""
    pairs = np.zeros((ENDINGS + 2) ** 2, np.int64)
    waiting, size = [], 0

    def counted():
        tokens, buckets = (np.concatenate(x) for x in zip(*waiting, strict=True))
        keys, first, n = np.unique(tokens, return_index=True, return_counts=True)
        return pa.record_batch([pa.array(np.zeros(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.array(buckets[first]), pa.array(n)], ["kind", "key", "bucket", "n"])

    for batch in batches:
        for part in W.slices(batch.column("text"), SLICE_BYTES // 2):
            s = stream(part)
            before = _back(s.buckets, s.starts, 1, _BEFORE_BUCKET)
            pairs += np.bincount(before * (ENDINGS + 2) + s.buckets, minlength=len(pairs))
            waiting.append((s.tokens, s.buckets.astype(np.int32)))
            size += len(s.tokens)
            if size >= COUNT_TOKENS:
                yield counted()
                waiting, size = [], 0
    if waiting:
        yield counted()
    at = np.flatnonzero(pairs)
    if len(at):
        yield pa.record_batch([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(np.zeros(len(at), np.int32)), pa.array(pairs[at])], ["kind", "key", "bucket", "n"])


def cluster(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 25) -> np.ndarray:
    """The class of each ending bucket (the end token has a class of its own).

    Weighted k-means over square roots of the neighbour distributions on both
    sides, from the heaviest buckets as centres.
    """
    n = ENDINGS
    after, before = pairs[:n].astype(float), pairs[:, :n].T.astype(float)
    mass = pairs[:, :n].sum(axis=0).astype(float)
    x = np.hstack([np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1)) for m in (after, before)])
    centres = [int(np.argmax(mass))]
    while len(centres) < classes:  # far and heavy buckets next
        d = np.min([((x - x[c]) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(int(np.argmax(d * mass)))
    middle = x[centres]
    for _ in range(rounds):
        own = np.argmin((x**2).sum(axis=1)[:, None] - 2 * x @ middle.T + (middle**2).sum(axis=1), axis=1)
        for c in range(classes):
            w = mass * (own == c)
            if w.sum():
                middle[c] = (x * w[:, None]).sum(axis=0) / w.sum()
    return np.concatenate((own, [classes, classes]))


class Classes(NamedTuple):
    """The class of each ending bucket; buckets are renumbered (``place``) so that class c has the columns [bounds[c], bounds[c + 1])."""

    of: np.ndarray
    place: np.ndarray
    bounds: np.ndarray


def numbered(of: np.ndarray) -> Classes:
    _, of = np.unique(of, return_inverse=True)  # classes that clustering left empty are none
    order = np.argsort(of[: ENDINGS + 1], kind="stable")
    place = np.empty(ENDINGS + 1, np.int64)
    place[order] = np.arange(ENDINGS + 1)
    return Classes(of, place, np.searchsorted(of[order], np.arange(int(of.max()) + 2)))


class Weights(NamedTuple):
    """(features, classes) and (inner features, endings)."""

    outer: np.ndarray
    inner: np.ndarray


def softmax(z: np.ndarray) -> np.ndarray:
    """Over rows, in place; exponents are held between -60 and 60."""
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def probabilities(weights: np.ndarray, f: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(tokens, their (tokens, classes) softmax) for ``CHUNK`` tokens at a time, in an array that is used again; the first template is the constant."""
    z = np.empty((min(CHUNK, f.shape[1]), weights.shape[1]), weights.dtype)
    more = np.empty_like(z)
    for a in range(0, f.shape[1], CHUNK):
        rows = f[1:, a : a + CHUNK]
        out, add = z[: rows.shape[1]], more[: rows.shape[1]]
        np.take(weights, rows[0], axis=0, out=out, mode="clip")  # "clip" needs no buffer; no number is out of bounds
        out += weights[0]
        for row in rows[1:]:
            out += np.take(weights, row, axis=0, out=add, mode="clip")
        yield slice(a, a + len(out)), softmax(out)


def within(weights: np.ndarray, f: np.ndarray, classes: Classes, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(tokens, their features but the constant, first column, softmax over the class's endings) for each class of several endings; ``own`` is the tokens' class."""
    order = np.argsort(own.astype(np.uint16), kind="stable")  # a radix sort
    cuts = np.searchsorted(own[order], np.arange(len(classes.bounds)))
    for c, (a, b) in enumerate(zip(classes.bounds[:-1], classes.bounds[1:], strict=True)):
        at = order[cuts[c] : cuts[c + 1]]
        if b - a > 1 and len(at):
            columns, rows = np.ascontiguousarray(weights[:, a:b]), f[1:].take(at, axis=1)
            z = columns.take(rows[0], axis=0)
            z += columns[0]
            for row in rows[1:]:
                z += columns.take(row, axis=0)
            yield at, rows, a, softmax(z)


def _summed(f: np.ndarray, bounds: np.ndarray, columns: np.ndarray, out: np.ndarray) -> None:
    """Takes each token's excess (columns, tokens) from its features' rows of ``out`` (columns, features); ``f`` lacks the constant."""
    out[:, 0] -= columns.sum(axis=1)
    for row, a, b in zip(f, bounds[1:-1], bounds[2:], strict=True):
        at = row - a
        for c, column in enumerate(columns):
            out[c, a:b] -= np.bincount(at, column, b - a)


def add_gradients(weights: Weights, f: np.ndarray, g: np.ndarray, classes: Classes, buckets: np.ndarray, hashes: int, sums: Weights) -> None:
    """Adds observed less expected counts to ``sums``: (classes, features) and (endings, inner features)."""
    own, column = classes.of[buckets], classes.place[buckets]
    excess = np.empty((weights.outer.shape[1], len(own)))
    for tokens, p in probabilities(weights.outer, f):
        excess[:, tokens] = p.T
    excess[own, np.arange(len(own))] -= 1
    _summed(f[1:], offsets(hashes), excess, sums.outer)
    for at, rows, first, p in within(weights.inner, g, classes, own):
        p = np.ascontiguousarray(p.T, np.float64)
        p[column[at] - first, np.arange(len(at))] -= 1
        _summed(rows, _INNER, p, sums.inner[first : first + len(p)])


def step(weights: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
    """A gradient step in place; ``squares`` sums the squared gradients, ``sums`` starts afresh."""
    gradient = np.ascontiguousarray(sums.T, np.float32)
    squares += gradient * gradient
    gradient /= np.sqrt(squares + np.float32(DAMPING))
    weights += np.float32(RATE) * gradient
    sums[:] = 0


def _trained(weights, classes: Classes, hashes: int, examples=_examples):
    """(kind, feature, seen, values): the rows of both tables that a task saw, times how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*(w.copy() for w in weights.value))
        squares = [np.zeros_like(w) for w in own]
        sums = Weights(*(np.zeros(w.shape[::-1]) for w in own))
        seen = [np.zeros(len(w), np.int64) for w in own]
        waiting = 0
        for f, g, buckets, *_ in examples(batches, hashes):
            add_gradients(own, f, g, classes, buckets, hashes, sums)
            for n, rows in zip(seen, (f, g), strict=True):
                n += np.bincount(rows.ravel(), minlength=len(n))
            waiting += len(buckets)
            if waiting >= STEP_TOKENS:
                for tables in zip(own, sums, squares, strict=True):
                    step(*tables)
                waiting = 0
        if waiting:
            for tables in zip(own, sums, squares, strict=True):
                step(*tables)
        del squares, sums
        for kind, (w, n) in enumerate(zip(own, seen, strict=True)):
            for rows in np.array_split(np.flatnonzero(n), 8):
                yield _rows(kind, rows, n[rows], w[rows] * n[rows, None])
        release()

    return run


def _rows(kind: int, features: np.ndarray, seen: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel().astype(np.float32)))
    return pa.record_batch([pa.array(np.full(len(features), kind, np.int32)), pa.array(features), pa.array(seen), lists], ["kind", "feature", "seen", "values"])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature's sums over all tasks divided by how often they saw it; holds a table of the features dealt here."""
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            part = batch.filter(pa.array(kinds == kind))
            new = (part.column("feature").to_numpy(), part.column("seen").to_numpy(), part.column("values").flatten().to_numpy().reshape(len(part), -1).astype(np.float64))
            feature, seen, values = (np.concatenate(x) for x in zip(held[kind], new, strict=True)) if kind in held else new
            order = np.argsort(feature, kind="stable")
            features, first = np.unique(feature[order], return_index=True)
            held[kind] = (features, np.add.reduceat(seen[order], first), np.add.reduceat(values[order], first))
    for kind, (features, seen, values) in held.items():
        yield _rows(kind, features, seen, values / seen[:, None])
    release()


def mixed(rows: DataFrame, weights: Weights) -> Weights:
    """The tasks' weights, averaged by feature with ``seen`` as weight: tables of fixed size."""
    out = Weights(*(w.copy() for w in weights))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = rows.repartition(n, "kind", "feature").mapInArrow(_means, "kind int, feature long, seen long, values array<float>").select("kind", "feature", "values").toArrow()
    for batch in table.to_batches():
        kinds, feature = batch.column("kind").to_numpy(), batch.column("feature").to_numpy()
        for kind, w in enumerate(out):
            at = np.flatnonzero(kinds == kind)
            w[feature[at]] = batch.column("values").take(pa.array(at)).flatten().to_numpy().reshape(len(at), w.shape[1])
    return out


def initial_weights(bucket_n: np.ndarray, classes: Classes, hashes: int) -> Weights:
    """Weights that give each class, and each ending in it, its relative frequency."""
    by_place = np.zeros(ENDINGS + 1)
    by_place[classes.place] = bucket_n[: ENDINGS + 1] + 0.5
    by_class = np.add.reduceat(by_place, classes.bounds[:-1])
    outer = np.zeros((offsets(hashes)[-1], len(by_class)), np.float32)
    inner = np.zeros((_INNER[-1], ENDINGS + 1), np.float32)
    outer[0] = np.log(by_class / by_class.sum())
    inner[0] = np.log(by_place / np.repeat(by_class, np.diff(classes.bounds)))
    return Weights(outer, inner)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves 2 when divided by 7; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Model(NamedTuple):
    classes: Classes
    hashes: int
    #: None where tokens are dealt to blocks, each with weights of its own
    weights: Weights | None
    #: log10(N_b + V_b + 1) of each ending
    sizes: np.ndarray
    head_keys: np.ndarray
    head_logs: np.ndarray


def history_logs(m: Model, s: Stream) -> np.ndarray:
    """log10 of P(class | history) * P(ending | class, history) of each token."""
    return _logs(m.weights, m.classes, *features(s, m.hashes), s.buckets)


def _logs(weights: Weights, classes: Classes, f: np.ndarray, g: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    own, column = classes.of[buckets], classes.place[buckets]
    p = np.empty(len(own))
    for tokens, q in probabilities(weights.outer, f):
        p[tokens] = q[np.arange(len(q)), own[tokens]]
    for at, _, first, q in within(weights.inner, g, classes, own):
        p[at] *= q[np.arange(len(at)), column[at] - first]
    return np.log10(np.maximum(p, 1e-300))


def _block_logs(weights, classes: Classes, hashes: int):
    """(row, history): parts of the sums of ``history_logs`` over a document's tokens in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *examples, rows in dealt_examples(batches, hashes):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            yield pa.record_batch([pa.array(rows[first]), pa.array(np.add.reduceat(_logs(weights.value, classes, *examples), first))], ["row", "history"])
        release()

    return run


_SCORED = "row long, doc_id long, n_tokens long, known long, logs double, classes double, tail array<long>, tail_n array<long>"


def _score(model, blocks: int = 1):
    """A row for each document; with several blocks ``classes`` lacks the history's part, and further rows (those with a block) are dealt tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        row_id = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in W.slices(batch.column("text"), SLICE_BYTES // 2):
                s = stream(part)
                own = s.buckets
                chosen = (history_logs(m, s) if m.weights else 0.0) - m.sizes[own]
                order, at = np.argsort(s.tokens), np.empty(len(own), np.int64)
                at[order] = np.minimum(np.searchsorted(m.head_keys, s.tokens[order]), len(m.head_keys) - 1)  # in order, so that searches stay in the cache
                known = m.head_keys[at] == s.tokens
                logs = np.where(known, m.head_logs[at], 0.0)
                n = np.diff(s.starts, append=len(own))
                tails = [np.unique(t, return_counts=True) for t in np.split(s.tokens[~known].view(np.int64), np.cumsum(np.add.reduceat(~known, s.starts, dtype=np.int64))[:-1])]
                scored = pa.record_batch(
                    [
                        pa.array(row_id + np.arange(len(n))),
                        batch.column("doc_id").slice(part.first, len(n)),
                        pa.array(n),
                        pa.array(np.add.reduceat(known, s.starts, dtype=np.int64)),
                        pa.array(np.add.reduceat(logs, s.starts)),
                        pa.array(np.add.reduceat(chosen, s.starts)),
                        pa.array([t[0] for t in tails], pa.list_(pa.int64())),
                        pa.array([t[1] for t in tails], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n_tokens", "known", "logs", "classes", "tail", "tail_n"],
                )
                if blocks > 1:
                    dealt = deal(s, row_id + np.arange(len(n)), batch.column("teaches").slice(part.first, len(n)).to_numpy(zero_copy_only=False), m.hashes, blocks)
                    yield _filled(scored, scored.schema, dealt.schema)
                    yield _filled(dealt, scored.schema, dealt.schema)
                else:
                    yield scored
                row_id += len(n)
        release()

    return run


def _filled(batch: pa.RecordBatch, *schemas: pa.Schema) -> pa.RecordBatch:
    """``batch`` with all columns of the schemas, those it lacks null; rows that are not dealt have the block -1."""
    fields = [f for schema in schemas for f in schema]
    columns = [batch.column(f.name) if f.name in batch.schema.names else pa.array([-1] * len(batch), f.type) if f.name == "block" else pa.nulls(len(batch), f.type) for f in fields]
    return pa.record_batch(columns, [f.name for f in fields])


def _in_blocks(source: DataFrame, model: Model, blocks: int, weights: Weights, rounds: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """What ``_score`` yields, and (row, history) from blocks that are trained (in ``tasks`` tasks) and scored one after the other.

    A block's dealt tokens are deleted when its parts of the sums are written.
    """
    spark = source.sparkSession
    tidy(spark)
    root = f"{shared_root(spark)}/blocks-{uuid.uuid4().hex[:12]}"
    rows = source.withColumn("teaches", F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    dealt = rows.mapInArrow(_score(spark.sparkContext.broadcast(model), blocks), f"{_SCORED}, {_DEALT}")
    dealt.write.partitionBy("block").option("compression", "zstd").parquet(f"{root}/dealt")
    table = spark.read.schema(dealt.schema).parquet(f"{root}/dealt")
    logs = "row long, history double"
    for block in range(blocks):
        mine = table.where(F.col("block") == block).select("teaches", "rows", "times", "examples")
        own = weights
        for _ in range(rounds):
            start = spark.sparkContext.broadcast(own)
            own = mixed(mine.where("teaches").coalesce(tasks).mapInArrow(_trained(start, model.classes, model.hashes, dealt_examples), "kind int, feature long, seen long, values array<float>"), own)
            start.unpersist()
        final = spark.sparkContext.broadcast(own)
        mine.mapInArrow(_block_logs(final, model.classes, model.hashes), logs).write.mode("append").parquet(f"{root}/logs")
        final.unpersist()
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/dealt/block={block}")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
        tidy(spark)
    history = spark.read.schema(logs).parquet(f"{root}/logs").groupBy("row").agg(F.sum("history").alias("history"))
    return table.where("block = -1").drop("block", "teaches", "rows", "times", "examples"), history


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end
    token; a null text is empty and so the end token alone. Documents that are
    held out, and rows with a null id, are scored but teach nothing. Tokens
    never seen in training share one place in their ending (and in the base
    model), so both scores are log10 probabilities of proper models. Without
    training rows both are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    training = source.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    raw = training.mapInArrow(_token_counts, "kind int, key long, bucket int, n long")
    counts = stage(raw.groupBy("kind", "key").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")), "counts")
    vocabulary = counts.where("kind = 0")
    per_bucket = vocabulary.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    bucket, bucket_n, bucket_v = (per_bucket[c].to_numpy() for c in ("bucket", "n", "v"))
    total, kinds = int(bucket_n.sum()), int(bucket_v.sum())
    if not total:
        words = F.size(F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')")) + 1
        return source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), words.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))

    pairs = np.zeros((ENDINGS + 2) ** 2)
    found = counts.where("kind = 1").select("key", "n").toArrow()
    pairs[found["key"].to_numpy()] = found["n"].to_numpy()
    classes = numbered(cluster(pairs.reshape(ENDINGS + 2, -1)))
    all_n, all_v = np.zeros(ENDINGS + 2), np.zeros(ENDINGS + 2)
    all_n[bucket], all_v[bucket] = bucket_n, bucket_v

    sizes = vocabulary.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    hashes, blocks = sized((r["n"], r["count"]) for r in sizes)
    weights = initial_weights(all_n, classes, hashes)
    for _ in range(rounds if blocks == 1 else 0):
        rows = training.mapInArrow(_trained(spark.sparkContext.broadcast(weights), classes, hashes), "kind int, feature long, seen long, values array<float>")
        weights = mixed(rows, weights)

    least, room = 100_001, head
    for r in sizes:
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    frequent = vocabulary.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(classes, hashes, weights if blocks == 1 else None, np.log10(all_n + all_v + 1), keys[order] if len(keys) else np.zeros(1, np.uint64), np.log10(frequent["n"].to_numpy()[order] + 1.0) if len(keys) else np.zeros(1))
    if blocks == 1:
        scored = stage(source.mapInArrow(_score(spark.sparkContext.broadcast(model)), _SCORED), "scored")
        out = scored.select("row", "doc_id", "n_tokens", "known", "logs", "classes")
    else:
        scored, history = _in_blocks(source, model, blocks, weights, rounds, max(1, total // blocks // TASK_TOKENS))
        out = scored.join(history, "row").select("row", "doc_id", "n_tokens", "known", "logs", (F.col("classes") + F.col("history")).alias("classes"))
    if len(frequent) < kinds:
        each = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("key"), F.col("t.tail_n").alias("times"))
        rare = vocabulary.where(F.col("n") < least).select("key", "n")
        more = each.join(rare, "key").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
        out = out.join(more, "row", "left").na.fill(0, ["more_known", "more_logs"])
    else:
        out = out.withColumns({"more_known": F.lit(0).cast("long"), "more_logs": F.lit(0.0)})
    logs = F.col("logs") + F.col("more_logs")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"),
        (logs + F.col("classes")).alias("score"),
    )

"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Method: hierarchical residual packing. Each task packs its own pieces
best-fit (longest first, into the fullest bin with room) while it tokenises;
bins that are nearly full are final. What a task could not pack nearly full
becomes items, each piece a bin of its own: groups of ``FAN_IN`` tasks merge
theirs by a further best-fit round, up a tree. Only nearly full results are
final there too, the others stay the items they were made of, so no level
spoils the choice of the next; the root accepts every bin.

A merge sees counts, not rows: how many items of each length each child has,
at most ``FAN_IN * capacity`` counts however many items there are. Items of
one length are alike, so the plan says which ranks go where, in intervals, and
items find their place by a join on (child, length) and rank.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .bpe import cut_bytes
from .shared import modest_batches, release, small, stage, tidy

CAPACITY = 4096
#: Children of a merge, as a number of bits.
FAN_BITS = 4
FAN_IN = 1 << FAN_BITS
#: Share of the capacity from which a bin is final.
NEARLY_FULL = 0.999
#: Pieces that one task packs together, as a number of bits.
LOCAL_BITS = 18
#: Bytes of remembered chunks (with what the memory itself costs) after which a task starts afresh.
MEMORY_BYTES = 40 << 20
SLICE_BYTES = 3 << 20
_ENTRY_BYTES = 200


class Plan(NamedTuple):
    """Moves: items [item, item + n) go to bins [bin, bin + n) at ``offset``. Final bins: [first, first + n) with ``fill``."""

    item: np.ndarray
    n: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    count: np.ndarray
    fill: np.ndarray


def best_fit(sizes: list[int], counts: list[int], capacity: int) -> Plan:
    """Best-fit, longest first, of ``counts[i]`` items of ``sizes[i]`` (descending, up to ``capacity``).

    Items are numbered in this order. Open bins are kept as intervals of equal
    room, so the work follows the number of different sizes.
    """
    moves: list[tuple[int, int, int, int]] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    free, bins, item = 0, 0, 0  # bit r of ``free`` is set while some bin has r tokens of room

    def put(first: int, n: int, room: int) -> None:
        nonlocal free
        rooms[room].append((first, n))
        free |= 1 << room

    for size, left in zip(sizes, counts, strict=True):
        while left:
            fitting = free >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                first, n = rooms[room].pop()
                if not rooms[room]:
                    free &= ~(1 << room)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            each = room // size
            whole = min(left // each, n)  # bins that take as many as fit
            for k in range(each if whole else 0):
                moves.append((item + k * whole, whole, first, capacity - room + k * size))
            if whole:
                put(first, whole, room - each * size)
            item, left, first, n = item + each * whole, left - each * whole, first + whole, n - whole
            if n and 0 < left < each:
                moves += [(item + k, 1, first, capacity - room + k * size) for k in range(left)]
                put(first, 1, room - left * size)
                item, left, first, n = item + left, 0, first + 1, n - 1
            if n:
                put(first, n, room)
    closed = np.array(sorted((first, n, capacity - room) for room, some in enumerate(rooms) for first, n in some), np.int64).reshape(-1, 3)
    return Plan(*np.array(moves, np.int64).reshape(-1, 4).T, *closed.T)


def _cut(first: np.ndarray, n: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [first, first + n) cut at sorted points: (interval, first, n) of the parts."""
    a, b = np.searchsorted(points, first, "right"), np.searchsorted(points, first + n, "left")
    parts = b - a + 1
    of = np.repeat(np.arange(len(first)), parts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    inner = np.concatenate((points, [0]))
    start = np.where(place == 0, first[of], inner[a[of] + place - 1])
    end = np.where(place == parts[of] - 1, (first + n)[of], inner[np.minimum(a[of] + place, len(points))])
    return of, start, end - start


def _ranks(kind: np.ndarray) -> np.ndarray:
    """The rank of each item among those of its kind, in order."""
    order = np.argsort(kind, kind="stable")
    kinds, start = np.unique(kind[order], return_index=True)
    rank = np.empty(len(kind), np.int64)
    rank[order] = np.arange(len(kind)) - start[np.searchsorted(kinds, kind[order])]
    return rank


def pack_items(lengths: np.ndarray, capacity: int, full: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, rank) of each item; those in bins below ``full`` are taken out again, into bins of their own, and have a rank among those of their length (others -1)."""
    kinds, counts = np.unique(-lengths, return_counts=True)
    plan = best_fit((-kinds).tolist(), counts.tolist(), capacity)
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    within = np.arange(len(lengths)) - np.repeat(np.cumsum(plan.n) - plan.n, plan.n)
    items = np.argsort(-lengths, kind="stable")[np.repeat(plan.item, plan.n) + within]
    where[items] = np.repeat(plan.bin, plan.n) + within
    offset[items] = np.repeat(plan.offset, plan.n)
    open_ = plan.fill[np.searchsorted(plan.first, where, "right") - 1] < full * capacity
    offset[open_] = 0
    where[open_] = plan.count.sum() + np.arange(np.count_nonzero(open_))
    rank = np.full(len(lengths), -1)
    rank[open_] = _ranks(lengths[open_])
    return where, offset, rank


_STOPS = frozenset(",.;:!?")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
#: Stands between chunks that are encoded together; a chunk that holds it is encoded alone.
_BETWEEN = "\0"


class WordTokenizer:
    """A lower-casing ``tokenizers`` file whose tokens end words and never span ASCII white space.

    So each chunk between white space is encoded once. Exact shortcuts: A-Z
    are lower-cased first, but in texts with combining marks (they could
    compose differently) or with what may open an added token (those match
    before lower-casing); a single stop after an ASCII letter is a token of its own,
    and so is all that comes before it; words of lower-case letters skip the
    splitter and are encoded many at a time, their ends known by the tokens
    that end words; other chunks have a token of their own put between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        own = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        bare = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        self.modes = {False: own, True: bare}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.openings = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        (self.between,) = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.stop = {c: self._alone(c) for c in _STOPS}

    def _ids(self, texts: list[str], bare: bool) -> np.ndarray:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.modes[bare]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        self.held += sum(map(len, texts)) + ids.nbytes
        return ids

    def _alone(self, chunk: str) -> bytes:
        return self._ids([chunk], False).tobytes()

    def _words(self, chunks: list[str]) -> list[bytes]:
        ids = self._ids([" ".join(chunks[a : a + 256]) for a in range(0, len(chunks), 256)], True)
        return cut_bytes(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1).tolist())

    def _others(self, chunks: list[str]) -> list[bytes]:
        ids = self._ids([f" {_BETWEEN} ".join([*chunks[a : a + 64], ""]) for a in range(0, len(chunks), 64)], False)
        gap = ids == self.between
        return cut_bytes(ids[~gap], (np.diff(np.flatnonzero(gap), prepend=-1) - 1).tolist())

    def _learn(self, new: list[str]) -> None:
        known = self.known
        before = len(known)
        stopped = [x for x in new if x[-1:] in _STOPS and x[-2:-1] in _LETTERS]
        bare = set(new).difference(stopped)
        bare.update([x for x in [x[:-1] for x in stopped] if x not in known])
        words = [x for x in bare if x.isalpha() and (x.isascii() or unicodedata.is_normalized("NFC", x)) and x == x.lower()]
        bare.difference_update(words)
        odd = [x for x in bare if _BETWEEN in x]
        bare.difference_update(odd)
        for some, encode in ((words, self._words), (list(bare), self._others)):
            for at in range(0, len(some), 16_384):
                part = some[at : at + 16_384]
                known.update(zip(part, encode(part), strict=True))
        for x in odd:
            known[x] = self._alone(x)
        stop = self.stop
        known.update([(x, known[x[:-1]] + stop[x[-1]]) for x in stopped])
        self.held += _ENTRY_BYTES * (len(known) - before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) for a large string array without nulls."""
        lower = pc.ascii_lower(texts)
        marks = (b"\xcc", b"\xcd", *self.openings)
        raw = W.string_buffers(texts)[0].tobytes() if len(texts) else b""
        marks = [m for m in marks if m in raw]
        if marks:
            kept = reduce(pc.or_, [pc.match_substring(texts.cast(pa.large_binary()), m) for m in marks])
            lower = pc.if_else(kept, texts, lower)
        words = pc.ascii_split_whitespace(lower)
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > MEMORY_BYTES:
            self.known, self.held = {}, 0
        found = list(map(self.known.get, chunks))
        new = [x for x, ids in zip(chunks, found, strict=True) if ids is None]
        if new:
            self._learn(new)
            learnt = map(self.known.__getitem__, new)
            found = [next(learnt) if ids is None else ids for ids in found]
        ids = pa.array(found, pa.large_binary())
        every = ids.take(coded.indices)
        offsets, data = (np.frombuffer(x, t) if x else np.zeros(0, t) for x, t in zip(every.buffers()[1:], (np.int64, "<u4"), strict=True))
        bounds = np.asarray(words.offsets, np.int64)
        size = np.diff(offsets[bounds - bounds[0]]) // 4
        return data[: size.sum()], size


def _pieces(ids: np.ndarray, sizes: np.ndarray, end_id: int, capacity: int) -> tuple[np.ndarray, ...]:
    """(document, piece, start, length, crc32) of the pieces of some documents, each closed by the end id."""
    full = np.empty(len(ids) + len(sizes), "<u4")
    ends = np.cumsum(sizes + 1)
    own = np.ones(len(full), bool)
    own[ends - 1] = False
    full[own], full[ends - 1] = ids, end_id
    n = -(-(sizes + 1) // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(capacity, (sizes + 1)[doc] - start)
    at = (ends - sizes - 1)[doc] + start
    raw = memoryview(full).cast("B")
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(doc))
    return doc, piece, start, length, crc


def _local(path: str, capacity: int, end_id: int, full: float):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "child", "rank", "bin", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        child = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal child, held
            rows = pa.Table.from_batches(held).combine_chunks()
            where, offset, rank = pack_items(rows.column("length").to_numpy(), capacity, full)
            found = [pa.array(c, pa.int64()) for c in (np.full(len(rows), child), rank, where, offset)]
            child, held = child + (1 << 24), []  # a task's further packings are children of their own
            return pa.record_batch([*(c.chunk(0) for c in rows.columns), *found], names)

        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in W.text_slices(batch.column("text"), SLICE_BYTES):
                doc, *columns = _pieces(*tokenizer.encode(texts), end_id, capacity)
                held.append(pa.record_batch([ids.take(pa.array(first + doc)), *(pa.array(c, pa.int64()) for c in columns)], names[:5]))
                if sum(map(len, held)) >= 1 << LOCAL_BITS:
                    yield packed()
        if held:
            yield packed()
        del tokenizer
        release()

    return run


_PLAN = "child long, length long, low long, high long, into long, shift long, to_rank long"


def merge_counts(child: np.ndarray, length: np.ndarray, n: np.ndarray, capacity: int, full: float) -> list[np.ndarray]:
    """Where a group's items go, given how many of each length each child has: columns as in ``_PLAN``.

    Items of ``child`` and ``length`` whose rank is in [low, high) go into new
    bins ``into``, ``into + 1``, ... at ``shift``. Those that stay items
    have ``into`` -1 and ranks ``to_rank`` and on among the group's items of
    their length.
    """
    order = np.lexsort((child, -length))
    child, length, n = child[order], length[order], n[order]
    kinds, start = np.unique(-length, return_index=True)
    plan = best_fit((-kinds).tolist(), np.add.reduceat(n, start).tolist(), capacity)
    # moves cut where a child's items begin, then where bins of another fill begin
    row_at = np.cumsum(n) - n
    move, item, size = _cut(plan.item, plan.n, row_at)
    part, into, size = _cut(plan.bin[move] + item - plan.item[move], size, plan.first)
    item = item[part] + into - (plan.bin[move] + item - plan.item[move])[part]
    final = plan.fill[np.searchsorted(plan.first, into, "right") - 1] >= full * capacity
    row = np.searchsorted(row_at, item, "right") - 1
    stay = np.lexsort((item, final))[: np.count_nonzero(~final)]
    to_rank = np.full(len(item), -1)
    before = np.cumsum(size[stay]) - size[stay]
    opens = np.flatnonzero(np.diff(length[row[stay]], prepend=0))  # items are in order of length
    to_rank[stay] = before - np.repeat(before[opens], np.diff(opens, append=len(stay)))
    low = item - row_at[row]
    return [child[row], length[row], low, low + size, np.where(final, into, -1), np.where(final, plan.offset[move][part], 0), to_rank]


def _merge(capacity: int, full: float):
    def run(table: pa.Table) -> pa.Table:
        columns = merge_counts(*(table.column(c).to_numpy() for c in ("child", "length", "n")), capacity, full)
        return pa.table([pa.array(c) for c in columns], [c.split()[0] for c in _PLAN.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A document is its token ids, as the tokenizer file gives them without
    special tokens added (an added token's own string in a text is that
    token), and then ``end_id``; a null or empty text is
    the end id alone. Documents longer than ``capacity`` are cut into pieces
    of that length, the last being shorter. Rows that repeat are packed each
    for itself; ids may be null. Other columns are ignored; an empty table
    gives no pieces. No piece is ever dropped or cut to fit.
    """
    modest_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, child long, rank long, bin long, at long"
    # a bin's number: its level, child and place in the child; level by level places take FAN_BITS more and children as many fewer
    number = lambda level, child, place: F.lit(level << 58) + child * (1 << (LOCAL_BITS + 1 + FAN_BITS * level)) + place
    pieces = stage(source.mapInArrow(_local(tokenizer_path, capacity, end_id, NEARLY_FULL), schema), "pieces")
    pieces = pieces.withColumn("bin", number(0, F.col("child"), F.col("bin")))
    items = pieces.where("rank >= 0").select("bin", "child", "length", "rank")
    counts = stage(items.groupBy("child", "length").agg(F.count("*").alias("n")), "counts")
    top = counts.agg(F.max("child")).first()[0]
    moved, level = None, 0
    while top is not None and (level == 0 or top > 0):
        level, top = level + 1, top >> FAN_BITS
        plan = stage(counts.groupBy(F.shiftright("child", FAN_BITS).alias("g")).applyInArrow(_merge(capacity, NEARLY_FULL if top else 0.0), _PLAN), "plan")
        i, p = items.alias("i"), small(plan).alias("p")
        met = i.join(p, (F.col("i.child") == F.col("p.child")) & (F.col("i.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        up, gap = F.shiftright(F.col("i.child"), FAN_BITS), F.col("rank") - F.col("low")
        into = F.when(F.col("into") >= 0, number(level, up, F.col("into") + gap))
        step = stage(met.select("bin", up.alias("child"), F.col("i.length").alias("length"), (F.col("to_rank") + gap).alias("rank"), into.alias("into"), "shift"), "step")
        counts = stage(plan.where("into < 0").groupBy(F.shiftright("child", FAN_BITS).alias("child"), "length").agg(F.sum(F.col("high") - F.col("low")).alias("n")), "counts")
        final = step.where("into is not null").select("bin", "into", "shift")
        moved = final if moved is None else moved.unionByName(final)
        items = step.where("into is null").select("bin", "child", "length", "rank")
    tidy(docs.sparkSession)
    placed = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "bin", "at")
    if moved is not None:
        placed = placed.join(small(moved), "bin", "left")
    else:
        placed = placed.withColumns({"into": F.lit(None).cast("long"), "shift": F.lit(None).cast("long")})
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))

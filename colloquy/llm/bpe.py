"""Byte-level BPE over Arrow batches with the ``tokenizers`` library.

The vocabulary is a rank file (base64 token, rank); its path is a parameter
and it is never copied. Bytes are named by printable characters so that the
library can work on strings, and decoding reverses that table.

Speed comes from one exact observation: no piece of the splitting pattern
spans a point before a space that a non-space follows, so a text may be cut
there, each distinct chunk encoded once and its ids remembered.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Chunks that a worker remembers before it starts afresh; bounds its memory.
CACHE_ENTRIES = 800_000
#: Characters of text encoded at a time.
SLICE_CHARS = 1 << 21


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    """Encodes and decodes by a rank file; ids are the ranks."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        names = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(names)}
        name = {token: "".join(map(names.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):  # every split counts: a merge is known by its result alone
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    merges.append((name[token[:k]], name[token[k:]]))
        vocab = {name[token]: rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.bare = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = [b""] * (max(ranks.values()) + 1)
        for shown, rank in vocab.items():
            self.table[rank] = bytes(map(self.byte_of.__getitem__, shown))
        self.text_of = [str(i) for i in range(len(self.table))]
        self._ids = Chunks(self._encode_ids, self._stop_id)
        self._spans = Chunks(self._encode_spans, self._stop_span)
        self._stops = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in STOPS}

    def _stop_id(self, size: int, stop: str) -> bytes:
        return np.uint32(self._stops[stop]).tobytes()

    def _stop_span(self, size: int, stop: str) -> bytes:
        return np.array([self._stops[stop], size, size + 1], np.uint32).tobytes()

    def _parts(self, texts: list[str]) -> Iterator[tuple[list[int], object]]:
        """(indices, encoder): words of letters, with or without a space before, skip the splitter, which would keep them whole."""
        whole = [(t[1:] if t[:1] == " " else t).isalpha() for t in texts]
        for keep, tokenizer in ((True, self.bare), (False, self.tokenizer)):
            at = [i for i, w in enumerate(whole) if w is keep]
            if at:
                yield at, tokenizer

    def _encode_ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        for at, tokenizer in self._parts(texts):
            ids = [e.ids for e in tokenizer.encode_batch_fast([texts[i] for i in at], add_special_tokens=False)]
            for i, found in zip(at, cut_bytes(np.fromiter(itertools.chain.from_iterable(ids), np.uint32), list(map(len, ids))), strict=True):
                out[i] = found
        return out

    def _encode_spans(self, texts: list[str]) -> list[bytes]:
        """(id, start, end) of each token, flat."""
        out: list[bytes] = [b""] * len(texts)
        for at, tokenizer in self._parts(texts):
            encoded = tokenizer.encode_batch([texts[i] for i in at], add_special_tokens=False)
            ids = [e.ids for e in encoded]
            sizes = list(map(len, ids))
            flat = np.empty((sum(sizes), 3), np.uint32)
            flat[:, 0] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
            offsets = itertools.chain.from_iterable(itertools.chain.from_iterable(e.offsets for e in encoded))
            flat[:, 1:] = np.fromiter(offsets, np.uint32).reshape(-1, 2)
            for i, found in zip(at, cut_bytes(flat, sizes), strict=True):
                out[i] = found
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text."""
        for _, found in self._ids.of(texts):
            yield np.frombuffer(b"".join(found), np.uint32)

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text; offsets count code points.

        Tokens that share one character (its bytes are split) share its offsets.
        """
        for sizes, found in self._spans.of(texts):
            flat = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 3)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            base = np.repeat(starts, [len(x) // 12 for x in found])
            yield flat[:, 0], flat[:, 1] + base, flat[:, 2] + base

    def forget(self) -> None:
        """Give remembered chunks back at a task's end: workers are reused by other stages."""
        for chunks in (self._ids, self._spans):
            chunks.known.clear()
            chunks.spaced.clear()
        release()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_text(self, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
        """Text as ids arrive; a character split over tokens appears with its last byte."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors)
        for i in ids:
            yield decoder.decode(self.table[i])
        yield decoder.decode(b"", True)


def cut_bytes(rows: np.ndarray, sizes: list[int]) -> list[bytes]:
    """The bytes of consecutive runs of rows."""
    raw, width = rows.tobytes(), rows.itemsize * (rows.shape[1] if rows.ndim == 2 else 1)
    ends = [width * n for n in itertools.accumulate(sizes)]
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: A single one of these at a chunk's end, after an ASCII letter, is a token of its own.
STOPS = frozenset(",.;:!?")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UNSAFE = re.compile(r" (?!\S)")
_CUT = re.compile(r"(?= \S)")


class Chunks:
    """Remembers what ``encode`` gives for each distinct chunk."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], stop: Callable[[int, str], bytes], limit: int = CACHE_ENTRIES):
        self.encode, self.stop, self.limit = encode, stop, limit
        self.known: dict[str, bytes] = {"": b""}  # chunks as they are
        self.spaced: dict[str, bytes] = {}  # chunks after a space, without it

    def of(self, texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
        """For each text the sizes and encodings of its chunks (an empty first one included) in order."""
        firsts, rests = [], []
        for text in texts:
            if _UNSAFE.search(text):
                first, *rest = _CUT.split(text)
                rest = [p[1:] for p in rest]
            else:
                first, *rest = text.split(" ")
            firsts.append(first)
            rests.append(rest)
        self._learn(firsts, rests)
        known, spaced = self.known.__getitem__, self.spaced.__getitem__
        for first, rest in zip(firsts, rests, strict=True):
            yield [len(first), *(len(p) + 1 for p in rest)], [known(first), *map(spaced, rest)]

    def _learn(self, firsts: list[str], rests: list[list[str]]) -> None:
        for memory, before, wanted in ((self.known, "", firsts), (self.spaced, " ", rests)):
            each = lambda w=wanted, nested=bool(before): itertools.chain.from_iterable(w) if nested else w
            new = set(itertools.filterfalse(memory.__contains__, each()))
            if len(memory) + len(new) > self.limit:
                memory.clear()
                new = set(each())
            stopped = [x for x in new if len(x) > 1 and x[-1] in STOPS and x[-2] in _LETTERS]
            new.difference_update(stopped)
            new.update(x for x in {x[:-1] for x in stopped} if x not in memory)
            bare = list(new)
            for at in range(0, len(bare), 20_000):
                some = bare[at : at + 20_000]
                memory.update(zip(some, self.encode([before + x for x in some]), strict=True))
            for x in stopped:
                memory[x] = memory[x[:-1]] + self.stop(len(before) + len(x) - 1, x[-1])
        self.known.setdefault("", b"")


@functools.cache
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE(path, pattern)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows; nulls are empty texts."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and size + len(text) > limit:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch):
                rows = []
                for found in bpe.encode(texts):
                    ids = found.tolist()
                    rows.append((len(ids), hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                n, encoded, decoded = zip(*rows, strict=True)
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each input row.

    A null text counts as empty (no tokens); ids may be null or repeat; other
    columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_round_trip(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch):
                ids, starts, ends = [], [], []
                for i, a, b in bpe.encode_with_offsets(texts):
                    ids.append(i.tolist())
                    starts.append(a)
                    ends.append(b)
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), *(pa.array(x, pa.list_(t)) for x, t in ((ids, pa.int32()), (starts, pa.int64()), (ends, pa.int64())))], ["doc_id", "ids", "starts", "ends"])
        bpe.forget()

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): token ids with code point offsets; a null text has none."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode_text(x.as_py() or [])) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, broken characters U+FFFD."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, text string")

"""Operator 7 - benchmark decontamination over training suffix arrays.

Every slice of the corpus is a shard: its words become ids of the benchmark's vocabulary (0: any other word),
and the suffixes that can hold a window are sorted by their first words into a suffix array.  Every test
suffix, cut to its window, is binary-searched in every shard; a range of the array is all its occurrences.
Neighbouring occurrences on one diagonal join into the longest verbatim matches (``matches``).

A window is ``window`` consecutive item words; a shorter item with words is one window.  No row is shuffled.
The benchmark is taken in blocks of about ``block_bytes`` of text, whose indexes are files in the shared folder; a
worker holds one of them at a time and searches a run of slices with each in turn.

Defined results: null or wordless texts have no words and no hits; wordless items and items without an id
match nothing; repeated items and rows count alike; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh_dir
from .tokenfiles import _store, put

WINDOW, BLOCK_BYTES = 10, 8 << 20
#: Rows searched with one block before the next is loaded, if there are several.
RUN_BYTES = 32 << 20


def _words(column: pa.Array) -> tuple[K.Words, np.ndarray]:
    text = K.text_of(column)
    text = K.Text(K.LOWER[text.buf], text.offs)
    words = K.find_words(text, K.NON_ALNUM)
    return words, K.hash_words(text, words)


@dataclass(frozen=True)
class TestIndex:
    """One block of items: its vocabulary and its distinct windows, packed like the suffixes."""

    vocabulary: np.ndarray  # sorted word hashes; id = place + 1
    maybe: np.ndarray  # by a hash's low bits: whether the vocabulary may hold it
    bits: int
    window: int
    size: np.ndarray  # words of each distinct window
    low: np.ndarray  # keys x windows
    high: np.ndarray
    items: np.ndarray  # item ids
    first: np.ndarray  # windows + 1, into owners
    owners: np.ndarray  # places in items
    places: np.ndarray  # where in its item each owner has the window

    @property
    def shortest(self) -> int:
        return int(self.size.min()) if len(self.size) else 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            at = np.flatnonzero(self.maybe[hashes & K.U64(len(self.maybe) - 1)])
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[place] == hashes[at], place + 1, 0)
        return out

    def pack(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Sort keys of the windows at ``at``: as many ids to a 63-bit key as fit, most significant first."""
        each = max(1, 63 // self.bits)
        keys = []
        for a in range(0, self.window, each):
            key = np.zeros(len(at), np.int64)
            for k in range(a, min(a + each, self.window)):
                key = (key << self.bits) | ids[at + k]
            keys.append(key)
        return keys


def index_items(ids: list[int], texts: list[str | None], window: int = WINDOW) -> TestIndex:
    words, hashes = _words(pa.array(texts, pa.string()))
    vocabulary = np.unique(hashes)
    bits = max(1, int(len(vocabulary) + 1).bit_length())
    maybe = np.zeros(1 << max(16, bits + 4), bool)
    maybe[vocabulary & K.U64(len(maybe) - 1)] = True
    code = np.searchsorted(vocabulary, hashes) + 1
    names = sorted(set(ids))
    place = {x: k for k, x in enumerate(names)}
    found: dict[tuple[int, ...], set[tuple[int, int]]] = {}
    for k, (a, b) in enumerate(zip(words.row, words.row[1:], strict=False)):
        own = code[a:b].tolist()
        for at in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[at : at + window]), set()).add((place[ids[k]], at))
    windows = sorted(found)
    low, high = (np.array([list(w) + [fill] * (window - len(w)) for w in windows], np.int64).reshape(len(windows), window) for fill in (0, (1 << bits) - 1))
    owners = [sorted(found[w]) for w in windows]
    blank = TestIndex(vocabulary, maybe, bits, window, np.array([len(w) for w in windows], np.int64), low, high, np.array(names), np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64), np.array([o for x in owners for o, _ in x], np.int64), np.array([p for x in owners for _, p in x], np.int64))
    at = np.arange(len(windows)) * window
    packed = [np.array(blank.pack(x.ravel(), at)) for x in (low, high)]
    return TestIndex(**{**blank.__dict__, "low": packed[0], "high": packed[1]})


def _bound(keys: list[np.ndarray], order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: first place in ``order`` not below (or above) each."""
    lo, hi = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], len(order), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for have, want in zip(keys, wanted, strict=True):
            less |= same & (have[at] < want)
            same &= have[at] == want
        if after:
            less |= same
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


@dataclass(frozen=True)
class Hits:
    words: K.Words
    window: np.ndarray  # of each occurrence: the window
    at: np.ndarray  # and the word position in the shard


def search(column: pa.Array, index: TestIndex) -> Hits:
    """All occurrences of all windows in one shard."""
    words, hashes = _words(column)
    none = np.zeros(0, np.int64)
    rows, need = len(words.row) - 1, index.shortest
    if not need or not len(hashes):
        return Hits(words, none, none)
    ids = index.ids(hashes)
    # each row is followed by a window's worth of zeros, so that no suffix reaches into the next row
    spread = np.zeros(len(ids) + (rows + 1) * index.window, np.int64)
    where = np.arange(len(ids)) + K.row_ids(words.row) * index.window
    spread[where] = ids
    others = np.concatenate(([0], np.cumsum(spread == 0)))
    suffix = np.flatnonzero(others[where + need] == others[where])
    if not len(suffix):
        return Hits(words, none, none)
    keys = index.pack(spread, where[suffix])
    order = np.lexsort(keys[::-1])
    lo, hi = _bound(keys, order, index.low, False), _bound(keys, order, index.high, True)
    count = hi - lo
    window = np.repeat(np.arange(len(count)), count)
    run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return Hits(words, window, suffix[order[np.repeat(lo, count) + run]])


def _owners(index: TestIndex, row: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, item) pairs of distinct (row, window) pairs."""
    pair = np.unique(row * len(index.size) + window)
    row, window = pair // len(index.size), pair % len(index.size)
    count = index.first[window + 1] - index.first[window]
    run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    both = np.unique(np.repeat(row, count) * len(index.items) + index.owners[np.repeat(index.first[window], count) + run])
    return both // len(index.items), both % len(index.items)


@dataclass(frozen=True)
class Blocks:
    """Indexes of a benchmark's blocks, as files in the shared folder: only their names travel with a task."""

    folder: str
    names: tuple[str, ...]

    def load(self, name: str) -> TestIndex:
        if _LOADED.get("at") != (self.folder, name):  # a worker holds one block at a time
            store, path = _store(f"{self.folder}/{name}")
            with store.open_input_stream(path) as data:
                _LOADED.update(at=(self.folder, name), index=pickle.loads(data.read()))
        return _LOADED["index"]


_LOADED: dict = {}


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Index the benchmark by blocks; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    folder, names = fresh_dir(spark, "benchmark"), []
    ids, texts, size = [], [], 0

    def flush() -> None:
        nonlocal ids, texts, size
        names.append(f"{len(names):06d}.index")
        put(folder, names[-1], [pickle.dumps(index_items(ids, texts, window), pickle.HIGHEST_PROTOCOL)])
        ids, texts, size = [], [], 0

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= block_bytes:
            flush()
    if ids or not names:
        flush()
    return Blocks(folder, tuple(names))


def _slices(batches: Iterator[pa.RecordBatch], column: str, found: Blocks) -> Iterator[list[pa.RecordBatch]]:
    """Runs of slices that are searched with each block in turn: with several blocks they are long, so that a block is
    loaded once for many slices."""
    held, size = [], 0
    for batch in batches:
        for part in K.steps(batch, column):
            held.append(part)
            size += part.nbytes
            if len(found.names) == 1 or size >= RUN_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Marks:
    """What the blocks searched so far have found in one slice: hit words as bitmaps, items as lists."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.part, self.words = part, None
        self.hit: list[bytes | None] = [None] * part.num_rows
        self.items: list[list[int] | None] = [None] * part.num_rows

    def add(self, column: str, index: TestIndex) -> None:
        found = search(self.part.column(column), index)
        words = found.words
        self.words = np.diff(words.row)
        hit = K.covered(found.at, index.size[found.window], int(words.row[-1])) if len(found.at) else np.zeros(int(words.row[-1]), bool)
        rows, items = _owners(index, np.searchsorted(words.row, found.at, side="right") - 1, found.window)
        for k in np.unique(rows).tolist():
            own = np.packbits(hit[words.row[k] : words.row[k + 1]])
            self.hit[k] = (own | np.frombuffer(self.hit[k], np.uint8)).tobytes() if self.hit[k] else own.tobytes()
            self.items[k] = sorted({*(self.items[k] or ()), *index.items[items[rows == k]].tolist()})


def _marked(batches: Iterator[pa.RecordBatch], column: str, found: Blocks) -> Iterator[_Marks]:
    for parts in _slices(batches, column, found):
        marks = [_Marks(p) for p in parts]
        for name in found.names:
            for mark in marks:
                mark.add(column, found.load(name))
        yield from marks


def inspect(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids), items_sha256, contaminated: a row per document."""
    found = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark in _marked(batches, "text", found):
            items = [x or [] for x in mark.items]
            n_hit = [int.from_bytes(b, "big").bit_count() if b else 0 for b in mark.hit]
            sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([mark.part.column("doc_id"), pa.array(mark.words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(sha), pa.array([x > 0 for x in n_hit])], ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<long>, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns."""
    found = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark in _marked(batches, "text", found):
            yield mark.part.filter(pa.array([x is None for x in mark.hit]))

    return docs.mapInArrow(run, docs.schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches: doc_id, word, item_id, item_word, length in words.  A match is a maximal run of
    window occurrences one word apart in both texts."""
    blocked = blocks(benchmark, window, block_bytes)

    def longest(part: pa.RecordBatch, index: TestIndex) -> pa.RecordBatch:
        found = search(part.column("text"), index)
        count = index.first[found.window + 1] - index.first[found.window]
        run_ = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        own = np.repeat(index.first[found.window], count) + run_
        at, size = np.repeat(found.at, count), np.repeat(index.size[found.window], count)
        item, place = index.owners[own], index.places[own]
        row = np.searchsorted(found.words.row, at, side="right") - 1
        order = np.lexsort((at, at - place, item, row))
        at, size, item, place, row = (x[order] for x in (at, size, item, place, row))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(item) != 0) | (np.diff(row) != 0)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at)) - 1 if len(at) else head
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[head])), pa.array(at[head] - found.words.row[row[head]]), pa.array(index.items[item[head]] if len(head) else [], pa.int64()), pa.array(place[head]), pa.array(at[last] + size[last] - at[head])], ["doc_id", "word", "item_id", "item_word", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _slices(batches, "text", blocked):
            for name in blocked.names:
                yield from (longest(part, blocked.load(name)) for part in parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, word long, item_id long, item_word long, length long")

"""Operator 8 - token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by id; each partition writes ``tokens-NNNNN.bin`` (unsigned little-endian
16-bit ids, 32-bit where the vocabulary needs it) and its ids and lengths.  Prefix sums over the partitions'
token counts give each its base; ``offsets-NNNNN.u64`` then holds every document's place in the whole
corpus, end included.  Readers map the files into memory.  Files are written under a temporary name and
renamed, so a repeated task replaces its file by the same one.

Encoding is the tokenizers library's.  Its pre-tokeniser never lets a piece cross from a non-blank to a blank
character, so a text is the sequence of its chunks (blanks, then non-blanks) and a chunk met before is taken
from a bounded table; a text with any non-ASCII blank is encoded whole.

Defined results: a null or empty text is the end id alone; repeated ids are ordered by text; an empty table
gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import keep, partitions

END_ID = 0
#: Slots of a worker's table of known chunks, and how full it gets before it is begun anew.
SLOTS, MOST = 1 << 22, 5 << 19


def _odd_rows(text: K.Text) -> np.ndarray:
    """Rows with a blank other than space and the controls 9-13: U+001C-1F, 85, A0, 1680, 2000-200A, 2028-29, 202F, 205F, 3000."""
    buf = np.concatenate((text.buf, np.zeros(2, np.uint8)))
    at = np.flatnonzero(_BLANK_LEAD[text.buf])
    a, b, c = buf[at], buf[at + 1], buf[at + 2]
    tail = (c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
    odd = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & ((b == 0x80) & tail | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(text.offs, at[odd], side="right") - 1)


_BLANK_LEAD = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


class Encoder:
    """Encodes texts, remembering the ids of chunks in an open-addressed table keyed by 64-bit hashes of (chunk,
    length); the table is bounded and begun anew when full."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.key, self.place = np.zeros(SLOTS, K.U64), np.full(SLOTS, -1, np.int32)
        self.n, self.first, self.ids = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        out, slot = np.full(len(keys), -1, np.int64), (keys & K.U64(SLOTS - 1)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            place = self.place[slot]
            same = (self.key[slot] == keys[open_]) & (place >= 0)
            out[open_[same]] = place[same]
            more = (place >= 0) & ~same
            open_, slot = open_[more], (slot[more] + 1) % SLOTS
        return out

    def add(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """New distinct keys and their chunks."""
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        ids = [x.ids for x in found]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), self.kind, int(size.sum()))
        used = int(self.first[self.n])
        while len(self.first) < self.n + len(keys) + 1:
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        while len(self.ids) < used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[used : used + len(flat)] = flat
        self.first[self.n + 1 : self.n + len(keys) + 1] = used + np.cumsum(size)
        open_, slot = np.arange(len(keys)), (keys & K.U64(SLOTS - 1)).astype(np.int64)
        while len(open_):
            free = np.flatnonzero(self.place[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)  # one key to a free slot
            mine = free[one]
            self.key[slot[mine]], self.place[slot[mine]] = keys[open_[mine]], self.n + open_[mine]
            left = np.ones(len(open_), bool)
            left[mine] = False
            open_, slot = open_[left], (slot[left] + 1) % SLOTS
        self.n += len(keys)

    def encode(self, text: K.Text) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one after another, and where each row begins."""
        ends = np.sort(np.concatenate((K.find_words(text).end, text.offs[1:][np.diff(text.offs) > 0])))
        ends = ends[np.append(True, np.diff(ends) > 0)] if len(ends) else ends
        for row in _odd_rows(text).tolist():
            ends = ends[(ends <= text.offs[row]) | (ends >= text.offs[row + 1])]
        start = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        keys = K.mix(K.hash_words(text, K.Words(start, ends, ends)) + (ends - start).astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
        entry = self.find(keys)
        if (missing := np.flatnonzero(entry < 0)).size:
            if self.n + missing.size > MOST:
                self.clear()
                missing = np.arange(len(keys))
            new, one = np.unique(keys[missing], return_index=True)
            if len(new) > MOST:  # more than the table takes: by slices at chunk ends
                return self._sliced(text, start, ends, keys)
            spans = missing[one]
            data = text.buf.tobytes()
            self.add(new, [data[a:b] for a, b in zip(start[spans].tolist(), ends[spans].tolist(), strict=True)])
            entry = self.find(keys)
        ids, before = self._taken(entry)
        return ids, before[np.searchsorted(ends, text.offs, side="right")]

    def _taken(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids one after another, and where each entry's begin."""
        size = self.first[entry + 1] - self.first[entry]
        before = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.repeat(self.first[entry] - before[:-1], size) + np.arange(before[-1])], before

    def _sliced(self, text: K.Text, start: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` with a cleared table for each ``MOST`` chunks."""
        data, ids, before = text.buf.tobytes(), [], [np.zeros(1, np.int64)]
        for a in range(0, len(keys), MOST):
            own = keys[a : a + MOST]
            self.clear()
            new, one = np.unique(own, return_index=True)
            self.add(new, [data[x:y] for x, y in zip(start[a + one].tolist(), ends[a + one].tolist(), strict=True)])
            taken, at = self._taken(self.find(own))
            ids.append(taken)
            before.append(at[1:] + before[-1][-1])
        return np.concatenate(ids), np.concatenate(before)[np.searchsorted(ends, text.offs, side="right")]



_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def put(uri: str, name: str, data) -> None:
    """Write a whole file or nothing."""
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    task = TaskContext.get()
    temporary = f"{path}/.{name}.{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(temporary) as out:
        for block in data:
            out.write(block)
    store.move(temporary, f"{path}/{name}")


@contextmanager
def mapped(uri: str, name: str, kind: str | np.dtype):
    """A file as a memory-mapped array; one in a remote store is mapped from a copy that is then removed."""
    store, path = _store(f"{uri}/{name}")
    copy = None
    if not isinstance(store, fs.LocalFileSystem):
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as source:
            while block := source.read(8 << 20):
                out.write(block)
        path = copy
    try:
        yield np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    finally:
        if copy:
            os.remove(copy)


def _writer(out_dir: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        end = encode.kind.type(end_id)
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def blocks() -> Iterator[bytes]:
            for batch in batches:
                for part in K.steps(batch, "text"):
                    ids.append(part.column("doc_id"))
                    tokens, first = encode.encode(K.text_of(part.column("text")))
                    lengths.append(np.diff(first) + 1)
                    yield np.insert(tokens, first[1:], end).tobytes()

        put(out_dir, f"tokens-{shard:05d}.bin", blocks())
        if lengths:
            size, known = np.concatenate(lengths), pa.concat_arrays(ids)
            put(out_dir, f"lengths-{shard:05d}.u64", [size.astype("<u8").tobytes()])
            put(out_dir, f"ids-{shard:05d}.i64", [known.fill_null(np.iinfo(np.int64).min).to_numpy().astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": len(size), "n_tokens": int(size.sum()), "width": encode.kind.itemsize}])

    return run


def _offsets(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with mapped(out_dir, f"lengths-{shard:05d}.u64", "<u8") as lengths:
                    put(out_dir, f"offsets-{shard:05d}.u64", [(np.concatenate(([0], np.cumsum(lengths))) + np.uint64(base)).astype("<u8").tobytes()])
            yield batch

    return run


def write(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files; the manifest has shard, n_docs, n_tokens, width, base: a row per file."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    counted = keep(ordered.mapInArrow(_writer(out_dir, tokenizer, end_id), "shard long, n_docs long, n_tokens long, width long"))
    # one row per file: the prefix sums run over the file list, not over documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return keep(based.repartition(partitions(docs.sparkSession)).mapInArrow(_offsets(out_dir), based.schema))


def read(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with mapped(out_dir, f"tokens-{row['shard']:05d}.bin", f"<u{row['width']}") as tokens, mapped(out_dir, f"offsets-{row['shard']:05d}.u64", "<u8") as offsets, mapped(out_dir, f"ids-{row['shard']:05d}.i64", "<i8") as ids:
                    start = offsets.astype(np.int64)
                    for a in range(0, len(ids), 4096):
                        local = (start[a : a + 4097] - row["base"]).tolist()
                        crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(local, local[1:], strict=False)]
                        own = ids[a : a + 4096].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == np.iinfo(np.int64).min), pa.array(start[a : a + len(own)]), pa.array(np.diff(start[a : a + 4097])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Corpus-wide key statistics without a row per key.

A corpus is stored once as batches of documents.  A pass over a batch works out its keys (64-bit hashes, sorted
and distinct) with what it knows of each, and sends every bucket of the hash space one packed row; a bucket
meets the rows of all batches, answers each in the order of its keys, and the batch reads the answers when it
is passed over again.  A key that is frequent in the corpus reaches its bucket once per batch, so no bucket is
hot, and the answers need no keys at all.

The store is partitioned by batch, so later passes move only answers.  Batches hold about the square root of
the corpus in words (a million at least): a row between a batch and a bucket then has hundreds of keys at any
size, and batches and buckets both stay small.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import keep_partitioned, partitions, release

ROW = "bucket int, batch long, payload binary"
NO_ID = np.iinfo(np.int64).min
#: A batch's least size, and how many keys a row between a batch and a bucket should have.
LEAST_BYTES, ROW_KEYS, WORD_BYTES = 10 << 20, 256, 6


class Plan(NamedTuple):
    batch_bytes: int
    buckets: int
    words: int


def plan(docs: DataFrame, text: str = "text") -> Plan:
    """Sizes for a corpus, from one pass over the lengths of its texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    words = total // WORD_BYTES + 1
    batch = max(LEAST_BYTES, int((ROW_KEYS * words) ** 0.5) * WORD_BYTES)
    return Plan(batch, max(2 * partitions(docs.sparkSession), -(-total // batch)), words)


def _pressed(data: bytes, level: int) -> bytes:
    return struct.pack("<q", len(data)) + pa.Codec("zstd", level).compress(data, asbytes=True)


def _unpressed(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], "zstd", asbytes=True)


def pack(*arrays: np.ndarray, rising: int = 0) -> bytes:
    """Arrays as bytes; the first ``rising`` ones are sorted and kept as differences.  Bytes of equal weight
    stand together, and the weights that are always zero are left out."""
    out = []
    for k, x in enumerate(arrays):
        kind = x.dtype.str.encode().ljust(4)
        x = np.diff(x, prepend=x.dtype.type(0)) if k < rising else x
        x = np.ascontiguousarray(x)
        planes = x.view(np.uint8).reshape(-1, x.itemsize)
        used = x.itemsize if x.dtype.kind == "f" else -(-int(x.view(f"u{x.itemsize}").max(initial=0)).bit_length() // 8)
        out.append(struct.pack("<4sqB", kind, len(x), used) + np.ascontiguousarray(planes[:, :used].T).tobytes())
    return _pressed(struct.pack("<BB", len(arrays), rising) + b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    data = _unpressed(data)
    (n, rising), at, out = struct.unpack_from("<BB", data), 2, []
    for k in range(n):
        kind, size, used = struct.unpack_from("<4sqB", data, at)
        at += struct.calcsize("<4sqB")
        kind = np.dtype(kind.decode().strip())
        planes = np.zeros((size, kind.itemsize), np.uint8)
        planes[:, :used] = np.frombuffer(data, np.uint8, size * used, at).reshape(used, size).T
        at += size * used
        x = planes.reshape(-1).view(kind)
        out.append(np.cumsum(x, dtype=kind) if k < rising else x)
    return out


class Docs(NamedTuple):
    """A batch's documents in the order of their ids (null ids first)."""

    ids: np.ndarray
    text: K.Text

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NO_ID)


def _blob(ids: list[pa.Array], texts: list[pa.Array]) -> bytes:
    known = pa.concat_arrays(ids).fill_null(NO_ID).to_numpy()
    column = pa.concat_arrays([t.cast(pa.large_string()) for t in texts])
    order = np.argsort(known, kind="stable")
    text = K.text_of(column.take(pa.array(order)))
    return _pressed(struct.pack("<q", len(known)) + known[order].tobytes() + np.diff(text.offs).tobytes() + text.buf.tobytes(), 3)


def docs_of(blob: bytes) -> Docs:
    data = _unpressed(blob)
    (n,) = struct.unpack_from("<q", data)
    ids, size = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    return Docs(ids, K.Text(np.frombuffer(data, np.uint8, offset=8 + 16 * n), np.concatenate(([0], np.cumsum(size)))))


def store(docs: DataFrame, batch_bytes: int, text: str = "text") -> DataFrame:
    """(batch, blob): the documents in packed batches, partitioned by batch, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, n
            out = pa.RecordBatch.from_arrays([pa.array([(part << 24) + n], pa.int64()), pa.array([_blob(ids, texts)], pa.binary())], ["batch", "blob"])
            ids, texts, size, n = [], [], 0, n + 1
            return out

        for batch in batches:
            for step in K.steps(batch, "_text"):
                ids.append(step.column("doc_id"))
                texts.append(step.column("_text").fill_null(""))
                size += texts[-1].nbytes
                if size >= batch_bytes:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("_text"))
    stored = keep_partitioned(rows.mapInArrow(run, "batch long, blob binary").repartition(partitions(docs.sparkSession), "batch"))
    release(docs.sparkSession)
    return stored


def spans(keys: np.ndarray, buckets: int, bits: int = 64) -> list[tuple[int, slice]]:
    """The buckets that have any of the sorted keys, with their spans; bucket k holds the k-th equal part of the key space."""
    edges = np.array([min((k << bits) // buckets, 2**64 - 1) for k in range(1, buckets)], K.U64)
    cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


def route(batch: int, keys: np.ndarray, buckets: int, *more: np.ndarray, bits: int = 64) -> list[tuple[int, int, bytes]]:
    """One row per bucket that has any of the sorted keys."""
    return [(k, batch, pack(keys[s], *(x[s] for x in more), rising=1)) for k, s in spans(keys, buckets, bits)]


def rows(found: list[tuple], names: str = ROW) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in names.split(", ")]
    columns = list(zip(*found, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def first_pass(stored: DataFrame, send: Callable[[int, Docs], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("batch").to_pylist(), batch.column("blob"), strict=True):
                yield rows(send(name, docs_of(blob.as_py())))

    return stored.mapInArrow(run, ROW)


def answers_of(table: pa.Table) -> list[list[np.ndarray]]:
    """For each kind of answer 0, 1, ...: its arrays, joined in the order of the buckets; the last kind may be absent."""
    kinds, buckets = (table.column(c).to_numpy() for c in ("kind", "bucket"))
    payload = table.column("payload")
    out = []
    for kind in range(int(kinds.max()) + 1 if len(kinds) else 0):
        own = np.flatnonzero(kinds == kind)
        parts = [unpack(payload[int(k)].as_py()) for k in own[np.argsort(buckets[own])]]
        out.append([np.concatenate(x) for x in zip(*parts, strict=True)])
    return out


def later_pass(stored: DataFrame, answers: list[DataFrame], work: Callable[[int, Docs, list[list[np.ndarray]]], pa.RecordBatch], schema: str) -> DataFrame:
    """Each batch again, with the answers of the passes before it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [work(name, docs_of(blob.as_py()), answers_of(right)) for name, blob in zip(left.column("batch").to_pylist(), left.column("blob"), strict=True)]
        return pa.Table.from_batches(out) if out else work(0, Docs(np.zeros(0, np.int64), K.Text(np.zeros(0, np.uint8), np.zeros(1, np.int64))), []).schema.empty_table()

    said = answers[0].select(F.lit(0).alias("kind"), "batch", "bucket", "payload")
    for k, more in enumerate(answers[1:], 1):
        said = said.union(more.select(F.lit(k).alias("kind"), "batch", "bucket", "payload"))
    return stored.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(run, schema)


def meet(sent: DataFrame, answer: Callable[[list[int], list[list[np.ndarray]]], tuple[list[bytes | None], list[int]]], extra: bool = False) -> DataFrame:
    """In each bucket: ``answer`` gets the batches and their arrays, and gives a payload for each batch and, with
    ``extra``, numbers about the bucket (one further row, batch null)."""
    schema = ROW + ", facts array<long>"

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("batch").to_numpy())
        table = table.take(pa.array(order))
        bucket, batches = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        payloads, facts = answer(batches, [unpack(x.as_py()) for x in table.column("payload")])
        found = [(bucket, b, p, None) for b, p in zip(batches, payloads, strict=True)]
        return pa.Table.from_batches([rows(found + ([(bucket, None, None, facts)] if extra else []), schema)])

    return sent.groupBy("bucket").applyInArrow(run, schema)

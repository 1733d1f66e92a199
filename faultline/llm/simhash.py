"""Operator 2 - SimHash near-dedup over a segment-popcount grid.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles.  Distinct
fingerprints are embedded as the bit counts of equal segments; the Manhattan distance of two embeddings is a
lower bound of their Hamming distance.  Around each point the grid is entered at the point itself and at every
cell one count away: points at Manhattan distance 2 or less then meet in a cell, because a lattice point lies
between them.  With 32 segments that is about 50 rows per distinct fingerprint and no list of neighbours.

A cell with two members is a candidate pair.  The members of fuller cells are re-entered into the grid of
single bits, where a cell's members are tied to its least one; so a crowd costs rows in proportion to its
members, not pairs.  Every link is verified by exact Hamming distance.  Components follow from the links.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other.  Rows with a
null id take part; a class of null ids only has a null component.  Repeated rows share their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import free, keep, with_facts
from .components import components

SHINGLE, SEED, SEGMENTS = 3, 42, 32
#: Hamming distance up to which fingerprints link; the grid's reach of one count to each side is made for 2.
RADIUS = 2

#: The primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (K.U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << K.U64(r)) | (x >> K.U64(64 - r))


def _short_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of spans of fewer than 32 bytes, all at once."""
    data = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = size.astype(K.U64) + K.U64(seed) + _P5
    at = start.copy()
    for k in range(3):
        own = np.flatnonzero(size >= 8 * (k + 1))
        h[own] = _rotl(h[own] ^ _rotl(eight[at[own]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[own] += 8
    own = np.flatnonzero(size & 4)
    h[own] = _rotl(h[own] ^ (eight[at[own]] & K.U64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[own] += 4
    for k in range(3):
        own = np.flatnonzero((size & 3) > k)
        h[own] = _rotl(h[own] ^ data[at[own]].astype(K.U64) * _P5, 11) * _P1
        at[own] += 1
    h = (h ^ (h >> K.U64(33))) * _P2
    h = (h ^ (h >> K.U64(29))) * _P3
    return h ^ (h >> K.U64(32))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(text: K.Text, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each row."""
    rows = len(text.offs) - 1
    text = K.Text(K.LOWER[text.buf], text.offs)
    words = K.find_words(text)
    n = np.diff(words.row)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(rows), count)
    first = np.repeat(words.row[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    last = first + np.minimum(shingle, n)[row] - 1
    start, end = words.start[first], words.end[last]
    buf = np.where(K.SPACE[text.buf], np.uint8(0x20), text.buf)
    size = end - start
    tight = np.zeros(len(words.start) + 1, np.int64)  # words after whose end comes more than one blank
    tight[1:] = np.cumsum(np.append(words.start[1:] - words.end[:-1] != 1, False)) if len(words.start) else 0
    plain = (tight[last] == tight[first]) & (size < 32)
    hashes = np.zeros(len(row), K.U64)
    at = np.flatnonzero(plain)
    hashes[at] = _short_hashes(buf, start[at], size[at], seed)
    if (rest := np.flatnonzero(~plain)).size:
        data = buf.tobytes()
        hashes[rest] = [xxhash.xxh64_intdigest(b" ".join(data[a:b].split()), seed) for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
    out = np.zeros(rows, K.U64)
    lanes = hashes.view(np.uint8).reshape(-1, 8) if len(hashes) else np.zeros((0, 8), np.uint8)
    for lane in range(8):
        seen = np.bincount(row * 256 + lanes[:, lane], minlength=rows * 256).reshape(rows, 256)
        ones = (seen @ _BITS) * 2 > count[:, None]
        out |= (ones @ (1 << np.arange(8))).astype(K.U64) << K.U64(8 * lane)
    return out


def fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(K.text_of(part.column("text")), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def cells(prints: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint) for every cell within one count of each fingerprint's bit counts; the
    counts of a cell are packed side by side.  Single bits are their own counts: one count away is the bit flipped."""
    width = 64 // segments
    room = width.bit_length()
    assert 64 % segments == 0 and segments * room <= 64, "the counts of a cell must fit 64 bits"
    parts = (prints[:, None] >> (np.arange(segments, dtype=K.U64) * K.U64(width))) & K.U64((1 << width) - 1)
    count = np.bitwise_count(parts).astype(K.U64)
    shift = np.arange(segments, dtype=K.U64) * K.U64(room)
    point = (count << shift).sum(1, dtype=K.U64)
    up, down = np.nonzero(count < width), np.nonzero(count > 0)
    out = np.concatenate((point, point[up[0]] + (K.U64(1) << shift[up[1]]), point[down[0]] - (K.U64(1) << shift[down[1]])))
    return out, np.concatenate((np.arange(len(prints)), up[0], down[0]))


def enter(points: DataFrame, segments: int) -> DataFrame:
    """(cell, fp) for each cell that a fingerprint enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(K.U64)
            for a in range(0, len(prints), 2048):
                cell, own = cells(prints[a : a + 2048], segments)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(prints[a : a + 2048][own].view(np.int64))], ["cell", "fp"])

    return points.select("fp").mapInArrow(run, "cell long, fp long")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(points: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough for every component; points has a column fp."""
    entered = enter(points, segments)
    met = keep(entered.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = met.where("n = 2").select("a", "b").where(_near("a", "b"))
    crowd = entered.join(met.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    fine = enter(crowd, 64)
    least = fine.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1")
    tied = fine.join(least, "cell").select("a", F.col("fp").alias("b")).where((F.col("a") != F.col("b")) & _near("a", "b"))
    return pairs.union(tied).distinct()


def classes(docs: DataFrame, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row per document."""
    prints = keep(fingerprint(docs, shingle))
    points = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = keep(links(points, segments))
    parts = components(found, "a", "b")
    # components are named by a fingerprint; rename them by their least document
    named = parts.join(points, parts.node == points.fp).select("component", "fp", "least")
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = named.join(name, "component").select("fp", "component_id")
    rows = keep(points.join(joined, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    met = with_facts(prints, rows, "fp", F.col("doc_id"))  # a crowd of copies has one fingerprint
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """The documents without those whose class has a smaller id; rows that repeat an id stay together.  A row
    with a null id stays: it can't be told from others of its class."""
    found = classes(docs, segments, shingle)
    own = free(docs, "gone")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")

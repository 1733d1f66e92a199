"""Operator 3 - substring dedup with fixed-block anchors.

Each document's aligned blocks of ``width // 2`` words are the reference; every rolling window of that many
words probes them.  Any ``width`` words hold a whole aligned block, so a repeat always shows as a probe that
hits a block elsewhere.  Hits are extended: positions whose probes repeat without a gap over a window, with an
anchor among them, are candidate windows, compared exactly by 96 bits over their whole word sequence.  A window
whose sequence starts earlier in the corpus is redundant; runs of redundant windows are the maximal repeats
that go.  Windows are judged on the input.

Defined results: null, empty and short texts have nothing removed; among rows that repeat an id, the order in
the store decides which is earlier, and rows with a null id come before all others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K
from .common import keep, release

WIDTH = 20


class Probes(NamedTuple):
    """The rolling windows of a batch that stay in their row: their positions and shortened hashes."""

    words: K.Words
    hashes: np.ndarray
    at: np.ndarray
    key: np.ndarray


def _probe(docs: X.Docs, block: int, bits: int) -> Probes:
    words = K.find_words(docs.text)
    hashes = K.hash_words(docs.text, words)
    at = np.flatnonzero(K.starts_in_row(words.row, block))
    return Probes(words, hashes, at, K.hash_windows(hashes, block)[at] >> K.U64(64 - bits))


def _runs(order: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.zeros(0, np.int64)


def _send_probes(block: int, bits: int, buckets: int):
    def send(batch: int, docs: X.Docs) -> list[tuple]:
        p = _probe(docs, block, bits)
        aligned = (p.at - np.repeat(p.words.row[:-1], np.diff(p.words.row))[p.at]) % block == 0
        order = np.sort((p.key << K.U64(1)) | aligned.astype(K.U64))
        first = _runs(order >> K.U64(1))
        last = np.append(first[1:], len(order)) - 1 if len(first) else first
        flags = ((last > first) * 2).astype(np.uint8) | (order[last] & K.U64(1)).astype(np.uint8)
        return X.route(batch, order[first] >> K.U64(1), buckets, flags, bits=bits)

    return send


def _match_probes(batches: list[int], sent: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """For each probe: whether its words occur more than once, and whether an aligned block is among them."""
    order = np.sort(np.concatenate([(k << K.U64(2)) | f.astype(K.U64) for k, f in sent]))
    first = _runs(order >> K.U64(2))
    flags = np.bitwise_or.reduceat(order & K.U64(3), first)
    twice = (np.diff(np.append(first, len(order))) > 1) | (flags >= 2)
    known, anchored = order[first][twice] >> K.U64(2), (flags[twice] & K.U64(1)) > 0
    out = []
    for keys, _ in sent:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        out.append(X.pack(hit.astype(np.uint8) + (hit & anchored[at] if len(known) else hit)))
    return out, []


class Candidates(NamedTuple):
    """Windows that may repeat, sorted by hash (then place); ``first`` are the first of each distinct window."""

    words: K.Words
    at: np.ndarray
    high: np.ndarray
    low: np.ndarray
    first: np.ndarray
    group: np.ndarray


def _candidates(docs: X.Docs, state: np.ndarray, width: int, bits: int) -> Candidates:
    """``state``: of each distinct probe in order, 0 single, 1 repeated, 2 repeated with an anchor."""
    block = width // 2
    p = _probe(docs, block, bits)
    total, order = int(p.words.row[-1]), np.sort(p.key)
    keys = order[_runs(order)]
    known, anchored = keys[state > 0], state[state > 0] == 2
    repeat, anchor = np.zeros(total, bool), np.zeros(total, bool)
    if len(known):
        place = np.minimum(np.searchsorted(known, p.key), len(known) - 1)
        hit = known[place] == p.key
        repeat[p.at], anchor[p.at] = hit, hit & anchored[place]
    starts = K.starts_in_row(p.words.row, width)
    span = width - block + 1  # probes within a window
    gaps, anchors = (np.concatenate(([0], np.cumsum(x))) for x in (~repeat, anchor))
    n = len(starts)
    at = np.flatnonzero(starts & (gaps[span : span + n] == gaps[:n]) & (anchors[span : span + n] > anchors[:n]))
    if not len(at):
        none = np.zeros(0, K.U64)
        return Candidates(p.words, at, none, none.astype(np.uint32), at, at)
    high = K.hash_windows(p.hashes, width)[at]
    low = (K.hash_windows(K.hash_words(docs.text, p.words, 1), width, 1)[at] >> K.U64(32)).astype(np.uint32)
    order = np.argsort(high, kind="stable")
    same = high[order][1:] == high[order][:-1]
    if (same & (low[order][1:] != low[order][:-1])).any():
        order = np.lexsort((at, low, high))
    at, high, low = at[order], high[order], low[order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    return Candidates(p.words, at, high, low, np.flatnonzero(new), np.cumsum(new) - 1)


def _send_windows(width: int, bits: int, buckets: int):
    def work(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        c = _candidates(docs, answers[0][0] if answers else np.zeros(0, np.uint8), width, bits)
        row = np.searchsorted(c.words.row, c.at[c.first], side="right") - 1
        ids, place = np.unique(docs.ids[row], return_inverse=True)
        # the ids travel once: places in the batch's list, whose own differences are small
        out = []
        for bucket, name, payload in X.route(batch, c.high[c.first], buckets, c.low[c.first], place.astype(np.uint32)):
            own, where = np.unique(X.unpack(payload)[2], return_inverse=True)
            high, low, _ = X.unpack(payload)
            out.append((bucket, name, X.pack(high, ids[own], low, where.astype(np.uint32), rising=2)))
        return X.rows(out)

    return work


def _match_windows(batches: list[int], sent: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """For each distinct window of a batch: whether the corpus has it first there."""
    size = [len(x[0]) for x in sent]
    source = np.repeat(np.arange(len(sent)), size)
    high, low = (np.concatenate([x[k] for x in sent]) for k in (0, 2))
    ids = np.concatenate([x[1][x[3]] for x in sent])
    order = np.lexsort((source, ids, low, high))
    new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
    wins = np.zeros(len(order), np.uint8)
    wins[order[new]] = 1
    return [X.pack(x) for x in np.split(wins, np.cumsum(size)[:-1])], []


def _remove(width: int, bits: int):
    def work(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        c = _candidates(docs, answers[0][0] if answers else np.zeros(0, np.uint8), width, bits)
        total = int(c.words.row[-1])
        gone = np.zeros(total, bool)
        if len(c.at):
            redundant = np.ones(len(c.at), bool)
            redundant[c.first] = answers[1][0] == 0
            gone = K.covered(c.at[redundant], width, total)
        n, removed = np.diff(c.words.row), K.per_row(gone, c.words.row)
        sha, spans = [], []
        for k, data in enumerate(K.rows_of(docs.text)):
            words = data.split()
            if removed[k]:
                own = gone[c.words.row[k] : c.words.row[k + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                words = [w for w, x in zip(words, own.tolist(), strict=True) if not x]
            else:
                spans.append([])
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([docs.id_column(), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, span)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return work


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges): a row per document."""
    sizes = X.plan(docs)
    # probes only nominate: their hashes are as long as keeps false nominations under one in 65,536
    bits = min(62, max(40, sizes.words.bit_length() + 16))
    stored = X.store(docs, sizes.batch_bytes)
    state = keep(X.meet(X.first_pass(stored, _send_probes(width // 2, bits, sizes.buckets)), _match_probes))
    release(docs.sparkSession)
    sent = X.later_pass(stored, [state], _send_windows(width, bits, sizes.buckets), X.ROW)
    wins = X.meet(sent, _match_windows)
    return X.later_pass(stored, [state, wins], _remove(width, bits), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")

"""Array kernels shared by the operators: Arrow text in, NumPy arrays out, no Python object per word.

A batch of texts is one byte buffer with row offsets.  Words are spans of that buffer; a word's hash is a
polynomial over its bytes read off one running sum, so hashing costs a few vector operations per byte.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bases of the two byte polynomials and of the two window polynomials: arbitrary odd 64-bit numbers.
BYTE_BASE = (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F)
WORD_BASE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 512 << 10
#: Bytes of text whose words are hashed at a time.
HASH_BYTES = 64 << 10

_ascii = np.arange(256)
#: Space and the five ASCII controls from tab to carriage return.
SPACE = (_ascii == 0x20) | ((_ascii >= 0x09) & (_ascii <= 0x0D))
#: ASCII bytes that are neither letters nor digits.
NON_ALNUM = (_ascii < 0x80) & ~np.isin(_ascii, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: Lower-cases A-Z and leaves the other bytes.
LOWER = np.where((_ascii >= 0x41) & (_ascii <= 0x5A), _ascii + 0x20, _ascii).astype(np.uint8)


class Text(NamedTuple):
    buf: np.ndarray  # uint8
    offs: np.ndarray  # int64, rows + 1


class Words(NamedTuple):
    start: np.ndarray  # byte position in buf
    end: np.ndarray
    row: np.ndarray  # int64, rows + 1: first word of each row


def text_of(column: pa.Array) -> Text:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Text(buf[offs[0] : offs[-1]], offs - offs[0])


def rows_of(text: Text) -> list[bytes]:
    data, offs = text.buf.tobytes(), text.offs.tolist()
    return [data[a:b] for a, b in zip(offs, offs[1:], strict=False)]


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``size`` bytes of text."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = (np.cumsum(length) - length) // size
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(length)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def find_words(text: Text, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not separators, never across rows."""
    buf, offs = text
    if not len(buf):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    # comparisons are faster than the table
    inside = (buf != 0x20) & ((buf - np.uint8(0x09)) > 4) if separator is SPACE else ~separator[buf]
    turn = np.empty(len(buf) + 1, bool)
    turn[0], turn[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=turn[1:-1])
    edge = np.flatnonzero(turn)
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    cut = np.unique(cut[inside[cut - 1] & inside[cut]])  # rows that end within a run
    if len(cut):
        edge = np.insert(edge, np.repeat(np.searchsorted(edge, cut), 2), np.repeat(cut, 2))
    start, end = edge[::2].copy(), edge[1::2].copy()
    return Words(start, end, np.searchsorted(start, offs))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (a multiply and xor-shift finaliser)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        n = max(n, STEP_BYTES + (STEP_BYTES >> 2))

        def table(b: int) -> np.ndarray:
            out = np.empty(n, U64)
            out[0], filled, step = 1, 1, b
            while filled < n:  # doubling: out[k:2k] = out[:k] * b**k
                take = min(filled, n - filled)
                out[filled : filled + take] = out[:take] * U64(step)
                filled, step = filled + take, step * step % (1 << 64)
            return out

        known = table(base), table(pow(base, -1, 1 << 64))
        if n <= STEP_BYTES * 8:
            _powers[base] = known
    return known


def _hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    n = len(buf)
    up, down = _power_tables(BYTE_BASE[which], n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    value = np.add(buf, 1, dtype=U64)
    value *= up[:n]
    np.cumsum(value, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def hash_words(text: Text, words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``which`` picks one of two independent functions.  Works on as much text at a
    time as stays in a core's cache, whatever the size of the batch."""
    if len(text.buf) <= 2 * HASH_BYTES:
        return _hash_spans(text.buf, words.start, words.end, which) if len(words.start) else np.zeros(0, U64)
    cuts = np.unique(np.append(np.searchsorted(words.start, np.arange(0, len(text.buf), HASH_BYTES)), len(words.start))).tolist()
    out = [np.zeros(0, U64)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, high = words.start[a], words.end[b - 1]
        out.append(_hash_spans(text.buf[low:high], words.start[a:b] - low, words.end[a:b] - low, which))
    return np.concatenate(out)


def hash_windows(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` neighbouring hashes, by doubling; windows cross rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, done, have = WORD_BASE[which], None, 0
    power, span = hashes, 1
    while True:
        if width & span:
            if done is None:
                done, have = power, span
            else:  # what is done comes after the new span
                m = min(len(power), len(done) - span)
                done = power[:m] * U64(pow(base, have, 1 << 64)) + done[span : span + m]
                have += span
        if span * 2 > width:
            break
        m = len(power) - span
        power = power[:m] * U64(pow(base, span, 1 << 64)) + power[span : span + m]
        span *= 2
    return mix(done[:n] + U64(width))


def starts_in_row(row: np.ndarray, width: int) -> np.ndarray:
    """For each word position up to the last that can start a window: whether the window stays in its row."""
    total = int(row[-1])
    ok = np.zeros(max(total - width + 1, 0), bool)
    if len(ok):
        room = np.maximum(np.diff(row) - width + 1, 0)
        mark = np.zeros(total + 1, np.int64)
        full = room > 0
        np.add.at(mark, row[:-1][full], 1)
        np.add.at(mark, row[:-1][full] + room[full], -1)
        ok[:] = np.cumsum(mark)[: len(ok)] > 0
    return ok


def covered(starts: np.ndarray, width: np.ndarray | int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a window that begins at one of ``starts``."""
    mark = np.bincount(starts, minlength=total + 1)[: total + 1].astype(np.int64)
    ends = np.minimum(starts + width, total)
    mark -= np.bincount(ends, minlength=total + 1)[: total + 1]
    return np.cumsum(mark)[:total] > 0


def per_row(flags: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over each row's span."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[row[1:]] - total[row[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once.  One plain sort; the few repeated values are looked up again."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def row_ids(row: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(row) - 1), np.diff(row))

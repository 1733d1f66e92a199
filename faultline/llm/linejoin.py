"""Operator 5 - line dedup by an exact set-similarity join.

A line is the set of its words.  Equal sets are one class, whose place is its first line in the corpus.  Words
are ordered by rarity, taken from a sketch of corpus counts of fixed size, then by hash, so all lines agree.
Two sets of Jaccard similarity t or more share a word among their first n - ceil(t n) + 1: those words are sent
with the set's size, the word's place, a sketch of the set and the class's place.  Where they meet, the length
filter, the positional filter and the sketch leave few pairs, whose sets then meet and are compared in full.

A line goes if an earlier line matches it (lines are judged on the input).  For that one match is enough: each
class first tries early candidates of its size, ``TRIES`` per word, and only classes that had more and matched none
try all the rest; so a crowd of similar lines costs rows in proportion to its members.  For that second round only
words in the slots of the undecided classes' prefixes are sent again.  Pairs name lines by their number in the
batch, so that comparing them reads the words of those lines alone.  A batch's text is cut into words twice: for the
counts, and for the sets.  The second time notes where each class's prefix words are, and the sketches; what is sent
later needs the hashes of those words alone.

Lines without words are kept and match nothing.  Null and empty texts have no lines that match.  Rows that
repeat an id follow the order of the store; rows with a null id come first.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import keep, release
from .substring import _match_windows

#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
#: Slots of the sketch of word counts, whatever the corpus, and parts in which it is summed.
SLOTS, PARTS, TRIES = 1 << 18, 16, 4
#: Groups of batches in which the sketch is summed before the groups are.
GROUPS = 512
#: Pairs that are tried at a time.
STEP = 1 << 14
#: Words of a sketch (a power of two), and the size over which a set uses them all.
SKETCH, WIDE = 4, 96


class Lines(NamedTuple):
    """A batch's lines that have words; tokens are their distinct words' hashes, line after line."""

    row: np.ndarray  # document of each line
    at: np.ndarray  # its number in the batch
    first: np.ndarray  # lines + 1, into tokens
    tokens: np.ndarray
    key: np.ndarray  # hash of the set
    low: np.ndarray


def _line_words(docs: X.Docs) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, their line (of all lines of the batch), and where the documents' lines begin."""
    words = K.find_words(docs.text)
    breaks = np.flatnonzero(docs.text.buf == 0x0A)
    row = K.row_ids(words.row)
    between = np.diff(np.searchsorted(words.start, breaks), prepend=0, append=len(row))
    line = np.repeat(np.arange(len(breaks) + 1), between) + row  # a document ends its last line
    return words, K.hash_words(docs.text, words), line, _begin(docs, breaks)


def _begin(docs: X.Docs, breaks: np.ndarray) -> np.ndarray:
    """Each document's first line, among all lines of the batch."""
    return np.searchsorted(breaks, docs.text.offs[:-1]) + np.arange(len(docs.ids))


def _distinct(line: np.ndarray, hashes: np.ndarray, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines and their distinct tokens, by line, rarity class (where given) and hash, and a word that has the token.
    Lines rise; they are sorted some ten thousand words at a time."""
    if not len(line):
        return line, hashes, np.zeros(0, np.int64)
    out = []
    cuts = np.unique(np.append(np.searchsorted(line, line[:: 1 << 16]), len(line))).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        own, token = (line[a:b] - line[a]).astype(K.U64), hashes[a:b]
        # one sort of values: line, rank, leading hash bits, word
        inner = max(b - a - 1, 1).bit_length()
        room = 64 - inner - int(own[-1]).bit_length()
        if rarity is None:
            body = token >> K.U64(64 - room)
        else:
            rank = rarity[_slot(token)].astype(K.U64)
            body = (rank << K.U64(room - 12)) | (token >> K.U64(76 - room))
        tight = (own << K.U64((room + inner) % 64)) | (body << K.U64(inner)) | np.arange(b - a, dtype=K.U64)
        tight.sort()
        order = (tight & K.U64((1 << inner) - 1)).astype(np.int64)
        tight >>= K.U64(inner)
        found = token[order]
        tie = (tight[1:] == tight[:-1]) & (found[1:] != found[:-1])
        if tie.any():  # lines with a tie between different words are sorted in full
            at = np.flatnonzero(np.isin(own[order], own[order[1:][tie]]))
            again = order[at]
            order[at] = again[np.lexsort((token[again], own[again]) if rarity is None else (token[again], rank[again], own[again]))]
            found = token[order]
        own = own[order]
        new = np.append(True, (own[1:] != own[:-1]) | (found[1:] != found[:-1]))
        out.append((own[new].astype(np.int64) + line[a], found[new], order[new] + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> K.U64(46)).astype(np.int64)


def _lines(docs: X.Docs, rarity: np.ndarray) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The batch's lines, their tokens in the order of rarity and hash, and where a word of each token begins and ends."""
    words, hashes, line, begin = _line_words(docs)
    line, hashes, which = _distinct(line, hashes, rarity)
    head = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    own = line[head]
    row = np.searchsorted(begin, own, side="right") - 1
    if not len(head):
        return Lines(row, own, np.zeros(1, np.int64), hashes, hashes, hashes.astype(np.uint32)), which, which
    size = np.diff(np.append(head, len(line)))
    # tokens are mixed already; sums of them and of their products with what they are shifted by are independent
    total = np.add.reduceat(hashes, head)
    other = np.add.reduceat(hashes * (hashes >> K.U64(29)), head)
    return Lines(row, own, np.append(head, len(line)), hashes, K.mix(total + size.astype(K.U64)), (K.mix(other) >> K.U64(32)).astype(np.uint32)), words.start[which], words.end[which]


def _line_spans(docs: X.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line of the batch begins and ends, and each document's first line."""
    breaks, offs = np.flatnonzero(docs.text.buf == 0x0A), docs.text.offs
    begin = _begin(docs, breaks)
    lines = len(breaks) + len(docs.ids)
    start, end = np.empty(lines, np.int64), np.empty(lines, np.int64)
    inner = np.ones(lines, bool)
    inner[begin] = False
    start[begin], start[inner] = offs[:-1], breaks + 1
    last = np.append(begin[1:], lines) - 1
    inner[:] = True
    inner[last] = False
    end[last], end[inner] = offs[1:], breaks
    return start, end, begin


def _sets(docs: X.Docs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lines by their rising numbers in the batch: where their tokens begin (lines + 1), and these tokens by hash.
    Reads these lines only; each has a word."""
    start, end, _ = _line_spans(docs)
    text = _cut_out(docs.text.buf, start[at], (end - start)[at])
    words = K.find_words(text)
    line, tokens, _ = _distinct(K.row_ids(words.row), K.hash_words(text, words), None)
    return np.searchsorted(line, np.arange(len(at) + 1)), tokens


def _cut_out(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> K.Text:
    """Pieces of a buffer, one after another."""
    cut = np.append(0, np.cumsum(size, dtype=np.int64))
    return K.Text(buf[np.repeat(start - cut[:-1], size) + np.arange(int(cut[-1]))], cut)


def _prefix(n: np.ndarray) -> np.ndarray:
    """How many of a set's rarest words are sent."""
    return n - (NUM * n + DEN - 1) // DEN + 1


class Classes(NamedTuple):
    """The distinct sets of a batch, sorted by hash: their first line, and each line's class."""

    first: np.ndarray
    of: np.ndarray


def _classes(lines: Lines) -> Classes:
    n = len(lines.key)
    order = np.lexsort((np.arange(n), lines.low, lines.key))
    key, low = lines.key[order], lines.low[order]
    new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])) if n else np.zeros(0, bool)
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(new) - 1
    return Classes(order[new], of)


def _send_counts(batch: int, docs: X.Docs) -> list[tuple]:
    words = K.find_words(docs.text)
    count = np.bincount(_slot(K.hash_words(docs.text, words)), minlength=SLOTS)
    return [(k, batch, X.pack(x)) for k, x in enumerate(np.split(count, PARTS))]


def _sum_slots(table: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS // PARTS, np.int64)
    for x in table.column("payload"):
        total += X.unpack(x.as_py())[0]
    return pa.Table.from_batches([X.rows([(table.column("bucket")[0].as_py(), table.column("batch")[0].as_py(), X.pack(total))])])


def _slots(sent: DataFrame) -> np.ndarray:
    """Sums of the slots over all batches, first within groups of batches; collected in PARTS rows of fixed size."""
    groups = sent.withColumn("batch", F.pmod(F.xxhash64("batch"), F.lit(GROUPS))).groupBy("bucket", "batch").applyInArrow(_sum_slots, X.ROW)
    summed = groups.groupBy("bucket").applyInArrow(_sum_slots, X.ROW).collect()
    by_part = {r.bucket: X.unpack(bytes(r.payload))[0] for r in summed}
    return np.concatenate([by_part.get(k, np.zeros(SLOTS // PARTS, np.int64)) for k in range(PARTS)])


def rarity_classes(stored: DataFrame) -> np.ndarray:
    """For each slot a 12-bit class that grows with the count: two bytes a slot."""
    count = _slots(X.first_pass(stored, _send_counts))
    return np.minimum(np.log2(1.0 + count) * 100, 4095).astype(np.uint16)


def _send_wanted(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Marks the slots of the prefix words of undecided classes."""
    if len(answers) < 4 or not answers[3]:
        return X.rows([])
    known = _known(docs, answers)
    marked = np.zeros(SLOTS, np.uint8)
    marked[_slot(known.tokens[np.isin(known.at, answers[3][0])[known.each]])] = 1
    return X.rows([(k, batch, X.pack(x)) for k, x in enumerate(np.split(marked, PARTS))])


#: The buckets of the rows by which a batch tells itself its lines and their classes, and the classes' prefixes.
INDEX, PREFIX = -1, -2


def _send_sets(rarity: np.ndarray, buckets: int):
    """The distinct sets to their buckets; the batch's index: each line's number, its class, first lines; and of the
    first lines of sets that can match others, in order: where in the line each prefix word is, and the sketches."""

    def send(batch: int, docs: X.Docs) -> list[tuple]:
        lines, start, end = _lines(docs, rarity)
        classes = _classes(lines)
        first, n = classes.first, np.diff(lines.first)
        out: list[tuple] = [(INDEX, batch, X.pack(lines.at, classes.of, first, n, rising=1))] if len(first) else []
        own = _joined(first, n)
        if len(own):
            size = _prefix(n[own])
            each = np.repeat(np.arange(len(own)), size)
            token = lines.first[own][each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            length, tokens = _gather(lines.first, lines.tokens, own)
            head = np.append(0, np.cumsum(length))
            marks = _sketches(head, tokens)
            wide = length > WIDE
            inside = start[token] - _line_spans(docs)[0][lines.at[own]][each]
            out.append((PREFIX, batch, X.pack(inside.astype(np.uint32), (end - start)[token].astype(np.uint32), marks[0], *(m[wide] for m in marks[1:]))))
        high, low, ids = lines.key[first], lines.low[first], docs.ids[lines.row[first]]
        for bucket, s in X.spans(high, buckets):
            used, where = np.unique(ids[s], return_inverse=True)
            out.append((bucket, batch, X.pack(high[s], used, low[s], where.astype(np.uint32), rising=2)))
        return out

    return send


class Index(NamedTuple):
    """A batch's lines that have words, as its first pass found them."""

    at: np.ndarray  # each line's number in the batch
    of: np.ndarray  # its class
    first: np.ndarray  # first line of each class
    size: np.ndarray  # each line's distinct words


def _joined(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lines that stand for a class whose set can match other ones than equals, in order."""
    own = np.sort(first)
    return own[size[own] >= NUM // (DEN - NUM)]


class Known(NamedTuple):
    """The owned classes that can match others, by their first lines, and their prefix words."""

    at: np.ndarray  # the line's number in the batch
    ids: np.ndarray  # its document
    size: np.ndarray
    marks: list[np.ndarray]
    each: np.ndarray  # of each prefix word: its class, counted as above
    place: np.ndarray
    tokens: np.ndarray


def _known(docs: X.Docs, answers: list[list[np.ndarray]]) -> Known:
    """From the owners, the index and the prefixes: only the prefix words are hashed again."""
    index, owned = _index(answers)
    if len(answers) < 3 or not answers[2]:
        none = np.zeros(0, np.int64)
        return Known(none, none, none, [none.astype(K.U64)] * SKETCH, none, none, none.astype(K.U64))
    here = np.zeros(len(index.at), bool)
    here[index.first[owned]] = True
    own = _joined(index.first, index.size)
    inside, length, *marks = answers[2]
    n = index.size[own].astype(np.int64)
    marks = [marks[0], *(_spread(m, n > WIDE) for m in marks[1:])]
    size = _prefix(n)
    each = np.repeat(np.arange(len(own)), size)
    place = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    use = here[own]
    start, _, begin = _line_spans(docs)
    at = index.at[own]
    start = start[at][each] + inside
    ids = docs.ids[np.searchsorted(begin, at, side="right") - 1]
    word = use[each]
    text = _cut_out(docs.text.buf, start[word], length[word].astype(np.int64))
    tokens = K.hash_words(text, K.Words(text.offs[:-1], text.offs[1:], text.offs))
    return Known(at[use], ids[use], n[use], [m[use] for m in marks], (np.cumsum(use) - 1)[each[word]], place[word], tokens)


def _index(answers: list[list[np.ndarray]]) -> tuple[Index, np.ndarray]:
    """The index, and the classes whose first line in the corpus is in this batch."""
    if len(answers) < 2 or not answers[1]:
        return Index(*(np.zeros(0, np.int64) for _ in Index._fields)), np.zeros(0, np.int64)
    return Index(*answers[1]), np.flatnonzero(answers[0][0])


def _rows(docs: X.Docs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of lines by their numbers in the batch, and their numbers in the documents."""
    begin = _begin(docs, np.flatnonzero(docs.text.buf == 0x0A))
    row = np.searchsorted(begin, at, side="right") - 1
    return row, at - begin[row]


def _sketches(first: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Parity sketches, as SKETCH words: each token flips one bit, so two sets differ in at least as many tokens as
    their sketches in bits, however large they are.  Sets over WIDE tokens use all words, others only the first."""
    if not len(tokens):
        return [np.zeros(0, K.U64)] * SKETCH
    bit = K.U64(1) << (tokens & K.U64(63))
    wide = np.flatnonzero(np.diff(first) > WIDE)
    out = [np.bitwise_xor.reduceat(bit, first[:-1]), *(np.zeros(len(first) - 1, K.U64) for _ in range(SKETCH - 1))]
    if len(wide):
        size, own = _gather(first, tokens, wide)
        _, flips = _gather(first, bit, wide)
        word, head = (own >> K.U64(6)) & K.U64(SKETCH - 1), np.cumsum(size) - size
        for k in range(SKETCH):
            out[k][wide] = np.bitwise_xor.reduceat(np.where(word == k, flips, K.U64(0)), head)
    return out


def _spread(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The values at their places, zero elsewhere."""
    out = np.zeros(len(where), x.dtype)
    out[where] = x
    return out


def _differ(a: list[np.ndarray], b: list[np.ndarray], wide: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ, folded to one word unless both are wide."""
    full = sum(np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(a, b, strict=True))
    fold = np.bitwise_count(np.bitwise_xor.reduce(a) ^ np.bitwise_xor.reduce(b)).astype(np.int64)
    return np.where(wide, full, fold)


def _send_prefixes(buckets: int, wanted: np.ndarray | None = None):
    """(word; documents, line, size, place, document, whether to try, sketch) for the prefix words of owned classes,
    each named by its first line; with ``wanted``, for the words in its slots."""

    def work(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        own, ids, n, marks, each, place, token = _known(docs, answers)
        tries = np.ones(len(own), np.uint8)
        if wanted is not None:  # a later round: only what is undecided tries
            tries = np.isin(own, answers[3][0] if len(answers) > 3 and answers[3] else []).astype(np.uint8)
            use = wanted[_slot(token)]
            each, place, token = each[use], place[use], token[use]
        order = np.argsort(token)
        at = each[order]
        token, ids = token[order], ids[at]
        carried = [own[at].astype(np.uint32), n[at].astype(np.uint32), place[order].astype(np.uint32), tries[at], *(m[at] for m in marks)]
        out = []
        for bucket, s in X.spans(token, buckets):
            used, where = np.unique(ids[s], return_inverse=True)
            line, size, place, tried, *marks = (x[s] for x in carried)
            wide = size > WIDE  # others have only the first word of the sketch
            out.append((bucket, batch, X.pack(token[s], used, line, size, place, where.astype(np.uint32), tried, marks[0], *(m[wide] for m in marks[1:]), rising=2)))
        return X.rows(out)

    return work


def _order(*keys: np.ndarray) -> np.ndarray:
    """Sorts by several keys of small numbers, the first one first: by one sort where they fit into a word."""
    bits = [int(x.max(initial=0)).bit_length() for x in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    tight = np.zeros(len(keys[0]), np.int64)
    for x, n in zip(keys, bits, strict=True):
        tight = (tight << n) | x.astype(np.int64)
    return np.argsort(tight)


def _size_class(n: np.ndarray) -> np.ndarray:
    """A class of each size, from 1; sets whose classes are not neighbours are too unlike in size to match."""
    starts = [1]
    while starts[-1] <= int(n.max(initial=0)):
        starts.append(starts[-1] * DEN // NUM + 1)
    return np.searchsorted(starts, n, side="right")


def _pair_up(skip: int, most: int):
    """For each batch: (line, batch of the earlier line, that line), and the lines that had more than ``most``."""

    def answer(batches: list[int], sent: list[list[np.ndarray]]) -> tuple[list[bytes | None], list[int]]:
        size = [len(x[0]) for x in sent]
        source = np.repeat(np.arange(len(sent)), size)
        key = np.concatenate([x[0] for x in sent])
        order = np.argsort(key, kind="stable")
        # most words are in one line only, and go no further
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)] if len(key) else order
        if not len(order):
            return [None] * len(batches), []
        ids = np.concatenate([x[1][x[5]] for x in sent])[order]
        line, n, place, tries, *bits = (np.concatenate([x[k] for x in sent]) for k in (2, 3, 4, 6, *range(7, 7 + SKETCH)))
        bits = [bits[0], *(_spread(m, n > WIDE) for m in bits[1:])]
        source, key, line, n, place, tries, *bits = (x[order] for x in (source, key, line, n, place, tries, *bits))
        # a word's lines by class of size, and in these in the order of the corpus
        rank, kind, total = np.empty(len(key), np.int64), _size_class(n), len(key)
        rank[_order(np.unique(ids, return_inverse=True)[1], source, line)] = np.arange(total)
        order = _order(np.cumsum(np.append(False, key[1:] != key[:-1])), kind, rank)
        source, key, line, n, place, tries, kind, rank, *bits = (x[order] for x in (source, key, line, n.astype(np.int64), place.astype(np.int64), tries, kind, rank, *bits))
        room = n - place
        new = np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        at = group * total + rank
        passed = np.zeros(total, np.int64)
        found = []
        trying = np.flatnonzero(tries > 0)
        for step in (0, -1, 1):  # a set that can match is of the same class of size or the next one
            there = np.clip(group[trying] + step, 0, len(head) - 1)
            near = (key[head[there]] == key[trying]) & (kind[head[there]] == kind[trying] + step)
            active, there = trying[near], there[near]
            start = head[there]
            count = np.searchsorted(at, there * total + rank[active]) - start
            k = 0
            while True:
                live = (count > k) & (passed[active] <= skip + most)
                active, start, count = active[live], start[live], count[live]
                if not len(active):
                    break
                # the next candidates of each: one, or more where few lines are left
                width = np.minimum(count - k, max(1, STEP // len(active)))
                y = np.repeat(active, width)
                x = np.arange(len(y)) + np.repeat(start + k - (np.cumsum(width) - width), width)
                need = -(-NUM * (n[x] + n[y]) // (NUM + DEN))
                # at the first word that two sets share, all that they share is still to come in both
                maybe = np.flatnonzero(np.minimum(room[x], room[y]) >= need)
                u, v = x[maybe], y[maybe]
                good = n[u] + n[v] - _differ([w[u] for w in bits], [w[v] for w in bits], np.minimum(n[u], n[v]) > WIDE) >= 2 * need[maybe]
                u, v = u[good], v[good]
                nth = passed[v] + np.arange(len(v)) - np.searchsorted(v, v) + 1
                take = (nth > skip) & (nth <= skip + most)
                found.append((v[take], u[take]))
                last = np.append(v[1:] != v[:-1], True)[: len(v)]
                passed[v[last]] = nth[last]
                k += max(1, STEP // len(active))
        y, x = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), ())))
        more = np.flatnonzero(passed > skip + most)
        by = np.argsort(source[y], kind="stable")
        y, x, more = y[by], x[by], more[np.argsort(source[more], kind="stable")]
        edges = np.arange(len(batches) + 1)
        cut, cut_more = (np.searchsorted(source[z], edges).tolist() for z in (y, more))
        out: list[bytes | None] = []
        for b in range(len(batches)):
            mine = slice(cut[b], cut[b + 1])
            pair = np.unique(np.column_stack((line[y[mine]], np.array(batches, np.int64)[source[x[mine]]], line[x[mine]])).astype(np.int64), axis=0) if cut[b + 1] > cut[b] else np.zeros((0, 3), np.int64)
            extra = np.unique(line[more[cut_more[b] : cut_more[b + 1]]]).astype(np.int64)
            out.append(X.pack(pair[:, 0].copy(), pair[:, 1].copy(), pair[:, 2].copy(), extra) if len(pair) or len(extra) else None)
        return out, []

    return answer


def _gather(first: np.ndarray, tokens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and tokens of sets, one after another."""
    size = np.diff(first)[which]
    run = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return size, tokens[np.repeat(first[which], size) + run]


def _ship(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The later set of each pair, to the batch of the earlier one; a line that several buckets paired goes once."""
    if not answers or not answers[0] or not len(answers[0][0]):
        return X.rows([])
    pairs = np.unique(np.column_stack(answers[0][:3]), axis=0)
    known = np.unique(pairs[:, 0])
    first, tokens = _sets(docs, known)
    out = []
    for other in np.unique(pairs[:, 1]).tolist():
        mine = pairs[pairs[:, 1] == other]
        own = np.unique(mine[:, 0])
        size, sets = _gather(first, tokens, np.searchsorted(known, own))
        # a set goes once however many sets there it is to be compared with
        out.append((batch % (1 << 31), other, X.pack(mine[:, 2].copy(), mine[:, 0].copy(), np.full(len(mine), batch, np.int64), own, np.full(len(own), batch, np.int64), size, sets)))
    return X.rows(out)


def _verify(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Compares in full; tells the later line's batch which of its lines have a match."""
    if not answers or not answers[0]:
        return X.rows([])
    earlier, later, source, own, origin, size, tokens = answers[0]
    here = np.unique(earlier)
    begin, held = _sets(docs, here)
    earlier = np.searchsorted(here, earlier)
    known = np.unique(origin)
    key = lambda where, line: (np.searchsorted(known, where) << 32) | line
    order = np.argsort(key(origin, own))
    place = order[np.searchsorted(key(origin, own)[order], key(source, later))]
    first, ok = np.append(0, np.cumsum(size)), np.zeros(len(earlier), bool)
    for a in range(0, len(earlier), 8192):  # some thousand pairs at a time
        have, mine = _gather(begin, held, earlier[a : a + 8192])
        n, theirs = _gather(first, tokens, place[a : a + 8192])
        pair = np.concatenate((np.repeat(np.arange(len(n)), have), np.repeat(np.arange(len(n)), n)))
        both = K.mix(np.concatenate((mine, theirs)) + pair.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
        both = both[order := np.argsort(both)]
        shared = np.bincount(pair[order][1:][both[1:] == both[:-1]], minlength=len(n))
        ok[a : a + 8192] = shared * (NUM + DEN) >= NUM * (have + n)
    return X.rows([(batch % (1 << 31), b, X.pack(np.unique(later[ok & (source == b)]))) for b in np.unique(source[ok]).tolist()])


def _unsettled(table: pa.Table) -> pa.Table:
    said = X.answers_of(table)
    more = np.unique(said[0][3]) if said and said[0] else np.zeros(0, np.int64)
    matched = said[1][0] if len(said) > 1 else np.zeros(0, np.int64)
    left = more[~np.isin(more, matched)]
    return pa.Table.from_batches([X.rows([(0, table.column("batch")[0].as_py(), X.pack(left))] if len(left) else [])])


def _finish(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
    index, own = _index(answers)
    owned = np.zeros(len(index.first), bool)
    owned[own] = True
    if len(answers) > 2 and answers[2]:
        owned[index.of[np.searchsorted(index.at, answers[2][0])]] = False
    gone = np.ones(len(index.at), bool)
    gone[index.first[owned]] = False
    row, number = _rows(docs, index.at)
    n = np.bincount(row, minlength=len(docs.ids))
    removed = np.bincount(row[gone], minlength=len(docs.ids))
    cut = np.searchsorted(row, np.arange(len(docs.ids) + 1))
    sha, numbers = [], []
    for k, data in enumerate(K.rows_of(docs.text)):
        drop = number[cut[k] : cut[k + 1]][gone[cut[k] : cut[k + 1]]].tolist()
        numbers.append(drop)
        if drop:
            lost = set(drop)
            data = b"\n".join(x for j, x in enumerate(data.split(b"\n")) if j not in lost)
        sha.append(hashlib.sha256(data).hexdigest())
    return pa.RecordBatch.from_arrays([docs.id_column(), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(numbers, pa.list_(pa.int64()))], ["doc_id", "n_lines", "n_removed", "kept_sha256", "removed"])


def remove_similar_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, kept_sha256, removed (line numbers from 0): a row per document."""
    sizes = X.plan(docs)
    stored = X.store(docs, sizes.batch_bytes)
    rarity = rarity_classes(stored)
    sets = keep(X.first_pass(stored, _send_sets(rarity, sizes.buckets)))
    owners = keep(X.meet(sets.where(F.col("bucket") >= 0), _match_windows))
    index, prefixes = (sets.where(F.col("bucket") == k) for k in (INDEX, PREFIX))
    release(docs.sparkSession)

    def round_(skip: int, most: int, undecided: list[DataFrame], wanted: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
        sent = X.later_pass(stored, [owners, index, prefixes, *undecided], _send_prefixes(sizes.buckets, wanted), X.ROW)
        pairs = keep(X.meet(sent, _pair_up(skip, most)).where("payload is not null"))
        release(docs.sparkSession)
        return pairs, keep(X.later_pass(stored, [X.later_pass(stored, [pairs], _ship, X.ROW)], _verify, X.ROW))

    pairs, matched = round_(0, TRIES, [])
    both = pairs.select(F.lit(0).alias("kind"), "batch", "bucket", "payload").union(matched.select(F.lit(1).alias("kind"), "batch", "bucket", "payload"))
    left = keep(both.groupBy("batch").applyInArrow(_unsettled, X.ROW))
    if not left.isEmpty():
        wanted = _slots(X.later_pass(stored, [owners, index, prefixes, left], _send_wanted, X.ROW)) > 0
        matched = matched.union(round_(TRIES, 1 << 60, [left], wanted)[1])
    return X.later_pass(stored, [owners, index, matched], _finish, "doc_id long, n_lines long, n_removed long, kept_sha256 string, removed array<long>")

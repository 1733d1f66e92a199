"""Operator 9 - a Katz backoff language model.

Training texts give n-gram counts of orders 1 to ``order``.  Counts up to a limit are discounted by Good-Turing, and
what that frees goes to the lower order through a backoff weight that makes each history's probabilities sum to one:
the freed mass over the lower order's mass of words not seen after the history.  Unigrams free their mass for one
unknown type.  A history of whose counts none is discounted has its total raised by one, so that something is always
free.  Probabilities are evaluated recursively: the n-gram's own if it was seen, else weight times the next lower order.

The count tables are partitioned by hash and stay in the shared folder (``exchange``); batches of documents get the
counts and weights of their own tokens.  Every number comes from all training texts.  ``fit`` writes the model as
tables (a probability per n-gram, a weight per history) with which ``score_with`` scores any other texts.

Keys of n-grams have 64 bits and as many more, up to 32, as the corpus needs for one collision in a thousand corpora
of its size; words are told apart by 64 bits.

Defined results: a null, empty or blank text is one end token.  A document whose id is null is a training document.
With no training text every token is unknown, with probability one.  Rows that repeat an id are documents of their own.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import keep, release

#: Counts above this are taken as they are.
K_MAX = 5
ORDER = 2
#: Folds, and the fold that is held out.
FOLDS, HELD_OUT = 5, 1
#: Hashes of the end of a text and of what stands before its first word.
END, START = K.U64(0x452821E638D01377), K.U64(0xBE5466CF34E90C6C)
_NEXT, _MORE = K.U64(0xC0AC29B7C97C50DD), K.U64(0x9216D5D98979FB1B)


class Discounts(NamedTuple):
    """What counts 1, 2, ... are multiplied by; larger counts are kept."""

    factor: tuple[float, ...]

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.factor, 1.0])[np.minimum(count, len(self.factor) + 1)]


def _turing(n: dict[int, float], most: int) -> list[float]:
    """Katz's factors of counts 1 to most from how many types occur 1, 2, ... most + 1 times."""
    common = (most + 1) * n[most + 1] / n[1]
    return [((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if common < 1 and n[c] else -1.0 for c in range(1, most + 1)]


def discounts(types: list[int], most: int = K_MAX) -> Discounts:
    """Good-Turing factors from how many types occur 1, 2, ... most + 1 times.

    Katz's factors hold for a limit at which all of them lie in (0, 1): the largest limit up to ``most`` that has
    this is taken.  If none has, the counts of counts are first put on a line in logarithms (Gale and Sampson's
    linear Good-Turing).  With no type that occurs once nothing is discounted."""
    n = dict(enumerate(types, 1))
    if not n[1]:
        return Discounts(())
    for limit in range(most, 1, -1):
        found = _turing(n, limit)
        if all(0 < f < 1 for f in found):
            return Discounts(tuple(found))
    points = [(math.log(c), math.log(k)) for c, k in n.items() if k]
    mx, my = (sum(p[j] for p in points) / len(points) for j in (0, 1))
    spread = sum((x - mx) ** 2 for x, _ in points)
    slope = sum((x - mx) * (y - my) for x, y in points) / spread if spread else -2.0
    slope = min(slope, -1.1)  # a line that falls more slowly would not discount
    return Discounts(tuple((c + 1) / c * ((c + 1) / c) ** slope for c in range(1, most + 1)))


class Unigrams(NamedTuple):
    total: int  # training tokens
    types: int
    discount: Discounts
    unknown: float  # probability of the unknown type

    def prob(self, count: np.ndarray) -> np.ndarray:
        known = self.discount.of(count) * count / max(self.total, 1)
        return np.where(count > 0, known, self.unknown)


def unigrams(total: int, types: list[int], distinct: int) -> Unigrams:
    found = discounts(types)
    if not total:
        return Unigrams(0, 0, found, 1.0)
    free = sum((1 - f) * c * types[c - 1] for c, f in enumerate(found.factor, 1)) / total
    if free <= 0:  # nothing is discounted: raise the total by one
        return Unigrams(total + 1, distinct, found, 1 / (total + 1))
    return Unigrams(total, distinct, found, free)


def extra_bits(words: int) -> int:
    """Bits beyond 64 that keep the chance of any collision among so many n-grams under a thousandth."""
    return min(32, max(0, math.ceil(2 * math.log2(max(words, 2)) - 1 + 10) - 64))


class Grams(NamedTuple):
    """A batch's distinct keys: sorted, with an example of each and each token's place among them."""

    keys: np.ndarray
    more: np.ndarray  # the bits beyond 64
    first: np.ndarray
    at: np.ndarray  # -1: the token has no n-gram of this order


def _distinct(keys: np.ndarray, more: np.ndarray, valid: np.ndarray | None = None) -> Grams:
    own = np.arange(len(keys)) if valid is None else np.flatnonzero(valid)
    order = own[np.lexsort((more[own], keys[own])) if more.any() else np.argsort(keys[own], kind="stable")]
    k, m = keys[order], more[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    at = np.full(len(keys), -1)
    at[order] = np.cumsum(new) - 1
    return Grams(k[new], m[new], order[new], at)


class Tokens(NamedTuple):
    """A batch's tokens: each text's words, then its end."""

    row: np.ndarray
    train_row: np.ndarray
    train: np.ndarray
    place: np.ndarray  # in its text
    hashes: np.ndarray
    bits: int

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's n-gram key, and whether it has one: an n-gram reaches back to the start of its text at most."""
        key, more = self.hashes, np.zeros(len(self.hashes), np.uint32)
        if order == 1:
            return key, more, np.ones(len(key), bool)
        before, beyond = self.history(order)[:2]
        key = K.mix(before * _NEXT + self.hashes)
        more = (K.mix((before ^ beyond.astype(K.U64)) * _MORE + self.hashes) & K.U64((1 << self.bits) - 1)).astype(np.uint32)
        return key, more, self.place >= order - 2

    def history(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The key of what stands before each token in its n-gram."""
        key, more, valid = self.keys(order - 1)
        out = [np.zeros_like(x) for x in (key, more, valid)]
        for a, b in zip(out, (key, more, valid), strict=True):
            a[1:] = b[:-1]
        head = self.place == 0
        out[0][head], out[1][head], out[2][head] = START, 0, order == 2
        return out[0], out[1], out[2]

    def grams(self, order: int) -> Grams:
        return _distinct(*self.keys(order))

    def histories(self, order: int) -> Grams:
        return _distinct(*self.history(order))


def _tokens(docs: X.Docs, bits: int) -> Tokens:
    text = K.Text(K.LOWER[docs.text.buf], docs.text.offs)
    words = K.find_words(text)
    hashes = np.insert(K.hash_words(text, words), words.row[1:], END)
    row = words.row + np.arange(len(words.row))
    train_row = np.array([i == X.NO_ID or zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT for i in docs.ids.tolist()], bool)
    n = np.diff(row)
    return Tokens(row, train_row, np.repeat(train_row, n), np.arange(len(hashes)) - np.repeat(row[:-1], n), hashes, bits)


def _merged(sent: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The order of all batches' keys together, and where a new one begins in it."""
    keys, more = (np.concatenate([x[k] for x in sent]) for k in (0, 1))
    order = np.lexsort((more, keys)) if more.any() else np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new


def _sum_counts(batches: list[int], sent: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """For each key of a batch: its count in the corpus, and whether this batch is the first that has it."""
    order, new = _merged(sent)
    count = np.concatenate([x[2] for x in sent])
    total = np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(new))
    all_, owner = np.empty(len(order), np.int64), np.zeros(len(order), np.uint8)
    all_[order], owner[order[new]] = total[np.cumsum(new) - 1], 1
    cut = np.cumsum([len(x[0]) for x in sent])[:-1]
    facts = [int(total.sum()), int((total > 0).sum()), *(int((total == c).sum()) for c in range(1, K_MAX + 2))]
    return [X.pack(a.astype(np.uint32) if not len(a) or a.max() < 2**32 else a, o) for a, o in zip(np.split(all_, cut), np.split(owner, cut), strict=True)], facts


def _facts(met: DataFrame) -> tuple[int, int, list[int]]:
    """Tokens, types and types by count over all buckets: one row of sums."""
    n = K_MAX + 3
    got = met.where("facts is not null").agg(*(F.sum(F.col("facts")[k]) for k in range(n))).first()
    total, types, *by_count = (int(x or 0) for x in got)
    return total, types, by_count


class Model(NamedTuple):
    """The few numbers of a model that are not in tables."""

    order: int
    tokens: int  # of training texts
    one: Unigrams
    higher: tuple[Discounts, ...]  # of orders 2, 3, ...
    starts: int  # training texts
    bits: int


def _send(order: int, buckets: int, bits: int):
    def send(batch: int, docs: X.Docs) -> list[tuple]:
        t = _tokens(docs, bits)
        g = t.grams(order)
        own = t.train & (g.at >= 0)
        return X.route(batch, g.keys, buckets, g.more, np.bincount(g.at[own], minlength=len(g.keys)).astype(np.uint32))

    return send


def _spread(g: Grams, values: np.ndarray, without: float) -> np.ndarray:
    """Each token's value from those of distinct keys."""
    return np.where(g.at >= 0, values[np.maximum(g.at, 0)], without) if len(values) else np.full(len(g.at), without)


class _Known:
    """What a batch knows of its tokens: counts of all orders, and probabilities as far as weights are there.
    ``answers``: counts of orders 1 to the model's, then weights of orders 2, 3, ..."""

    def __init__(self, t: Tokens, model: Model, answers: list[list[np.ndarray]], upto: int) -> None:
        self.t, self.model = t, model
        self.grams = [t.grams(m) for m in range(1, upto + 1)]
        self.seen, self.owner = [], []
        answers = [a or [np.zeros(0, np.int64)] * 2 for a in answers]  # texts of one token have no longer n-grams
        answers += [[np.zeros(0, np.int64)] * 2] * (2 * model.order - 1 - len(answers))
        for g, (count, owner) in zip(self.grams, answers, strict=False):
            self.seen.append(_spread(g, count.astype(np.int64), 0))
            self.owner.append(owner)
        self.weights = [w[0] for w in answers[model.order :]]

    def total(self, order: int) -> np.ndarray:
        """How often each token's history stands before a training token."""
        out = np.zeros_like(self.seen[order - 2])
        out[1:] = self.seen[order - 2][:-1]
        return np.where(self.t.place == 0, self.model.starts if order == 2 else 0, out)

    def direct(self, order: int, raised: np.ndarray) -> np.ndarray:
        seen = self.seen[order - 1]
        return self.model.higher[order - 2].of(seen) * seen / np.maximum(self.total(order) + raised, 1)

    def probs(self, upto: int) -> np.ndarray:
        """P(token | its history of upto - 1 words)."""
        out = self.model.one.prob(self.seen[0])
        for m in range(2, upto + 1):
            weight = _spread(self.t.histories(m), self.weights[m - 2], 1.0)  # one where the history is not known
            out = np.where(self.seen[m - 1] > 0, self.direct(m, weight < 0), np.abs(weight) * out)
        return out


def _send_masses(order: int, model: Model, buckets: int):
    """For each history of a batch: its total, and mass freed by, and lower mass of, the n-grams that this batch owns."""

    def work(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        t = _tokens(docs, model.bits)
        if not len(t.hashes):
            return X.rows([])
        known = _Known(t, model, answers, order)
        g, h = known.grams[order - 1], t.histories(order)
        own = g.first[(known.owner[order - 1] > 0) & (known.seen[order - 1][g.first] > 0)]  # an example of each
        c = known.seen[order - 1][own]
        freed = np.bincount(h.at[own], (1 - model.higher[order - 2].of(c)) * c, len(h.keys))
        mass = np.bincount(h.at[own], known.probs(order - 1)[own], len(h.keys))
        return X.rows(X.route(batch, h.keys, buckets, h.more, known.total(order)[h.first], freed, mass))

    return work


def _weigh(batches: list[int], sent: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """For each history of a batch: its backoff weight, negative where its total is raised by one."""
    order, new = _merged(sent)
    first = np.flatnonzero(new)
    n, freed, mass = (np.concatenate([x[k] for x in sent])[order] for k in (2, 3, 4))
    n, freed, mass = n[first].astype(np.float64), np.add.reduceat(freed, first), np.add.reduceat(mass, first)
    raised = freed <= 1e-12
    weight = np.where(raised, 1 / (n + 1), freed / np.maximum(n, 1)) / np.maximum(1 - mass, 1e-300)
    out = np.empty(len(order))
    out[order] = np.where(n == 0, 1.0, np.where(raised, -weight, weight))[np.cumsum(new) - 1]
    return [X.pack(x) for x in np.split(out, np.cumsum([len(x[0]) for x in sent])[:-1])], []


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(docs: X.Docs, t: Tokens, model: Model, count: np.ndarray, log_probs: np.ndarray) -> pa.RecordBatch:
    n, tokens = np.diff(t.row), model.tokens
    if len(t.hashes):
        score = np.add.reduceat(log_probs, t.row[:-1])
        base = np.add.reduceat(np.log10((count + 0.5) / (tokens + 0.5 * (model.one.types + 1))), t.row[:-1])
        known = np.add.reduceat((count > 0).astype(np.int64), t.row[:-1])
    else:
        score = base = np.zeros(0)
        known = n
    return pa.RecordBatch.from_arrays([docs.id_column(), pa.array(~t.train_row), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), tokens), pa.int64()), pa.array(base), pa.array(score)], [x.split()[0] for x in OUT.split(", ")])


def _score(model: Model):
    def work(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        t = _tokens(docs, model.bits)
        if not len(t.hashes):
            return _rows(docs, t, model, np.zeros(0, np.int64), np.zeros(0))
        known = _Known(t, model, answers, model.order)
        return _rows(docs, t, model, known.seen[0], np.log10(known.probs(model.order)))

    return work


class Trained(NamedTuple):
    model: Model
    stored: DataFrame
    answers: list[DataFrame]


def train(docs: DataFrame, order: int = ORDER) -> Trained:
    """Counts of all orders and weights, as answers to the batches of the documents."""
    sizes = X.plan(docs)
    bits = extra_bits(sizes.words) if order > 1 else 0
    stored = X.store(docs, sizes.batch_bytes)
    met = []
    for m in range(1, order + 1):
        met.append(keep(X.meet(X.first_pass(stored, _send(m, sizes.buckets, bits)), _sum_counts, extra=True)))
        release(docs.sparkSession)
    tokens, types, by_count = _facts(met[0])
    starts = docs.where("doc_id is null or pmod(crc32(cast(cast(cast(doc_id as long) as string) as binary)), %d) != %d" % (FOLDS, HELD_OUT)).count()
    model = Model(order, tokens, unigrams(tokens, by_count, types), tuple(discounts(_facts(x)[2]) for x in met[1:]), starts, bits)
    answers = [x.where("batch is not null") for x in met]
    for m in range(2, order + 1):
        weights = X.meet(X.later_pass(stored, answers, _send_masses(m, model, sizes.buckets), X.ROW), _weigh)
        answers.append(weights if m == order else keep(weights))
    return Trained(model, stored, answers)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability): a row per document."""
    model, stored, answers = train(docs, order)
    return X.later_pass(stored, answers, _score(model), OUT)


TABLE = "level int, weights boolean, key long, more long, value double, count long"


def fit(docs: DataFrame, path: str, order: int = ORDER) -> None:
    """Write the model of the training texts to a folder: ``tables``, partitioned by level, has a row for each n-gram
    (its own probability and its count) and for each history of an n-gram (weights: its backoff weight; count: its
    total), and ``model`` the few numbers that are in neither."""
    model, stored, answers = train(docs, order)
    names = [x.split()[0] for x in TABLE.split(", ")]
    kinds = {"level": pa.int32(), "weights": pa.bool_(), "value": pa.float64()}

    def work(batch: int, docs: X.Docs, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        t, parts = _tokens(docs, model.bits), []
        known = _Known(t, model, answers, model.order) if len(t.hashes) else None

        def add(level: int, weights: bool, g: Grams, own: np.ndarray, value: np.ndarray, count: np.ndarray) -> None:
            at = g.first[own]
            parts.append((np.full(len(at), level), np.full(len(at), weights), g.keys[own].view(np.int64), g.more[own].astype(np.int64), value[at], count[at]))

        for m in range(1, model.order + 1 if known else 0):
            g = known.grams[m - 1]
            own = (known.owner[m - 1] > 0) & (known.seen[m - 1][g.first] > 0)
            if m == 1:
                add(1, False, g, own, model.one.prob(known.seen[0]), known.seen[0])
                continue
            h = t.histories(m)
            weight = _spread(h, known.weights[m - 2], 1.0)
            add(m, False, g, own, known.direct(m, weight < 0), known.seen[m - 1])
            # a history may stand in many batches, which all know its weight; duplicates go before the table is written
            add(m, True, h, known.total(m)[h.first] > 0, np.abs(weight), known.total(m))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.int64())) for c, x in zip(columns, names, strict=True)], names)

    rows = X.later_pass(stored, answers, work, TABLE)
    grams, weights = rows.where("not weights"), rows.where("weights").dropDuplicates(["level", "key", "more"])
    grams.unionByName(weights).write.partitionBy("level").parquet(f"{path}/tables")
    one = model.one
    numbers = [(order, model.tokens, one.total, one.types, list(one.discount.factor), one.unknown, [list(d.factor) for d in model.higher], model.starts, model.bits)]
    docs.sparkSession.createDataFrame(numbers, "order int, tokens long, total long, types long, one array<double>, unknown double, higher array<array<double>>, starts long, bits int").coalesce(1).write.parquet(f"{path}/model")


def score_with(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """What ``score`` gives, for any texts under a model that ``fit`` wrote.  Each token's n-gram and history of every
    order meet the tables; adaptive execution splits the rows of frequent ones."""
    r = spark.read.parquet(f"{path}/model").first()
    model = Model(r["order"], r["tokens"], Unigrams(r["total"], r["types"], Discounts(tuple(r["one"])), r["unknown"]), tuple(Discounts(tuple(d)) for d in r["higher"]), r["starts"], r["bits"])
    need = "doc long, doc_id long, at long, level int, weights boolean, key long, more long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in K.steps(batch, "text"):
                ids = step.column("doc_id")
                t = _tokens(X.Docs(ids.fill_null(X.NO_ID).to_numpy(), K.text_of(step.column("text"))), model.bits)
                row = np.repeat(np.arange(step.num_rows), np.diff(t.row))
                for m in range(1, model.order + 1):
                    for weights in (False, True)[: 1 if m == 1 else 2]:
                        key, more, valid = t.history(m) if weights else t.keys(m)
                        own = np.flatnonzero(valid)
                        at = pa.array(row[own])
                        yield pa.RecordBatch.from_arrays([step.column("doc").take(at), ids.take(at), pa.array(t.place[own]), pa.array(np.full(len(own), m, np.int32)), pa.array(np.full(len(own), weights)), pa.array(key[own].view(np.int64)), pa.array(more[own].astype(np.int64))], [x.split()[0] for x in need.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = keep(numbered).mapInArrow(keys, need)
    tables = spark.read.parquet(f"{path}/tables").select("level", "weights", "key", "more", "value", "count")
    met = rows.join(tables, ["level", "weights", "key", "more"], "left").groupBy("doc", "doc_id", "at")
    wide = met.agg(*(F.max(F.when((F.col("level") == m) & (F.col("weights") == w), F.col(c))).alias(f"{c}{m}{'w' if w else ''}") for m in range(1, model.order + 1) for w in (False, True) for c in ("value", "count")))
    prob = F.coalesce("value1", F.lit(model.one.unknown))
    for m in range(2, model.order + 1):
        prob = F.coalesce(f"value{m}", F.coalesce(f"value{m}w", F.lit(1.0)) * prob)
    total = model.tokens
    count = F.coalesce("count1", F.lit(0))
    sums = wide.groupBy("doc", "doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(count > 0).alias("n_known"), F.sum(F.log10((count + 0.5) / F.lit(total + 0.5 * (model.one.types + 1)))).alias("base_score"), F.sum(F.log10(prob)).alias("score"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return sums.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

"""Operator 6 - mixing sources to target weights through soft membership.

A softmax classifier, trained on a bounded sample of the labelled table, gives each document a posterior over
the domains (the label values).  Document rates r >= 0 are then fitted so that the expected tokens of each
domain, the sum of r x tokens x posterior, match the targets: projected gradient on the least squares of the
totals, each weighted by its domain's present total.  With rates in the metric of their tokens the step size 1
is safe, because the weighted Gram matrix has row sums of one.  An iteration is one sum over a narrow table
(id, tokens, posterior), and the steps so far are replayed within it; only one number per domain is collected.

``mix`` turns rates into rows: the whole part of the rate in copies, one more by a hash of the id.

Defined results: a null or wordless text has no tokens, keeps its rate (which no total depends on) and is scored
like any other; with fewer than two labelled domains there is one domain and all rates scale alike; a domain
with no expected tokens can't be reached and is left out.  Repeated rows get equal rates.  Documents with an
unwanted label value, by their label or else by their posterior, get rate 0 and no part in the fit.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import free, keep
from .quality import FEATURES, measure

#: Hash slots of words, and how many of them the classifier uses.
SLOTS, USED = 1 << 18, 512
SAMPLE, ROUNDS, CLOSE = 4000, 40, 1e-4


def _presence(text: K.Text) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot of a word), lower-cased and without the punctuation around it."""
    low = K.Text(K.LOWER[text.buf], text.offs)
    words = K.find_words(low, K.NON_ALNUM)
    slot = (K.hash_words(low, words) >> K.U64(46)).astype(np.int64)
    pair = np.sort(K.row_ids(words.row) * SLOTS + slot)
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return pair // SLOTS, pair % SLOTS


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    place: np.ndarray  # of each slot among the used ones, or -1
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # features + 1 (bias) x domains

    def features(self, text: K.Text) -> tuple[np.ndarray, np.ndarray]:
        base, x = measure(text)
        row, slot = _presence(text)
        own = self.place[slot] >= 0
        seen = np.zeros((len(x), int(self.place.max()) + 1), np.float32)
        seen[row[own], self.place[slot[own]]] = 1
        return base["n_words"], np.concatenate([(x - self.mean) / self.scale, seen, np.ones((len(x), 1))], axis=1)

    def posteriors(self, text: K.Text) -> tuple[np.ndarray, np.ndarray]:
        n, x = self.features(text)
        return n, softmax(x @ self.weight)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str | None], domain: list[str], used: int = USED, rounds: int = 120, l2: float = 1e-4) -> Classifier:
    """Softmax regression on standardised document statistics and the words whose presence differs most between
    a domain and the rest (by the z-score of the smoothed log-odds)."""
    names = tuple(sorted(set(domain)))
    y = np.searchsorted(names, domain)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = [K.text_of(p.column("text")) for p in K.steps(batch, "text")]
    hits, at = np.zeros((len(names), SLOTS), np.float32), 0
    for text in parts:
        row, slot = _presence(text)
        np.add.at(hits, (y[at + row], slot), 1)
        at += len(text.offs) - 1
    size, every = np.bincount(y, minlength=len(names)).astype(np.float32)[:, None], hits.sum(0)
    odds = np.log((hits + 0.5) / (size - hits + 0.5)) - np.log((every - hits + 0.5) / (len(y) - size - every + hits + 0.5))
    spread = np.sqrt(1 / (hits + 0.5) + 1 / (every - hits + 0.5) + 1 / (size - hits + 0.5) + 1 / (len(y) - size - every + hits + 0.5))
    z = np.where(every >= 3, np.abs(odds / spread).max(0), 0)
    best = np.argsort(-z, kind="stable")[:used]
    place = np.full(SLOTS, -1, np.int64)
    place[best] = np.arange(len(best))
    stats = np.concatenate([measure(text)[1] for text in parts])
    blank = Classifier(names, place, stats.mean(0), stats.std(0) + 1e-6, np.zeros((len(FEATURES) + len(best) + 1, len(names))))
    x = np.concatenate([blank.features(text)[1].astype(np.float32) for text in parts])
    goal = np.eye(len(names), dtype=np.float32)[y]
    w, m, v = blank.weight.astype(np.float32), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam, all rows at once
        g = x.T @ (softmax(x @ w) - goal) / len(y) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Classifier(names, place, blank.mean, blank.scale, w.astype(np.float64))


def domain_of(labels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """doc_id, domain: the label values side by side; ids with a null label are left out, the greatest of several wins."""
    rows = labels.where(" and ".join(f"{c} is not null" for c in ("doc_id", *columns)))
    name = F.concat_ws("_", *(F.concat(F.lit(c), F.col(c).cast("string")) for c in columns))
    return rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max(name).alias("domain"))


def fit_classifier(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE) -> Classifier | None:
    """Trained on at most ``sample`` labelled documents, the same ones for the same rows."""
    chosen = F.broadcast(domain_of(labels, columns).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(chosen, "_id").select("_id", "text", "domain")
    # an id that repeats can bring more rows than were chosen: the same ones whatever the tasks' order
    rows = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("text"), "text").limit(sample)
    got = sorted(rows.collect(), key=lambda r: (r["_id"], r["text"] or ""))
    return train([r["text"] for r in got], [r["domain"] for r in got]) if len({r["domain"] for r in got}) > 1 else None


def posteriors(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """doc_id, n_tokens, p (posterior by domain): a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.steps(batch, "text"):
                text = K.text_of(part.column("text"))
                if classifier:
                    n, p = classifier.posteriors(text)
                else:
                    n = np.diff(K.find_words(text).row)
                    p = np.ones((len(n), 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _dot(step: np.ndarray) -> Column:
    total = F.lit(0.0)
    for k, x in enumerate(step.tolist()):
        total = total + F.col("p")[k] * F.lit(x)
    return total


def fit_rates(members: DataFrame, targets: dict[int, float], domains: int, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, np.ndarray]:
    """members with a column rate, and the expected totals by domain.  ``targets``: tokens wanted of each domain.
    Gradient steps that have not met the targets after ``rounds`` are finished by ``_finish``; targets that no
    rates meet are approached and warned of."""
    wanted = np.array([targets.get(k, 0.0) for k in range(domains)])
    start = members.withColumn("rate", F.lit(1.0))
    now = start

    def totals(rows: DataFrame) -> np.ndarray:
        row = rows.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col("p")[k]) for k in range(domains))).first()
        return np.array([float(x or 0.0) for x in row])

    have = totals(now)
    weight = np.where(have > 0, have, np.inf)
    reached = np.isfinite(weight)
    met = lambda have: np.abs(have - wanted)[reached].sum() <= close * max(wanted.sum(), 1.0)
    for k in range(rounds):
        if met(have):
            break
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - _dot((have - wanted) / weight)))
        if k % 8 == 7:
            now = keep(now)  # bounds how many steps are replayed
        have = totals(now)
    if not met(have):
        now = keep(now)
        now = _finish(now, wanted, weight, met)
        have = totals(now)
        if not met(have):
            warnings.warn(f"mixing: targets {wanted.tolist()} not met; expected totals are {have.tolist()}", stacklevel=2)
    return now, have


def _finish(members: DataFrame, wanted: np.ndarray, weight: np.ndarray, met: Callable[[np.ndarray], bool], rounds: int = 100) -> DataFrame:
    """The least change of the rates (squares, by tokens) that meets the targets: max(0, rate + p . x), x by damped
    Newton steps on the convex dual.  A step is one sum of the totals, their Gram matrix and the dual's value.  The
    ridge keeps x finite where no rates meet the targets; it ends where the dual is at rest."""
    use = np.flatnonzero(np.isfinite(weight))
    ridge = np.where(np.isfinite(weight), weight, 0.0)[use] * 1e-9

    def moved(x: np.ndarray) -> DataFrame:
        return members.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") + _dot(x)))

    def sums(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        n, r, p = F.col("n_tokens"), F.col("rate"), F.col("p")
        on = F.when(r > 0, n).otherwise(F.lit(0))
        row = [float(v or 0.0) for v in moved(x).agg(F.sum(n * r * r) / 2, *(F.sum(n * r * p[int(k)]) for k in range(len(wanted))), *(F.sum(on * p[int(i)] * p[int(j)]) for i in use for j in use)).first()]
        have, gram = np.array(row[1 : 1 + len(wanted)]), np.array(row[1 + len(wanted) :]).reshape(len(use), len(use))
        value = row[0] - x @ wanted + (ridge * x[use] ** 2).sum() / 2
        return value, have[use] - wanted[use] + ridge * x[use], gram + np.diag(ridge), have

    x = np.zeros(len(wanted))
    value, slope, gram, have = sums(x)
    left = rounds
    while left > 0 and not met(have):
        step = np.zeros(len(wanted))
        step[use] = -np.linalg.lstsq(gram, slope, rcond=None)[0]
        gain, size, better = float(slope @ step[use]), 1.0, None
        while left > 0 and size > 1e-6 and better is None:  # halved until the dual falls as it should
            left -= 1
            tried = sums(x + size * step)
            better = tried if tried[0] <= value + 1e-4 * size * gain else None
            size /= 1 if better else 2
        if better is None or abs(gain) <= 1e-12 * max(abs(value), 1.0):
            break
        x, (value, slope, gram, have) = x + size * step, better
    return moved(x)


def targets_of(members: DataFrame, domains: tuple[str, ...], weights: dict[str, float], anchor: str | None = None, scale: float = 1.0, only_anchor_grows: bool = False) -> dict[int, float]:
    """Token targets in the ratio of ``weights`` (over the domains there are).  In all: ``scale`` times what there
    is, or, with an ``anchor``, as much as makes the anchor's target ``scale`` times its present total; with
    ``only_anchor_grows`` no other domain's target exceeds what it has."""
    row = members.agg(*(F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(domains)))).first()
    have = [float(x or 0.0) for x in row]
    share = np.array([weights.get(d, 0.0) if h > 0 else 0.0 for d, h in zip(domains, have, strict=True)])
    share = share / share.sum() if share.sum() else np.full(len(have), 1 / max(len(have), 1))
    total = sum(have) * scale
    if anchor in domains and share[domains.index(anchor)]:
        total = have[domains.index(anchor)] * scale / share[domains.index(anchor)]
    wanted = (share * total).tolist()
    if only_anchor_grows:
        wanted = [w if d == anchor else min(w, h) for d, w, h in zip(domains, wanted, have, strict=True)]
    return dict(enumerate(wanted))


def without(members: DataFrame, labels: DataFrame, domains: tuple[str, ...], unwanted: dict[str, int]) -> tuple[DataFrame, tuple[str, ...]]:
    """members with gone, whether a document has an unwanted label value, and p over the domains without one.  A
    label decides where there is one (the unwanted of several), else half of the posterior."""
    bad = [any(f"_{c}{v}_" in f"_{d}_" for c, v in unwanted.items()) for d in domains]
    total = lambda flag: sum((F.col("p")[k] for k, b in enumerate(bad) if b == flag), F.lit(0.0))
    says = F.greatest(*(F.max(F.col(c) == v) for c, v in unwanted.items()), F.lit(None).cast("boolean"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(says.alias("_says"))
    told = members.join(known, members["doc_id"] == known["_id"], "left").withColumn("gone", F.coalesce("_says", total(True) >= 0.5)).drop("_id", "_says")
    if all(bad):
        return told.withColumn("p", F.array(F.lit(1.0))), ("all",)
    share = F.array(*(F.col("p")[k] / F.greatest(total(False), F.lit(1e-300)) for k, b in enumerate(bad) if not b))
    return told.withColumn("p", share), tuple(d for d, b in zip(domains, bad, strict=True) if not b)


def copies(rate: str = "rate", key: str = "doc_id") -> Column:
    """How many times a document is taken: its rate, rounded up or down by a hash of its id."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col(rate) + u).cast("int")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], columns: tuple[str, ...] = ("quality", "toxic"), anchor: str | None = None, scale: float = 1.0, unwanted: dict[str, int] | None = None, only_anchor_grows: bool = False) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p, rate, copies: a row per document.  Documents with an ``unwanted``
    label value have rate 0 and no part in the fit."""
    classifier = fit_classifier(docs, labels, columns)
    domains = classifier.domains if classifier else ("all",)
    name = F.array(*map(F.lit, domains))[F.array_position("p", F.array_max("p")).cast("int") - 1]
    members, gone = posteriors(docs, classifier).withColumn("domain", name), None
    if unwanted:
        told, domains = without(members, labels, domains, unwanted)
        told = keep(told)
        members, gone = told.where("not gone").drop("gone"), told.where("gone").drop("gone").withColumn("rate", F.lit(0.0))
    else:
        members = keep(members)
    found, _ = fit_rates(members, targets_of(members, domains, weights, anchor, scale, only_anchor_grows), len(domains))
    found = found.unionByName(gone) if gone else found
    return found.select("doc_id", "n_tokens", "domain", "p", "rate", copies().alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The documents, each as often as its rate says, with all their columns."""
    own, n = free(docs, "own_id"), free(docs, "copies")
    chosen = rates(docs, labels, weights, **options).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    taken = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(own, n)

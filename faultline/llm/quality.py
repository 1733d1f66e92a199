"""Operator 1 - quality rules: boosted trees over document statistics.

``statistics`` measures whole texts.  ``fit`` trains gradient-boosted trees (logistic loss, histogram splits)
on a bounded sample of the labelled rows; features listed in ``MONOTONE`` may only lower or only raise the
score.  The trees are flattened into node arrays and a batch of rows walks all of them in step.

Defined results: a null, empty or blank text has no words and fails the base rules.  Labels that are null or
have no document are not used; with fewer than two classes there is no model and the base rules decide alone.
Repeated rows are scored alike.  Columns other than the id and the text are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: -1: a larger value may only lower the score; 1: only raise it; 0: free.
MONOTONE = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "digit_rate": -1, "punct_rate": 0,
    "bang_rate": -1, "bar_rate": -1, "short_rate": 0, "long_rate": -1, "lines_rate": 0, "stop_rate": 0, "distinct_rate": 0, "non_ascii_rate": 0,
}
FEATURES = tuple(MONOTONE)

_bytes = np.arange(256)
_SYMBOL = np.isin(_bytes, np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD = (_bytes & 0xC0) != 0x80
_UPPER = (_bytes >= 0x41) & (_bytes <= 0x5A)
_DIGIT = (_bytes >= 0x30) & (_bytes <= 0x39)
_PUNCT = np.isin(_bytes, np.frombuffer(b".,;:!?\"'()[]{}-_/\\@=+~^`", np.uint8))


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def _dup_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x and x.strip()]
    return len(lines) - len(set(lines))


def measure(text: K.Text) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics by name, and the feature matrix in the order of FEATURES."""
    rows, words = len(text.offs) - 1, K.find_words(text)
    n = np.diff(words.row)
    inside = ~K.SPACE
    out = {"n_words": n, "word_chars": _sums((inside & _LEAD)[text.buf], text.offs), "n_symbols": _sums(_SYMBOL[text.buf], text.offs)}
    out["n_dup_lines"] = np.fromiter(map(_dup_lines, K.rows_of(text)), np.int64, rows)
    hashes, ids = K.hash_words(text, words), K.row_ids(words.row)
    windows, ok = K.hash_windows(hashes, REPEAT_WINDOW), K.starts_in_row(words.row, REPEAT_WINDOW)
    at = np.flatnonzero(ok)
    # the row goes into the key: a window repeats within its own text only
    again = at[K.repeated(K.mix(windows[at] + ids[at].astype(K.U64) * K.U64(0x9FB21C651E98DF25)))]
    out["n_repeat_words"] = K.per_row(K.covered(again, REPEAT_WINDOW, len(hashes)), words.row)
    # for a feature only: distinct words by 44 bits of their hash, grouped by row in one sort
    order = np.sort((ids.astype(K.U64) << K.U64(44)) | (hashes >> K.U64(20)))
    first = np.ones(len(order), bool)
    first[1:] = order[1:] != order[:-1]
    distinct = np.bincount((order[first] >> K.U64(44)).astype(np.int64), minlength=rows)
    size = words.end - words.start
    lines = _sums(text.buf == 0x0A, text.offs) + 1
    common = np.maximum(out["n_words"], 1)
    chars = np.maximum(out["word_chars"], 1)
    features = {
        "log_words": np.log1p(n), "mean_word": out["word_chars"] / common, "symbol_rate": out["n_symbols"] / chars, "dup_line_rate": out["n_dup_lines"] / lines,
        "repeat_rate": out["n_repeat_words"] / common, "upper_rate": _sums(_UPPER[text.buf], text.offs) / chars, "digit_rate": _sums(_DIGIT[text.buf], text.offs) / chars, "punct_rate": _sums(_PUNCT[text.buf], text.offs) / chars,
        "bang_rate": _sums(text.buf == 0x21, text.offs) / chars, "bar_rate": _sums(text.buf == 0x7C, text.offs) / chars, "short_rate": K.per_row(size <= 3, words.row) / common, "long_rate": K.per_row(size > 24, words.row) / common,
        "lines_rate": lines / common, "stop_rate": K.per_row(size == 2, words.row) / common, "distinct_rate": distinct / common, "non_ascii_rate": _sums(text.buf >= 0xC0, text.offs) / chars,
    }
    return out, np.column_stack([features[k].astype(np.float64) for k in FEATURES]) if rows else np.zeros((0, len(FEATURES)))


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


@dataclass(frozen=True)
class Forest:
    """All trees in one set of node arrays; leaves point at themselves, ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out = np.full(len(x), self.bias)
        if not len(self.roots):
            return out
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 4096] += self.value[node].sum(1)
        return out


def train(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = tuple(MONOTONE.values()), trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: int = 8, cut: float = 0.0) -> Forest:
    """Second-order boosting.  A split on a constrained feature must order its children's values, and what lies
    below it is held on its side of their midpoint, so the whole sum is monotone in that feature."""
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    nodes: list[list[float]] = []
    roots, margin = [], np.full(len(y), bias)
    constraint = np.asarray(monotone)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float, step: np.ndarray) -> int:
        me, sg, sh = len(nodes), g[rows].sum(), h[rows].sum()
        value = leaf(sg, sh, low, high)
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-3, -1, -1, 0.0, 0.0)
        loss = lambda a, b, v: a * v + 0.5 * (b + l2) * v * v
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                m = len(edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(code[rows, f], weights=w, minlength=m))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                if not len(gl):
                    continue
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(sg - gl) / (sh - hl + l2), low, high)
                gain = loss(sg, sh, value) - loss(gl, hl, vl) - loss(sg - gl, sh - hl, vr)
                gain[(nl < least) | (len(rows) - nl < least) | (constraint[f] * (vr - vl) < 0)] = -1
                if (k := int(np.argmax(gain))) >= 0 and gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best[1] < 0:
            step[rows] = rate * value
            return me
        _, f, k, vl, vr = best
        mid, side = (vl + vr) / 2, constraint[f]
        go = code[rows, f] <= k
        left = grow(rows[go], g, h, level + 1, mid if side < 0 else low, mid if side > 0 else high, step)
        right = grow(rows[~go], g, h, level + 1, mid if side > 0 else low, mid if side < 0 else high, step)
        nodes[me] = [f, edges[f][k], left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf, step))
        margin = margin + step
    flat = np.array(nodes)
    return Forest(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, bias, cut)


def sample_labels(labels: DataFrame, label: str, size: int) -> DataFrame:
    """At most ``size`` labelled ids, the same for the same rows: those whose hashed id is least."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("_label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.steps(batch, "text"):
            _, x = measure(K.text_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("_label"), *(pa.array(c) for c in x.T)], ["_label", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, **options) -> Forest | None:
    """Train on at most ``sample`` labelled documents; that bound also bounds what is broadcast and collected."""
    chosen = F.broadcast(sample_labels(labels, label, sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("_label", "text").mapInArrow(_training_rows, ", ".join(f"{c} double" for c in ("_label", *FEATURES)))
    got = rows.orderBy("_label", *FEATURES).limit(sample).toPandas()  # the same rows in one order, whatever the tasks' order
    y = (got.pop("_label").to_numpy() > 0).astype(float)
    if len(np.unique(y)) < 2:
        return None
    return train(got.to_numpy(np.float64), y, **options)


def judge(text: K.Text, forest: Forest | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    base, x = measure(text)
    failed = base_failed(base)
    score = forest.score(x) if forest else np.zeros(len(failed))
    return base, failed, score, ~failed & (score >= (forest.cut if forest else 0.0))


def assess(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the base statistics, base_failed, score (log-odds of good quality) and kept, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.steps(batch, "text"):
                base, failed, score, kept = judge(K.text_of(part.column("text")), forest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(base[k], pa.int64()) for k in BASE), pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *BASE, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.steps(batch, "text"):
                yield part.filter(pa.array(judge(K.text_of(part.column("text")), forest)[3]))

    return docs.mapInArrow(run, docs.schema)

"""Substring dedup and the language model: against plain Python, on edge cases and over many batches."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from test_contracts import EDGE, got, odd, rows_of  # noqa: F401

from faultline.llm import exchange, katz, queries, substring

OUT3 = ("doc_id", "n_words", "n_removed", "kept_sha256")
OUT9 = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(exchange, "LEAST_BYTES", 2000)
    monkeypatch.setattr(exchange, "ROW_KEYS", 1)


def test_pack_round_trip():
    a, b, c = np.sort(np.random.default_rng(0).integers(0, 2**63, 500, np.uint64)), np.arange(500, dtype=np.uint32), np.random.default_rng(1).random(500)
    for x, y in zip(exchange.unpack(exchange.pack(a, b, c, rising=2)), (a, b, c), strict=True):
        assert x.dtype == y.dtype and (x == y).all()
    assert len(exchange.unpack(exchange.pack(a[:0], rising=1))[0]) == 0


def test_substring(spark, sf_dir):
    rows = rows_of(sf_dir, "documents", "doc_id", "text")
    assert got(queries.op3_substring(spark, sf_dir), *OUT3) == brute.substring(rows)


def test_substring_over_batches(spark, sf_dir, small_batches):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = rows_of(sf_dir, "documents", "doc_id", "text")
    assert got(substring.remove_repeats(docs), *OUT3) == brute.substring(rows)


@pytest.mark.parametrize("width", [4, 7, 20])
def test_substring_odd(spark, odd, small_batches, width):  # noqa: F811
    loop = "p q r s t u v " * 12
    rows = [*enumerate(EDGE), (40, loop), (41, "z " + loop), (42, loop[14:60]), (43, "w " * 60)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, batch int").repartition(3)
    out = substring.remove_repeats(docs, width).cache()
    assert got(out, *OUT3) == brute.substring(rows, width)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out.collect())
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def turing(counts):
    """Good-Turing factors by the definitions, from all counts of one order: {count: factor}."""
    n = Counter(counts)
    if not n[1]:
        return {}
    for limit in (5, 4, 3, 2):
        cut = (limit + 1) * n[limit + 1] / n[1]
        if cut < 1 and all(n[r] for r in range(1, limit + 1)):
            found = {r: ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) for r in range(1, limit + 1)}
            if all(0 < f < 1 for f in found.values()):
                return found
    seen = [r for r in range(1, 7) if n[r]]
    slope = np.polyfit(np.log(seen), np.log([n[r] for r in seen]), 1)[0] if len(seen) > 1 else -2.0
    return {r: ((r + 1) / r) ** (1 + min(slope, -1.1)) for r in range(1, 6)}


def model(rows, order=2):
    """The same model by plain dictionaries."""
    docs = [(i, zlib.crc32(str(i).encode()) % 5 == 1, [*brute.WORD.findall(brute.lower(t)), None]) for i, t in rows]
    one, seen = Counter(), [defaultdict(Counter) for _ in range(order)]  # by the history's length
    history = lambda tokens, k, size: tuple(["<s>", *tokens][max(0, k + 1 - size) : k + 1])
    for _, held, tokens in docs:
        if not held:
            one.update(tokens)
            for k, w in enumerate(tokens):
                for size in range(1, order):
                    if k + 1 >= size:
                        seen[size][history(tokens, k, size)][w] += 1
    total = sum(one.values())
    factor = [turing(one.values()), *(turing(c for m in seen[size].values() for c in m.values()) for size in range(1, order))]
    d = lambda level, c: factor[level].get(c, 1.0)
    free = sum((1 - d(0, c)) * c for c in one.values())
    n_one, free = (total, free) if free > 0 else (total + 1, 1)

    def uni(w):
        return (d(0, one[w]) * one[w] if one[w] else free) / n_one

    def prob(h, w):
        if not h:
            return uni(w)
        m = seen[len(h)].get(h)
        if m is None:
            return prob(h[1:], w)
        n, left = sum(m.values()), sum((1 - d(len(h), c)) * c for c in m.values())
        n, left = (n, left) if left > 1e-12 else (n + 1, 1)
        return d(len(h), m[w]) * m[w] / n if m[w] else left / n / (1 - sum(prob(h[1:], v) for v in m)) * prob(h[1:], w)

    out = []
    for i, held, tokens in docs:
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in tokens)
        out.append((i, held, len(tokens), sum(one[w] > 0 for w in tokens), total, base, sum(math.log10(prob(history(tokens, k, order - 1) if order > 1 else (), w)) for k, w in enumerate(tokens))))
    return sorted(out), prob, one, seen


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and np.allclose(x[5:], y[5:], rtol=1e-9, atol=1e-9), (x, y)


def test_katz(spark, sf_dir):
    rows = rows_of(sf_dir, "documents", "doc_id", "text")
    out, prob, one, seen = model(rows)
    found = got(queries.op9_katz(spark, sf_dir), *OUT9)
    same(found, out)
    for h in [*list(seen[1])[:10], ("the",), ("unseen",)]:  # exactly normalised, the unknown type included
        assert abs(sum(prob(h, w) for w in [*one, "\0unknown"]) - 1) < 1e-9
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the add-half unigram on held-out text


def test_katz_over_batches_and_odd(spark, odd, small_batches):  # noqa: F811
    rows = [*enumerate(EDGE), *((100 + k, "the same few words and the same " * (k % 9 + 1)) for k in range(60))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, held_out int").repartition(4)
    same(got(katz.score(docs), *OUT9), model(rows)[0])
    assert katz.score(odd.limit(0)).count() == 0
    none = katz.score(spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.held_out) for r in none) == [(1, False), (3, False)]


@pytest.mark.parametrize("order", [1, 3])
def test_katz_orders_and_tables(spark, sf_dir, small_batches, monkeypatch, order):
    """Other orders, keys of 96 bits, and a stored model that scores other texts."""
    from faultline.llm.common import fresh_dir

    monkeypatch.setattr(katz, "extra_bits", lambda words: 32)
    rows = [r for r in rows_of(sf_dir, "documents", "doc_id", "text") if len(r[1] or "") < 3000][:60] + [(900, None), (901, "a"), (902, "a b a b a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, prob, one, seen = model(rows, order)
    same(got(katz.score(docs, order), *OUT9), want)
    for h in [*list(seen[-1])[:5], ("unseen", "words")][: 6 if order > 1 else 0]:
        assert abs(sum(prob(h, w) for w in [*one, "\0unknown"]) - 1) < 1e-9
    katz.fit(docs, path := fresh_dir(spark, "katz"), order)
    same(got(katz.score_with(spark, path, docs), *OUT9), want)
    other = katz.score_with(spark, path, spark.createDataFrame([(1, "nothing like it was ever seen"), (1, "a b")], "doc_id long, text string"))
    assert other.count() == 2 and all(r.score < 0 for r in other.collect())


def test_turing_factors():
    assert katz.discounts([0, 0, 0, 0, 0, 0]).factor == ()
    for types in ([100, 40, 22, 14, 10, 7], [100, 40, 22, 5, 9, 7], [10, 9, 8, 8, 8, 9], [7, 0, 0, 0, 0, 0], [3, 0, 5, 0, 0, 1]):
        counts = [r for r, n in enumerate(types, 1) for _ in range(n)]
        got_, want = katz.discounts(types).factor, turing(counts)
        assert np.allclose(got_, [want[r] for r in range(1, len(got_) + 1)]) and len(got_) == len(want) and all(0 < f < 1 for f in got_)


def test_keys_beyond_64_bits():
    assert katz.extra_bits(10**7) == 0 and katz.extra_bits(10**13) == 32
    keys, more = np.array([5, 5, 3, 5, 3], np.uint64), np.array([1, 0, 2, 1, 2], np.uint32)
    g = katz._distinct(keys, more)
    assert list(zip(g.keys.tolist(), g.more.tolist(), strict=True)) == [(3, 2), (5, 0), (5, 1)] and g.at.tolist() == [2, 1, 0, 2, 0]

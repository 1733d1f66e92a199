"""Rollups, line dedup, mixing and the pipeline, against plain Python and on edge cases."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from test_contracts import EDGE, got, odd, rows_of  # noqa: F401
from test_exchange_ops import small_batches  # noqa: F401

import corpus_pipeline
from faultline.llm import linejoin, mixing, queries, rollup, tokenfiles
from faultline.llm.common import fresh_dir

CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokenizer string, old_tokens long"
TOTALS = ("source", "lang", "tokenizer", "n_docs", "n_tokens")


def test_rollup(spark):
    r = rollup.Rollup(spark, fresh_dir(spark, "rollup"))
    df = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    assert r.totals().count() == 0
    first = df(("insert", "a", "en", "v1", 10, None, None), ("insert", "a", "en", "v1", 5, None, None), ("insert", None, None, "v1", None, None, None), ("odd", "a", "en", "v1", 7, None, None), (None, "a", "en", "v1", 7, None, None))
    assert r.commit("b1", first) and not r.commit("b1", first)
    state = lambda: sorted((tuple(x) for x in r.totals().select(*TOTALS).collect()), key=lambda x: str(x))
    assert state() == [("a", "en", "v1", 2, 15), (None, None, "v1", 1, 0)]
    r.compact()
    assert not r.commit("b1", first) and r.committed() == {"b1"}
    assert r.commit("b2", df(("revise", "a", "en", "v2", 9, "v1", 10), ("revise", "a", "en", "v1", 6, None, 5), ("delete", None, None, "v1", 0, None, None)))
    want = [("a", "en", "v1", 1, 6), ("a", "en", "v2", 1, 9)]
    assert state() == want
    r.compact()
    assert state() == want and rollup.Rollup(spark, r.root).committed() == {"b1", "b2"}
    assert r.commit("b3", df()) and state() == want
    with pytest.raises(ValueError):
        r.commit("../x", first)


def test_rollup_survives_crashes_and_races(spark, monkeypatch):
    df = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None, None)], CHANGE)
    state = lambda r: [(x.n_docs, x.n_tokens) for x in r.totals().collect()]
    r = rollup.Rollup(spark, fresh_dir(spark, "rollup"))
    assert r.commit("b1", df(10)) and r.commit("b2", df(1))

    def dies(*_):
        raise RuntimeError("lost")

    for step in ("_write", "_mark"):  # a commit and a compaction that die before each of their steps
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(rollup.Rollup, step, dies)
            r.commit("b3", df(100))
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(rollup.Rollup, step, dies)
            r.compact()
        assert state(r) == [(2, 11)] and r.committed() == {"b1", "b2"}
    r._fs.create(r._path(f"{r.root}/log/b3"), False).close()  # a marker whose writer died within it
    assert state(r) == [(2, 11)] and r.commit("b3", df(100)) and not r.commit("b3", df(100)) and state(r) == [(3, 111)]
    r._fs.create(r._path(f"{r.root}/base/00000001"), False).close()
    inside, mark = [], rollup.Rollup._mark

    def late(self, marker, name):  # another writer commits while the compaction is under way
        if marker.startswith("base/") and not inside:
            inside.append(rollup.Rollup(spark, r.root).commit("b4", df(5)))
        return mark(self, marker, name)

    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "_mark", late)
        r.compact()
    assert inside == [True] and state(r) == [(4, 116)]
    for k in range(3):
        assert r.commit(f"c{k}", df(1))
        r.compact()
        assert state(r) == [(5 + k, 117 + k)] and not r.commit("b1", df(10))
    assert r.committed() == {"b1", "b2", "b3", "b4", "c0", "c1", "c2"} and len(r._names("base")) == 2
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # dies between the new base and the cleaning up
        assert r.commit("d", df(1))
        m.setattr(rollup.Rollup, "_drop", dies)
        r.compact()
    assert state(r) == [(8, 120)] and r.commit("e", df(1)) and state(r) == [(9, 121)]
    r.compact()
    assert state(r) == [(9, 121)]


def test_rollup_query(spark, sf_dir):
    first, want = {}, Counter()
    for i, s, lang, t in sorted(rows_of(sf_dir, "documents", "doc_id", "source", "lang", "text")):
        if first.setdefault(t or "", i) == i:
            for v, n in (("words-1", len(brute.WORD.findall(t or ""))), ("bytes-2", len((t or "").encode()))):
                want[s, lang, v, "docs"] += 1
                want[s, lang, v, "tokens"] += n
    out = queries.op4_token_rollup(spark, sf_dir).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in out} == {k[:3]: (want[(*k[:3], "docs")], want[(*k[:3], "tokens")]) for k in want}


LINES = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def test_line_dedup(spark, sf_dir):
    assert got(queries.op5_line_dedup(spark, sf_dir), *LINES) == brute.similar_lines(rows_of(sf_dir, "documents", "doc_id", "text"))


@pytest.mark.parametrize("tries", [1, 4])
def test_line_dedup_crowds_and_odd(spark, odd, small_batches, monkeypatch, tries):  # noqa: F811
    monkeypatch.setattr(linejoin, "TRIES", tries)
    rng = random.Random(tries)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 14))] for _ in range(20)]

    def near():
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            line.insert(rng.randrange(len(line) + 1), f"w{rng.randrange(40)}")
            if rng.random() < 0.5:
                line.pop(rng.randrange(len(line)))
        return " ".join(line)

    rows = [*enumerate(EDGE), *((100 + k, "\n".join(near() for _ in range(rng.randint(0, 10)))) for k in range(120))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int").repartition(3)
    assert got(linejoin.remove_similar_lines(docs), *LINES) == brute.similar_lines(rows)
    assert linejoin.remove_similar_lines(odd.limit(0)).count() == 0


def brute_rates(n, p, wanted, rounds=4000):
    """Projected gradient with small steps, to convergence."""
    r, have = np.ones(len(n)), (n[:, None] * p).sum(0)
    for _ in range(rounds):
        r = np.maximum(0, r - 0.5 * p @ (((n * r) @ p - wanted) / have))
    return r


def test_rates_match_targets(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(0, 500, 300)
    p = rng.dirichlet([0.2, 0.2, 0.2], 300)
    members = spark.createDataFrame([(k, int(a), b.tolist()) for k, (a, b) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    total = (n[:, None] * p).sum(0)
    wanted = total * [0.3, 1.0, 1.5]
    out, have = mixing.fit_rates(members, dict(enumerate(wanted)), 3, rounds=60, close=1e-7)
    assert np.allclose(have, wanted, rtol=1e-4)
    found = np.array([r.rate for r in out.orderBy("doc_id").collect()])
    assert (found >= 0).all() and np.allclose(found[n > 0], brute_rates(n, p, wanted)[n > 0], atol=0.02)
    assert mixing.targets_of(members, ("a", "b", "c"), {"a": 1, "b": 3}, anchor="b") == pytest.approx({0: total[1] / 3, 1: total[1], 2: 0})


def test_mixing(spark, sf_dir):
    labels = {i: f"quality{q}_toxic{t}" for i, q, t in rows_of(sf_dir, "labels", "doc_id", "quality", "toxic")}
    out = {r.doc_id: r for r in queries.op6_mixing(spark, sf_dir).collect()}
    assert len(out) == 200 and np.mean([out[i].domain == d for i, d in labels.items()]) > 0.9
    good = [out[i].rate for i, d in labels.items() if d == "quality1_toxic0"]
    assert min(good) > 0.8 and np.mean([out[i].rate for i, d in labels.items() if d != "quality1_toxic0"]) < 0.5


def test_mixing_odd(spark, odd):  # noqa: F811
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = mixing.rates(odd, labels, {"all": 1.0}, scale=2.0).collect()
    assert len(out) == len(EDGE) and all(abs(r.rate - 2) < 1e-3 for r in out if r.n_tokens) and all(r.copies in (1, 2) for r in out)
    taken = mixing.mix(odd, labels, {"all": 1.0}, scale=2.0)
    assert taken.columns == odd.columns and taken.count() == sum(r.copies for r in out)
    assert mixing.mix(odd.limit(0), labels, {"all": 1.0}).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, []
    items = rows_of(sf_dir, "benchmark", "item_id", "text")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(path := fresh_dir(spark, name))
            docs = spark.read.parquet(path)
            after = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "quality_rules":
            assert set(after) <= set(before) and not any(brute.base(t)[-1] for _, t in after) and len(after) > 0.6 * len(before)
        elif name == "near_duplicates":
            assert [i for i, _ in after] == [i for i, _, c in brute.simhash(before) if i == c]
        elif name == "decontamination":
            assert [i for i, _ in after] == [r[0] for r in brute.contaminated(before, items) if not r[-1]]
        elif name == "mixture":
            labels = dict(rows_of(sf_dir, "labels", "doc_id", "toxic"))
            kept = {i for i, _ in after}
            clean = [i for i, _ in before if labels.get(i) == 0]
            toxic = [i for i, _ in before if labels.get(i) == 1]
            assert kept <= {i for i, _ in before} and np.mean([i in kept for i in clean]) > 0.95 and np.mean([i in kept for i in toxic]) < 0.5
        else:
            rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect())
            assert rows == brute.token_rows(before, tokenfiles.encoder(queries.tokenizer_path()).tokenizer)

"""What operators move when they run."""

import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import exchange, linejoin, warc
from faultline.llm import kernels as K

PAGES = [(k, f"{k} " + hashlib.sha256(str(k).encode()).hexdigest() * 20) for k in range(300)]


def shuffled(plan):
    """Bytes that the exchanges of a plan that ran wrote."""
    kind = plan.getClass().getSimpleName()
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = plan.children()
    return own + sum(map(shuffled, below + [children.apply(k) for k in range(children.size())]))


@pytest.mark.parametrize(("slots", "moved"), [(1 << 24, 60_000), (1, 10**9)])
def test_warc_moves_only_payloads_that_may_repeat(spark, monkeypatch, slots, moved):
    """Whatever the slots say, the result is the same; with enough of them, payloads that occur once stay in place."""
    monkeypatch.setattr(warc, "SLOTS", slots, raising=False)
    rows = [*PAGES, (900, PAGES[7][1]), (901, PAGES[7][1]), (902, PAGES[8][1]), (903, None), (904, "short"), (905, "short")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no race decides whether a join moves its rows
    try:
        out = warc.decide(spark.createDataFrame([(k, "u", t) for k, t in rows], "page_id long, url string, html string"))
        said = {r.page_id: (len(r.payload), r.digest, r.refers_to) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert said == {i: (n, d, f) for i, n, d, _, f in brute.warc(rows)}
    assert shuffled(out._jdf.queryExecution().executedPlan()) < moved


def test_lines_are_cut_into_words_twice(monkeypatch):
    """What is sent after the sets needs the hashes of the prefix words only, and finds them where they were noted."""
    words = [f"w{k}é" for k in range(900)]
    lines = ["  ".join(words[(k * 37 + j * j) % 900] for j in range(k % 150)) for k in range(600)]
    docs = exchange.Docs(np.arange(60), K.text_of(pa.array(["\n".join(lines[k : k + 10]) for k in range(0, 600, 10)])))
    sent = {b: p for b, _, p in linejoin._send_sets(np.zeros(linejoin.SLOTS, np.uint16), 4)(0, docs) if b < 0}
    index, prefix = (exchange.unpack(sent[k]) for k in (linejoin.INDEX, linejoin.PREFIX))
    owned = np.arange(len(index[2])) % 3 > 0
    with monkeypatch.context() as m:
        m.setattr(K, "find_words", None)  # a second look for words would fail
        known = linejoin._known(docs, [[owned.astype(np.uint8)], index, prefix])
        rows = linejoin._send_prefixes(4)(0, docs, [[owned.astype(np.uint8)], index, prefix])
    first, tokens = linejoin._sets(docs, known.at)  # by hash, as all words are of one rarity here
    n = np.diff(first)
    assert n.tolist() == known.size.tolist() and len(n) and set(known.at) < set(index[0])
    want = [tokens[a : a + p] for a, p in zip(first, linejoin._prefix(n), strict=False)]
    assert known.tokens.tolist() == np.concatenate(want).tolist() and sum(len(exchange.unpack(p.as_py())[0]) for p in rows.column(2)) == len(known.tokens)
    assert all((a == b).all() for a, b in zip(known.marks, linejoin._sketches(first, tokens), strict=True))
    assert known.ids.tolist() == docs.ids[linejoin._rows(docs, known.at)[0]].tolist()


def test_size_classes():
    """Sizes that can match are in one class or in neighbours."""
    n = np.arange(1, 3000)
    kind = linejoin._size_class(n)
    for a in n.tolist():
        fits = n[(n >= a) & (9 * a >= 4 * (n + a))]  # all of the smaller set is shared
        assert (kind[fits - 1] - kind[a - 1] <= 1).all() and (kind[fits - 1] >= kind[a - 1]).all()

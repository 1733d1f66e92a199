"""Cases that the review of round 1 named."""

import numpy as np
import pyarrow as pa
import pytest
from test_contracts import rows_of

import corpus_pipeline
from faultline.llm import kernels as K
from faultline.llm import mixing, queries, tokenfiles


@pytest.fixture(scope="module")
def mixed(spark):
    """Of documents that the other stages leave as they are: ids and copies after the mixing stage."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sf_dir, docs, [r.doc_id for r in corpus_pipeline.mixture(spark, docs, sf_dir).select("doc_id").collect()]


def test_no_toxic_documents_after_mixing(mixed):
    sf_dir, docs, ids = mixed
    labels = {i: (q, t) for i, q, t in rows_of(sf_dir, "labels", "doc_id", "quality", "toxic")}
    toxic = {i for i, (_, t) in labels.items() if t == 1}
    good = {i for i, (q, t) in labels.items() if (q, t) == (1, 0)}
    assert toxic and not toxic & set(ids) and len(good & set(ids)) > 0.95 * len(good)
    low = [i for i in ids if labels.get(i) == (0, 0)]
    assert len(low) <= sum(x == (0, 0) for x in labels.values())


def test_only_the_anchor_grows(spark):
    members = spark.createDataFrame([(1, 1000, [1.0, 0.0]), (2, 3, [0.0, 1.0])], "doc_id long, n_tokens long, p array<double>")
    assert mixing.targets_of(members, ("a", "b"), {"a": 0.9, "b": 0.1}, anchor="a", scale=1.1, only_anchor_grows=True) == pytest.approx({0: 1100, 1: 3})


def test_a_label_decides_before_the_posterior(spark):
    members = spark.createDataFrame([(k, 5, p) for k, p in ((1, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [0.1, 0.9]), (4, [0.9, 0.1]), (None, [0.1, 0.9]))], "doc_id long, n_tokens long, p array<double>")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    told, domains = mixing.without(members, labels, ("quality1_toxic0", "quality1_toxic1"), {"toxic": 1})
    assert domains == ("quality1_toxic0",) and {r.doc_id: r.gone for r in told.collect()} == {1: True, 2: False, 3: True, 4: False, None: True}
    assert mixing.without(members, labels, ("quality1_toxic1",), {"toxic": 1})[1] == ("all",)


def test_fit_goes_on_past_its_gradient_rounds(spark, recwarn):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 500, 300)
    a = 0.5 + 0.02 * rng.standard_normal(300)  # domains that hardly differ
    p = np.stack([a, 1 - a], 1)
    members = spark.createDataFrame([(k, int(x), y.tolist()) for k, (x, y) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    wanted = (n[:, None] * p).sum(0) * [1.02, 0.98]
    out, have = mixing.fit_rates(members, dict(enumerate(wanted)), 2)
    assert np.allclose(have, wanted, rtol=2e-4) and not [w for w in recwarn if "mixing" in str(w.message)]
    assert out.agg({"rate": "min"}).first()[0] >= 0
    with pytest.warns(UserWarning, match="not met"):
        mixing.fit_rates(members, {0: 1000.0, 1: 0.0}, 2)


def test_more_chunks_than_the_table_takes(monkeypatch):
    texts = K.text_of(pa.array(["", " ".join(f"w{k} same" for k in range(300)), "w1 w2 new", "tail"]))
    ids, first = tokenfiles.Encoder(queries.tokenizer_path()).encode(texts)
    monkeypatch.setattr(tokenfiles, "SLOTS", 128)
    monkeypatch.setattr(tokenfiles, "MOST", 64)
    small = tokenfiles.Encoder(queries.tokenizer_path())
    for _ in range(2):
        got = small.encode(texts)
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == first.tolist()

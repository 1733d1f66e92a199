"""The queries that have contracts, against plain Python on the small table, and each operator's edge cases."""

import brute
import pyarrow.parquet as pq
import pytest

from faultline.llm import decontaminate, quality, queries, simhash, tokenfiles, warc
from faultline.llm.common import fresh_dir

EDGE = [None, "", " \n\t ", "one", "two words", "x" * 50_000, "Same text, said twice over and over again by all of us here today my friend.", "Same text, said twice over and over again by all of us here today my friend.", "a  b c \x1c d\r\n\r\ne", "日本 語　x"]


def rows_of(sf_dir, table, *columns):
    return list(zip(*(c.to_pylist() for c in pq.read_table(f"{sf_dir}/{table}.parquet", columns=list(columns)).columns), strict=True))


@pytest.fixture(scope="module")
def documents(sf_dir):
    return rows_of(sf_dir, "documents", "doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, and a clashing extra column."""
    rows = [(k, t, 1) for k, t in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


BASE = ("doc_id", *quality.BASE, "base_failed")


def test_quality(spark, sf_dir, documents):
    out = queries.op1_quality_rules(spark, sf_dir).cache()
    assert got(out, *BASE) == sorted((i, *brute.base(t)) for i, t in documents)
    assert out.where("base_failed and kept").count() == 0
    labels = dict(rows_of(sf_dir, "labels", "doc_id", "quality"))
    kept = dict(got(out.where("not base_failed"), "doc_id", "kept"))
    both = [kept[i] == bool(q) for i, q in labels.items() if i in kept]
    assert sum(both) >= 0.95 * len(both)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.fit(odd, labels) is None
    out = quality.assess(odd, None)
    assert got(out, *BASE) == sorted((k, *brute.base(t)) for k, t in enumerate(EDGE))
    assert quality.keep_good(odd, None).columns == odd.columns
    assert quality.assess(odd.limit(0), None).count() == 0


def test_forest_is_monotone_and_flat():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.2 * rng.random(600) > 0.6) & (x[:, 2] < 0.8)).astype(float)
    forest = quality.train(x, y, monotone=(1, 0, -1), trees=30)
    assert ((forest.score(x) > 0) == (y > 0)).mean() > 0.95
    for column, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, column] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) * sign >= -1e-12).all()

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    assert np.allclose(forest.score(x[:20]), [forest.bias + sum(walk(r, n) for n in forest.roots) for r in x[:20]])


def test_simhash(spark, sf_dir, documents):
    assert got(queries.op2_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id") == brute.simhash(documents)


def test_simhash_odd(spark, odd):
    assert got(simhash.classes(odd), "doc_id", "fingerprint", "component_id") == brute.simhash(list(enumerate(EDGE)))
    assert simhash.classes(odd.limit(0)).count() == 0
    assert got(simhash.keep_one(odd), "doc_id") == [(i,) for i, _, c in brute.simhash(list(enumerate(EDGE))) if i == c]


@pytest.mark.parametrize("segments", [64, 32, 16, 8])
def test_grid_links_crowds_exactly(spark, segments):
    import random

    rng = random.Random(3)
    prints = set()
    for _ in range(12):  # a chain and a crowd around each centre
        centre = rng.getrandbits(64)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    prints = sorted(prints | {0, 1, 2**63, 2**64 - 1})
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    points = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    place = {p: k for k, p in enumerate(signed)}
    found = [(place[r.a], place[r.b]) for r in simhash.links(points, segments).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in found)
    assert brute.union_find(len(prints), found) == brute.union_find(len(prints), pairs)


DECON = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate(spark, sf_dir, documents):
    items = rows_of(sf_dir, "benchmark", "item_id", "text")
    assert got(queries.op7_decontaminate(spark, sf_dir), *DECON) == brute.contaminated(documents, items)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontaminate_odd(spark, odd, block):
    items = [(1, "two WORDS"), (2, None), (3, "..."), (10, EDGE[6]), (11, EDGE[6]), (4, "two words"), (5, "by all of us here today my friend again and again and again and more")]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string")
    assert got(decontaminate.inspect(odd, bench, block_bytes=block), *DECON) == brute.contaminated(list(enumerate(EDGE)), items)
    assert got(decontaminate.remove_contaminated(odd, bench, block_bytes=block), "doc_id") == [(0,), (1,), (2,), (3,), (5,), (8,), (9,)]
    assert decontaminate.inspect(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.inspect(odd.limit(0), bench).count() == 0
    found = {(r.doc_id, r.word, r.item_id, r.item_word, r.length) for r in decontaminate.matches(odd, bench, block_bytes=block).collect()}
    assert found == {(4, 0, 1, 0, 2), (4, 0, 4, 0, 2), (6, 0, 10, 0, 16), (6, 0, 11, 0, 16), (7, 0, 10, 0, 16), (7, 0, 11, 0, 16)}


TOKENS = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_token_files(spark, sf_dir, documents):
    tokenizer = tokenfiles.encoder(queries.tokenizer_path()).tokenizer
    assert got(queries.op8_token_files(spark, sf_dir), *TOKENS) == brute.token_rows(documents, tokenizer)


def test_token_files_odd(spark, odd):
    tokenizer = tokenfiles.encoder(queries.tokenizer_path()).tokenizer
    out = fresh_dir(spark, "tokens")
    rows = [(k, t) for k, t in enumerate(EDGE)]
    assert got(tokenfiles.read(spark, out, tokenfiles.write(odd, out, queries.tokenizer_path())), *TOKENS) == brute.token_rows([(k, t or "") for k, t in rows], tokenizer)
    out = fresh_dir(spark, "tokens")
    assert tokenfiles.read(spark, out, tokenfiles.write(odd.limit(0), out, queries.tokenizer_path())).count() == 0


def test_encoder_table_is_begun_anew(monkeypatch):
    import pyarrow as pa

    from faultline.llm import kernels

    monkeypatch.setattr(tokenfiles, "MOST", 8)
    encoder = tokenfiles.Encoder(queries.tokenizer_path())
    for text in ("some words that fill the table", "others that do not fit beside them", "some words again"):
        ids, first = encoder.encode(kernels.text_of(pa.array([text])))
        assert ids[first[0] : first[1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


WARC = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_warc(spark, sf_dir):
    out = queries.op10_warc(spark, sf_dir)
    assert sorted(map(tuple, out.select(*WARC).collect())) == brute.warc(rows_of(sf_dir, "pages", "page_id", "html"))
    assert out.where("fault is not null").count() == 0


def test_warc_odd(spark):
    rows = [(k, t) for k, t in enumerate([*EDGE, "é" * 70, "é" * 70, "y" * 99, "y" * 99])]
    pages = spark.createDataFrame([(k, None if k % 2 else "http://x /é", t, "x") for k, t in rows], "page_id long, url string, html string, digest string")
    out = fresh_dir(spark, "warc")
    assert sorted(map(tuple, warc.read(spark, out, warc.write(pages, out, segment_bytes=300, chunk_bytes=7)).select(*WARC).collect())) == brute.warc(rows)
    out = fresh_dir(spark, "warc")
    assert warc.read(spark, out, warc.write(pages.limit(0), out)).count() == 0


def test_warc_faults():
    import io

    data = b"".join(warc.page_records("x", 1, "http://a", "0" * 64, None, b"payload " * 100, 128, 50))
    parts = [{"segment": int(f["warc-segment-number"]), "total": int(t) if (t := f.get("warc-segment-total-length")) else None, "page_id": 1, "kind": "response", "refers_to": None, "stated": f.get("warc-payload-digest"), "block": b} for f, b in warc.records(io.BytesIO(data))]
    assert warc.page_of(parts)["fault"] == "the payload is not what its digest says"
    assert warc.page_of(parts[:-1])["fault"] == warc.page_of(parts[1:])["fault"] == "segments are missing"
    assert warc.page_of([*parts[:-1], parts[-1] | {"total": 5}])["fault"] == "the segments' length is not the total"
    broken = [p | {"block": p["block"].replace(b"32\r\n", b"zz\r\n")} for p in parts]
    assert warc.page_of(broken)["fault"] == "the framing is broken"


def test_warc_damaged_and_foreign(spark, tmp_path):
    import gzip

    good = list(warc.page_records("x", 1, "http://a", "0" * 64, None, b"p" * 200))
    foreign = [warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"about"), warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "X-Page-Id": 2}, b"HTTP/1.1 200 OK\r\n\r\nbody"), warc.record({"WARC-Type": "response", "WARC-Record-ID": "<b>", "X-Page-Id": 3, "WARC-Payload-Digest": "sha1:ABC"}, b"HTTP/1.1 200 OK\r\n\r\nbody"), warc.record({"WARC-Type": "revisit", "WARC-Record-ID": "<c>", "X-Page-Id": 4}, b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"), warc.record({"WARC-Type": "revisit", "WARC-Record-ID": "<d>", "X-Page-Id": 5, "X-Refers-To-Page-Id": 99, "WARC-Payload-Digest": "sha256:00"}, b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n")]
    whole = gzip.compress(b"".join(foreign))
    files = {"a.gz": whole, "b.gz": gzip.compress(b"".join(foreign[:3]))[:-30], "c.gz": b"no gzip", "d.gz": gzip.compress(b"no archive"), "e.gz": gzip.compress(good[0][:-150])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(n, 1) for n in files], "file string, n_pages long")
    out = warc.read(spark, str(tmp_path), manifest).collect()
    rows = {r.page_id: (r.payload_bytes, r.fault) for r in out if r.page_id}
    assert rows[2] == rows[3] == (4, None)
    assert rows[4] == (None, "the revisit states no SHA-256 digest") and rows[5] == (None, "the response it names is not there")
    assert sum(str(r.fault).startswith("the archive is damaged") for r in out) == 4


CLASH = ("own_id", "copies", "gone", "_gone", "_copies", "_hit", "_words", "_items", "hot", "cold", "salt", "_facts", "n", "fp", "digest", "first", "_id", "_at", "batch", "rate", "domain", "p")


def test_names_that_clash(spark):
    """Each stage keeps columns with the names that operators use themselves."""
    from faultline.llm import mixing

    text = "the cat sat on the mat and looked at all the birds that sang in the tall trees by the old stone wall today"
    rows = [(k, text if k < 3 else f"{text} number {k}", *(f"{c}{k}" for c in CLASH)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    docs = docs.union(docs.where("doc_id = 4"))  # a repeated row
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "number 3")], "item_id long, text string")
    mine = lambda ids: sorted((rows[i] for i in ids), key=str)
    kept = lambda df: sorted(map(tuple, df.select(docs.columns).collect()), key=str)
    assert kept(simhash.keep_one(docs)) == mine([i for i, _, c in brute.simhash([r[:2] for r in rows]) if i == c for _ in range(1 + (i == 4))])
    assert kept(decontaminate.remove_contaminated(docs, bench)) == mine([0, 1, 2, 4, 4])
    assert set(kept(mixing.mix(docs, labels, {"all": 1.0}))) <= set(rows)
    assert quality.keep_good(docs, None).columns == docs.columns


def test_hot_keys_are_dealt(spark):
    """A key that 90 % of the rows have spreads over the join's tasks when nothing else is broadcast."""
    from pyspark.sql import functions as F

    from faultline.llm.common import keep, with_facts

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    facts = keep(rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        met = with_facts(rows, facts, "key", F.col("id"))
        sizes = met.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 0.5 * 20_000 and sum(r["count"] for r in sizes) == 20_000
        assert met.where("key = 'hot' and least != 1 or key != 'hot' and least != id").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_rows_null_ids_and_long_texts(spark):
    """Each operator returns a row for each row: ids that repeat, ids that are null, texts of over a step's 512 KB."""
    import hashlib

    from faultline.llm import katz, linejoin, mixing, substring

    short = " ".join(f"t{k}" for k in range(30))
    long = "\n".join(" ".join(f"w{k * 10 + j}" for j in range(10)) for k in range(12_000))
    rows = [(1, short), (1, short), (None, short + " z"), (None, None), (2, long), (3, long + " x"), (4, "")]
    assert len(long) > 700_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = sorted(str(i) for i, _ in rows)
    own = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())

    out = quality.assess(docs, None).cache()
    assert own(out) == ids and sorted(out.where("doc_id in (1, 2)").select("doc_id", "n_words").collect()) == [(1, 30), (1, 30), (2, 120_000)]
    out = simhash.classes(docs).cache()
    assert own(out) == ids and {r.component_id for r in out.where("doc_id = 3").collect()} == {2}
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).select("doc_id").collect()) == [0, 0, 1, 1, 2, 4]

    out = substring.remove_repeats(docs).cache()
    assert own(out) == ids
    # null ids come first, so both rows with id 1 repeat the text before them; document 3 keeps its last word
    assert sorted((r.doc_id, r.n_removed) for r in out.where("doc_id in (1, 2, 3)").collect()) == [(1, 30), (1, 30), (2, 0), (3, 120_000)]
    assert out.where("doc_id = 3").first().kept_sha256 == hashlib.sha256(b"x").hexdigest()
    out = linejoin.remove_similar_lines(docs).cache()
    assert own(out) == ids and sorted((r.doc_id, r.n_removed) for r in out.where("doc_id in (1, 2, 3)").collect()) == [(1, 1), (1, 1), (2, 0), (3, 12_000)]
    bench = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(119_995, 120_000))), (7, "t28 t29 z")], "item_id long, text string")
    out = decontaminate.inspect(docs, bench).cache()
    assert own(out) == ids and sorted((r.doc_id or 0, r.n_hit) for r in out.where("contaminated").collect()) == [(0, 3), (2, 5), (3, 5)]
    out = tokenfiles.read(spark, where := fresh_dir(spark, "tokens"), tokenfiles.write(docs, where, queries.tokenizer_path())).cache()
    assert own(out) == ids and out.where("doc_id = 1").select("ids_crc32").distinct().count() == 1
    starts = sorted((r.start, r.n_tokens) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    out = katz.score(docs).cache()
    assert own(out) == ids and out.where("doc_id = 1").select("score").distinct().count() == 1
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert own(mixing.rates(docs, labels, {"quality1_toxic0": 0.5, "quality0_toxic1": 0.5})) == ids
    pages = docs.select(docs.doc_id.alias("page_id"), docs.text.alias("url"), docs.text.alias("html"))
    out = warc.read(spark, where := fresh_dir(spark, "warc"), warc.write(pages, where))
    assert sorted((str(r.page_id), r.fault) for r in out.collect()) == [(i, None) for i in ids]

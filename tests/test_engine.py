"""Golden cases of framing, parsing, normalisation, learning, rates, views, redaction and records."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.config import ConfigError, Tuning, parse, resolve
from faultline.functions import exception, header, normalize, rate, redact, text, time
from faultline.operators import framing, groups, learner, records, views
from faultline.plans import batch
from faultline.sources import lines as li

H = "26.08.2026 12:00:00.000 author-0 *ERROR* [main] com.example.Foo "


def arrival():
    return F.to_timestamp(F.lit("2026-08-26T20:00:00Z"))


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def framed(spark, data: bytes, tmp_path, **tuning):
    path = tmp_path / f"{random.random()}.log"
    path.write_bytes(data)
    events, diagnostics = framing.frame(li.read_log(spark, str(path)), Tuning(**tuning))
    return [r.text for r in events.orderBy("seq").collect()], [tuple(r)[1:] for r in diagnostics.orderBy("line").collect()]


def stamp(i):
    return f"26.08.2026 12:{i // 60 % 60:02}:{i % 60:02}.{i % 1000:03}"


def mixed_guard():
    out = [f"{stamp(i)} author-{0 if i % 3 == 0 else 1} *ERROR* [main] com.example.Foo Failed to start bundle" for i in range(12)]
    out += [f"{stamp(20 + i)} author-0 *ERROR* [main] com.example.Foo Resource not found /content/site/{c}/en.html" for i, c in enumerate(("us", "de", "fr", "it", "es"))]
    bridge = ("alpha beta gamma delta epsilon", "alpha other unique novel epsilon", "alpha BETA gamma delta epsilon", "alpha beta GAMMA delta epsilon", "alpha OTHER unique novel epsilon", "alpha other UNIQUE novel epsilon")
    out += [f"26.08.2026 12:00:3{i}.000 author-0 *ERROR* [main] com.example.Merge {m}" for i, m in enumerate(bridge)]
    stack = "\njava.lang.RuntimeException: boom" + "".join(f"\n\tat com.example.Foo.frame{k}(Foo.java:{k})" for k in range(6))
    out += [f"26.08.2026 12:00:4{i}.000 author-0 *ERROR* [main] com.example.Foo Uncaught exception{stack}" for i in range(2)]
    out += ["26.08.2026 12:00:50.000 author-0 *WARN* [main] com.example.Foo ignored warn", "26.08.2026 12:00:51.000 author-0 *INFO* [main] com.example.Foo ignored info"]
    return ("\n".join(out) + "\n").encode()


@pytest.fixture(scope="module")
def guard(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("guard") / "guard.log"
    path.write_bytes(mixed_guard())
    return batch.analyze(li.read_log(spark, str(path)), Tuning(levels=("ERROR", "WARN")), arrival())


def test_mixed_guard(guard):
    rows = [(r.id, r["count"], " ".join(r.template)) for r in views.by_id(guard.groups).collect()]
    assert rows == [(1, 12, "Failed to start bundle"), (2, 5, "Resource not found <*>"), (3, 6, "alpha <*> <*> <*> epsilon"), (5, 2, "Uncaught exception"), (6, 1, "ignored warn")]
    assert guard.analysis.overflow.count() == 0 and guard.diagnostics.count() == 0
    assert views.checksum(guard.groups, guard.analysis.overflow) == 12755843614500604807
    found = {r.id: r for r in guard.groups.collect()}
    assert found[1].nodes == ["author-0", "author-1"] and found[5].terminal_exception == "java.lang.RuntimeException"
    assert found[3].sample.endswith("alpha beta gamma delta epsilon\n")
    assert views.counters(guard.analysis.events, guard.diagnostics).first().selected_events == 26


def test_records(spark, guard):
    t = Tuning(levels=("ERROR", "WARN"))
    ids = groups._ids(guard.analysis.log, guard.analysis.facts)
    parts = [records.session_started(spark, "s", t, "1", "2", "author", "x"), records.created(guard.analysis, ids, "s", t).orderBy("seq").select("value"), records.merged(guard.analysis, ids, "s").select("value"), records.updated(guard.groups, "s"), records.source_ended(spark, "s", None, b"x" * 70_000 + b" token=abc", t)]
    found = [[r.value for r in p.collect()] for p in parts]
    assert [len(x) for x in found] == [1, 6, 1, 5, 1]
    assert all(records.check(line) is None for x in found for line in x)
    first, merge, end = json.loads(found[1][0]), json.loads(found[2][0]), json.loads(found[4][0])
    assert first["terminal_exception"] is None and "time_fallback" not in first and first["source_offsets"]["level"] == {"start": 34, "end": 39}
    assert (merge["group_id"], merge["removed_id"], merge["count"]) == (3, 4, 6)
    assert end["status"] is None and end["stderr_truncated"] and end["stderr"].endswith("[REDACTED:token]")
    assert records.check(json.dumps(first | {"more": 1})) and records.check("{}") and records.check('{"type": NaN}')


def test_framing(spark, tmp_path):
    event = H + "msg\n"
    assert framed(spark, b"not a log line\nmore garbage\n" + event.encode(), tmp_path) == ([event], [("unframed_prefix", 28, "not a log line\n", 1, 0)])
    body = event + "X"
    assert framed(spark, body.encode(), tmp_path, event_max_bytes=len(event)) == ([event], [("event_byte_limit", 1, "X", 2, len(event))])
    assert framed(spark, body.encode(), tmp_path, event_max_bytes=len(body)) == ([body], [])
    three = event + "a\nbb\n"
    assert framed(spark, three.encode(), tmp_path, event_max_lines=3) == ([three], [])
    assert framed(spark, three.encode(), tmp_path, event_max_lines=2) == ([event + "a\n"], [("event_line_limit", 3, "bb\n", 3, len(event) + 2)])
    long = event + "y" * 500 + "\nz\n" + event
    cap = len(event) + 10
    assert framed(spark, long.encode(), tmp_path, event_max_bytes=cap) == ([event + "y" * 10, event], [("event_byte_limit", 493, "y" * (cap + 1 - 10), 2, cap)])
    crlf = event.replace("\n", "\r\n") + "\r\n\r\n\tat x\r\n"
    assert framed(spark, crlf.encode(), tmp_path) == ([crlf], [])
    bad = H.encode() + b"a\xffb\n"
    assert framed(spark, bad, tmp_path) == ([H + "a�b\n"], [("invalid_utf8", 1, H + "a�b\n", 1, len(H) + 1)])
    assert framed(spark, b"x" * 10_000, tmp_path, sample_max_bytes=64)[1] == [("unframed_prefix", 10_000, "x" * 64, 1, 0)]
    small = Tuning(event_max_bytes=20)
    rows = spark.createDataFrame([("s", event)], "s string, t string")
    # a cap shorter than the header: the boundary test sees one byte more than the cap, so there is no event
    events, lost = framing.frame(li.from_text(rows, "s", "t"), small)
    assert events.count() == 0 and [tuple(r)[1:] for r in lost.collect()] == [("unframed_prefix", len(event), event[:21], 1, 0)]


def test_lines_over_splits(spark, tmp_path):
    data = b"".join(b"%d %s\n" % (k, b"x" * (k % 50)) for k in range(3000)) + b"tail"
    (tmp_path / "a.log").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = li.read_log(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in rows] == list(range(1, 3002)) and b"".join(bytes(r.raw) + (b"\n" if r.ended else b"") for r in rows) == data
    assert all(data[r.offset : r.offset + r.size].startswith(bytes(r.raw)) for r in rows) and len({r.block for r in rows}) > 3


def test_headers(spark):
    nested = "26.08.2026 12:00:00.000 author-0 *ERROR* [192.0.2.10 [1724666401456] GET /content/site/us/en.html HTTP/1.1] com.example.Servlet failed\n\tat x"
    cases = [H + "m", nested, "26.08.2026 12:00:00.000 n *ERROR* main msg", "26.08.2026 12:00:00.000 n *ERROR* [a [b] msg", H.replace("ERROR", "NOPE"), "26.08.2026 12:00:00.000", "26.08.2026 12:00:00.000 n *WARN* [" + "x" * 200_000 + "] hello", "26.08.2026 12:00:00.000 n *WARN* [com.a.B] hello there"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string")
    got = header.parse(rows, "t").withColumn("is", header.is_header(F.col("t"))).orderBy("k").collect()
    assert [r["is"] for r in got] == [True, True, False, False, False, False, True, True]
    assert (got[0].logger, got[0].message, got[0].node, got[0].request_context) == ("com.example.Foo", "m", "author-0", None)
    assert tuple(got[1].request_context) == ("192.0.2.10", "1724666401456", "GET", "/content/site/us/en.html", "HTTP/1.1") and got[1].message == "failed"
    assert (got[6].logger, got[6].message, got[7].logger, got[7].message) == ("unknown", "hello", "com.a.B", "hello there")
    line = cases[0].encode()
    assert {n: line[o.start : o.end].decode() for n, o in got[0].offsets.asDict().items()} == {n: got[0][n] for n in ("timestamp", "node", "level", "thread", "logger", "message")}


def test_exceptions(spark):
    def identity(body, message="m"):
        return tuple(spark.createDataFrame([(body, message)], "e string, m string").select(exception.terminal_identity(F.col("e"), F.col("m")).alias("r")).first().r)

    assert identity("h\njava.lang.A: x\n\tat a.B.c(B.java:1)\nCaused by: org.x.Y\n\tat app/p.Q.<init>(Q.java)\n\tat p.Q.z(Q.java)") == ("org.x.Y", "p.Q.<init>")
    assert identity("h\nCaused by: a.B: x\r\n\tat a.B.c(X)\r\n\tSuppressed: c.D\r\n") == ("c.D", None)
    assert identity("h", "java.io.IOException: gone") == ("java.io.IOException", None)
    assert identity("h\nthe java.lang.Error happened\n\tat a.B.c(X)") == (None, None)


def test_normalize(spark):
    cases = {
        "id 550e8400-e29b-41d4-a716-446655440000 done": "id <*> done", "from 192.0.2.1 via 2001:db8::1": "from <*> via <*>", "at 26.08.2026 12:00:00.123 or 2026-08-26T12:00:00.123Z": "at <*> <*> or <*>", "took 1500ms then 2s": "took <*> then <*>",
        "GET /content/site/us/en.html?foo=bar&x=1": "GET /content/site/us/en.html?foo=<*>&x=<*>", "obj com.example.Foo@6d06d69c": "obj com.example.Foo@<*>", "n 1234 ok 42": "n <*> ok 42", "status 200 path /content/site/us/en.html": "status 200 path /content/site/us/en.html",
        "[::1]:80 [10.0.0.1] 1.2.3 deadbeef <*> 12µs": "<*> <*> 1.2.3 <*> <*> <*>",
    }
    rows = spark.createDataFrame(list(cases.items()), "m string, want string").withColumn("t", normalize.normalize(F.col("m")))
    rows = rows.withColumn("again", normalize.normalize(F.array_join("t", " ")))
    for r in rows.collect():
        assert " ".join(r.t) == r.want and r.again == r.t


def test_store():
    def store(*templates, t=0.6, cap=100):
        s = learner.Store(t, cap)
        s.slots, s.live = [tuple(x.split()) for x in templates], len(templates)
        return s

    s = store("a b c d e", "a b x y z")
    assert s.learn(("a", "b", "q", "y", "e")).slot == 0 and s.slots[0] == ("a", "b", "<*>", "<*>", "e")
    s = learner.Store(0.6, 2)
    out = [s.learn(tuple(m.split())) for m in ("alpha beta gamma delta epsilon", "alpha other unique novel epsilon", "alpha BETA gamma delta epsilon", "alpha beta GAMMA delta epsilon", "alpha OTHER unique novel epsilon", "alpha other UNIQUE novel epsilon")]
    assert out[-1].merges == (learner.Merge(0, 1),) and s.slots == [("alpha", "<*>", "<*>", "<*>", "epsilon"), None]
    assert s.learn(tuple("p q r s t".split())).slot == 2 and s.learn(tuple("v w x y z".split())).kind == learner.CAPACITY
    s = learner.Store(1.0, 5)
    kinds = [s.learn((f"u{k}", "x")).kind for k in range(40)]
    assert kinds.count(learner.CREATED) == 5 and kinds.count(learner.CAPACITY) == 35


@pytest.mark.parametrize("seed", range(25))
def test_distinct_learning_is_sequential_learning(seed):
    rng = random.Random(seed)
    size = rng.randint(3, 6)
    events = [(k, tuple(rng.choice("abc") for _ in range(size))) for k in range(200)]
    seen, first = set(), []
    for k, t in events:
        if t not in seen:
            seen.add(t)
            first.append((k, t))
    a, b = learner.Store(0.6, 1000), learner.Store(0.6, 1000)
    by_event = learner.run_bucket(iter(events), a, False)
    by_vector = learner.run_bucket(iter(first), b, True)
    assert a.slots == b.slots
    spans = [(r[1], r[2], tuple(r[3]), r[4]) for r in by_vector.rows if r[0] == "assigned"]
    want = {r[1]: r[4] for r in by_event.rows if r[0] == "assigned"}
    for k, t in events:
        assert [s for lo, hi, v, s in spans if v == t and lo <= k <= hi] == [want[k]]
    logs = [[r for r in x.rows if r[0] in ("created", "merged", "lineage")] for x in (by_event, by_vector)]
    assert logs[0] == logs[1]


def test_rates(spark):
    base = dt.datetime(2026, 8, 26, 12, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([(base,), (base + dt.timedelta(seconds=10),)], "t timestamp")
    now = F.lit(base + dt.timedelta(seconds=10))
    assert math.isclose(rows.agg(rate.rate(F.col("t"), now, 10)).first()[0], math.log(2) / 10 * 1.5, abs_tol=1e-12)
    assert one(spark, lambda x: rate.rounded(x), 0.0005, "double") == 0.001 and one(spark, lambda x: rate.rounded(x), float("inf"), "double") == 0
    assert one(spark, lambda x: rate.ratio(x, F.lit(0.0)), 1.0, "double") == math.inf
    for age, want in ((60, True), (61, False)):
        assert one(spark, lambda x, a=age: rate.is_new(F.to_timestamp(x), F.to_timestamp(x) + F.expr(f"interval {a} second"), 60), "2026-01-01 00:00:00") is want


@pytest.mark.parametrize(
    ("zone", "wall", "want"),
    [
        ("utc", "26.08.2026 12:00:00.123", ("2026-08-26T12:00:00.123Z", None)),
        ("Asia/Tokyo", "26.08.2026 02:00:00.000", ("2026-08-25T17:00:00.000Z", None)),
        ("America/New_York", "26.08.2026 12:00:00.000", ("2026-08-26T16:00:00.000Z", None)),
        ("America/New_York", "08.03.2026 02:30:00.000", ("2026-08-26T20:00:00.000Z", "nonexistent_wall_time")),
        ("America/New_York", "01.11.2026 01:30:00.000", ("2026-08-26T20:00:00.000Z", "ambiguous_wall_time")),
        ("utc", "31.02.2026 12:00:00.000", ("2026-08-26T20:00:00.000Z", "nonexistent_wall_time")),
    ],
)
def test_time(spark, zone, wall, want):
    row = spark.createDataFrame([(wall,)], "x string").select(time.interpret(F.col("x"), zone, arrival()).alias("t")).select(time.rfc3339(F.col("t.instant")), "t.fault").first()
    assert tuple(row) == want


def test_redact(spark):
    cases = {
        "Authorization: Basic abc123 x": "Authorization: [REDACTED:authorization] x", "got Bearer abcdefgh12": "got Bearer [REDACTED:bearer]", "Bearer token missing": "Bearer token missing", "authorization failed": "authorization failed",
        "jwt eyJa.eyJb.c-d": "jwt [REDACTED:jwt]", "pwd='a b' x": "pwd=[REDACTED:password] x", "api_key: k1": "api_key: [REDACTED:api_key]", "refresh-token = t1": "refresh-token = [REDACTED:token]", "/a?b=c&d=e#f": "/a?b=[REDACTED:query]&d=[REDACTED:query]#f",
        "mail a.b@c.example": "mail [REDACTED:email]", "ip 192.0.2.1 fe80::1 ::1": "ip [REDACTED:ip] [REDACTED:ip] [REDACTED:ip]", "version 1.2.3": "version 1.2.3", "token count increased": "token count increased",
    }
    rows = spark.createDataFrame(list(cases.items()), "m string, want string").select("want", redact.redact(F.col("m")).alias("got"))
    assert [r.got for r in rows.collect()] == list(cases.values())
    assert one(spark, lambda x: redact.redact(x, ("secret-[0-9]+",)), "secret-12") == "[REDACTED]"


def test_text(spark):
    got = one(spark, lambda x: text.capture(x, 40), "HEAD" + "x" * 100 + "TAIL")
    assert got.text.startswith("HEAD") and got.text.endswith("TAIL") and len(got.text) <= 40 and got.truncated and got.original_lines == 1
    assert one(spark, lambda x: text.capture(x, 5), "é" * 20).text == "éé"
    assert one(spark, text.escape_visible, "a\\\t\r\x01\n\x7f") == "a\\\\\\t\\r\\x01\n\\x7f"
    assert one(spark, text.line_count, "a\nb") == 2 and one(spark, text.line_count, "") == 0


def test_samples_and_nodes(spark):
    assert groups.retained([("created", 2, 2), ("created", 1, 2), ("created", 3, 2)], 4) == {1: 1, 3: 3}
    assert groups.retained([("created", 1, 9)], 4) == {}
    assert groups.retained([("created", 1, 3), ("created", 2, 3), ("merged", 1, 2)], 4) == {1: 2}
    rows = spark.createDataFrame([("g", f"n{k:03}", k) for k in range(300)], "g string, node string, seq long")
    out = groups.node_sets(rows, ["g"]).first()
    assert (len(out.nodes), out.nodes_capped, out.node_count, out.nodes[-1]) == (256, True, 257, "n255")


def events_of(messages, level="ERROR"):
    return [("s", k, f"{stamp(k)} author-0 *{level}* [main] com.example.Foo {m}") for k, m in enumerate(messages)]


def test_caps(spark):
    unique = [f"alpha{k} beta{k} gamma{k}" for k in range(5)]
    frame = spark.createDataFrame(events_of(unique), "source_id string, seq long, text string")
    out = batch.analyze_events(frame, Tuning(bucket_cap=2), arrival())
    over = out.overflow.first()
    assert out.groups.count() == 2 and (over["count"], over.template_bucket, over["global"]) == (3, 3, 0)
    words = [" ".join(f"w{k}x{j}" for j in range(k % 5 + 1)) for k in range(20)]
    frame = spark.createDataFrame(events_of(words + words[:4]), "source_id string, seq long, text string")
    out = batch.analyze_events(frame, Tuning(max_groups=8, similarity=1.0), arrival())
    over = out.overflow.first()
    total = out.groups.agg(F.sum("count")).first()[0]
    assert out.groups.count() == 8 and over["global"] == 12 and total + over["count"] == 24


def test_budget_evicts_oldest(spark):
    frame = spark.createDataFrame(events_of(["one two", "three four five", "six"]), "source_id string, seq long, text string")
    size = len(events_of(["six"])[0][2])
    out = batch.analyze_events(frame, Tuning(sample_max_bytes=size, sample_budget_bytes=2 * size), arrival())
    assert [(r.id, r.sample_available) for r in views.by_id(out.groups).collect()] == [(1, False), (2, True), (3, True)]


def test_views(spark, guard):
    t = Tuning()
    snap = views.snapshot(guard.groups, t).cache()
    assert [r.id for r in views.ranked(snap, "volume").collect()] == [1, 3, 2, 5, 6]
    assert [r.id for r in views.ranked(snap, "new").collect()][0] == 6
    assert views.ranked(snap, "muted").count() == 0
    assert [r.id for r in views.search(guard.groups, "RESOURCE not").collect()] == [2]
    assert [r.id for r in views.search(guard.groups, "re:alpha.*epsilon").collect()] == [3]
    assert views.search(guard.groups, "").count() == 5 and views.search(guard.groups, "re:(").count() == 0 and views.search(guard.groups, "re:" + "a" * 257).count() == 0
    lines = {r.id: r.lines for r in views.detail(guard.groups).collect()}[5]
    assert lines[0] == "id 5" and "exception java.lang.RuntimeException" in lines and lines[13].startswith("26.08.2026")
    assert views.cells(snap).where("id = 1").first().COUNT == "12"
    muted = views.snapshot(guard.groups.withColumn("muted", F.col("id") == 1), t)
    assert [r.id for r in views.ranked(muted, "muted").collect()] == [1]


def test_config():
    assert parse("version = 1\nlevels = ['warn', 'ERROR', 'Warn']\ntimezone = 'Europe/Berlin'\n[rates]\nfast_half_life_secs = 5\n").levels == ("WARN", "ERROR")
    for bad in ("", "version = 2", "version = 1\nx = 1", "version = 1\n[event]\nmore = 1", "version = 1\nlevels = []", "version = 1\n[rates]\nfast_half_life_secs = 300", "version = 1\n[templates]\nsimilarity = 0.4", "version = 1\n[redaction]\nextra_patterns = ['(?=x)']", "version = 1\n[sample]\nmax_bytes = 9\nbudget_bytes = 8"):
        with pytest.raises(ConfigError):
            parse(bad)
    assert resolve(parse("version = 1\nlevels = ['INFO']"), ["fatal"], "utc").levels == ("FATAL",)


def test_command(spark, tmp_path, capsys):
    from faultline.__main__ import main

    (tmp_path / "a.log").write_bytes(mixed_guard())
    assert main([str(tmp_path / "a.log"), "--level", "error", "--search", "re:START bundle"]) == 0
    assert [line.split("\t")[2:7] for line in capsys.readouterr().out.splitlines()[1:]] == [["12", "ERROR", "com.example.Foo", "-", "Failed to start bundle"]]
    assert main([str(tmp_path / "none.log")]) == 1 and main(["x", "--level", "LOUD"]) == 2 and main(["x", "--config", str(tmp_path / "no.toml")]) == 2
    with pytest.raises(SystemExit) as stop:
        main(["x", "--view", "odd"])
    assert stop.value.code == 2


def test_names_and_uptime(spark):
    row = header.parse(spark.createDataFrame([(H + "msg\r\nmore", "x", 3_723)], "text string, u string, s int"))
    assert tuple(row.select(header.exact_key(F.col("text")), header.exact_key(F.col("u")), views.uptime(F.col("s"))).first()) == (("ERROR", "*ERROR* [main] com.example.Foo msg\r\nmore"), None, "1:02:03")
    assert row.select(header.grouping_key()).first()[0] == "ERROR\x1fcom.example.Foo\x1fmsg"
    bucket = spark.createDataFrame([("ERROR", "a.B", None, None, 2)], "level string, logger string, terminal_exception string, terminal_frame string, token_count int")
    assert bucket.select(learner.group_key(F.lit(0))).first()[0] == "ERROR\x1fa.B\x1f\x1f\x1f2\x1f0"


def test_full_buckets_learn_what_is_freed(spark):
    """Vectors that met a full bucket are learned once a merge makes room, as by the plain reading of the rules."""
    rng = random.Random(8)
    words = [" ".join(rng.choice("abcd") for _ in range(5)) for _ in range(150)]
    events = spark.createDataFrame(events_of(words), "source_id string, seq long, text string")
    for limits in ({"bucket_cap": 3}, {"bucket_cap": 100, "max_groups": 3}):
        tuning = Tuning(similarity=0.6, **limits)
        out = batch.analyze_events(events, tuning, arrival())
        store, counts, over = learner.Store(0.6, limits["bucket_cap"]), {}, 0
        for w in words:
            got = store.learn(tuple(w.split()), store.live < tuning.max_groups)
            over += got.slot is None
            for m in got.merges:
                counts[m.survivor] = counts.get(m.survivor, 0) + counts.pop(m.removed, 0)
            if got.slot is not None:
                counts[got.slot] = counts.get(got.slot, 0) + 1
        want = sorted((" ".join(t), counts[k]) for k, t in enumerate(store.slots) if t is not None)
        assert sorted((" ".join(r.template), r["count"]) for r in out.groups.collect()) == want
        assert (out.overflow.agg(F.sum("count")).first()[0] or 0) == over


def test_events_at_one_time(spark, tmp_path):
    """Rows that share a time, with ids alike in their last digits: still one row a group, ids in the order of events."""
    from faultline.plans import queries

    at = dt.datetime(2024, 1, 1, 0, 6, 30)
    kinds = ((999, "view"), (1000, "click"), (1999, "view"), (2000, "click"), (2999, "error"), (None, "signup"))
    rows = [(i, at, 1, kind, 1.5) for i, kind in kinds] + [(5000, at + dt.timedelta(seconds=9), 2, "purchase", 2.5)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = {"view": 1, "click": 2, "error": 3, "signup": 4, "purchase": 5}
    assert sorted(tuple(r) for r in queries.QUERIES["trend"](spark, str(tmp_path)).collect()) == [(k, True, "+") for k in range(1, 6)]
    found = queries.QUERIES["view_volume"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.logger, r["count"]) for r in found) == [(k, f"com.example.{kind}", 2 if k <= 2 else 1) for kind, k in want.items()]

"""The sequential framer against its golden cases and batch framing, the stateful queries, the process source."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F
from test_engine import H, arrival, framed, mixed_guard

from faultline.config import Tuning
from faultline.operators import events as ev
from faultline.operators import records
from faultline.session import prepare
from faultline.sources import process
from faultline.streaming import framer as fr
from faultline.streaming import groups as gr


def run(data, tuning=None, cut=None):
    f = fr.Framer(tuning or Tuning())
    out = []
    for k in range(0, len(data), cut or max(len(data), 1)):
        out += f.push(data[k : k + (cut or len(data))])
        f = fr.Framer.load(f.save(), f.t)
    return out + f.finish()


def texts(out):
    return [o[2] for o in out if o[0] == "event"]


@pytest.mark.parametrize("cut", [1, 7, 64, None])
def test_chunks_do_not_matter(cut):
    data = b"loose\n" + mixed_guard() + b"tail without end"
    assert run(data, cut=cut) == run(data) and len(texts(run(data))) == 27


def test_framer_is_batch_framing(spark, tmp_path):
    rng = random.Random(5)
    lines = [H + "m" * 20, "\tat a.b.C.d(X)", "", "é" * 30, "x" * 200, "junk\xff"]
    for _ in range(3):
        data = "\n".join(rng.choice(lines) for _ in range(60)).encode("latin-1", "replace")
        limits = {"event_max_bytes": rng.choice([100, 150, 400]), "event_max_lines": rng.choice([2, 4, 50])}
        out = run(data, Tuning(**limits))
        events, lost = framed(spark, data, tmp_path, **limits)
        assert texts(out) == events
        assert sorted((o[3], o[4], o[2], o[5], o[6]) for o in out if o[0] == "diagnostic") == sorted(lost)


def test_idle():
    f = fr.Framer(Tuning())
    event = H + "one\n"
    assert f.push(event.encode()) == [] and texts(f.idle()) == [event]
    f.push(b"\tat late\n")
    assert f.finish() == [("diagnostic", None, "\tat late\n", "unframed_late", 9, 2, len(event))]
    assert f.idle() == []


def test_tail_args_and_stderr():
    assert process.tail_log_args("e", "author", "p", "ctx") == ["cloudmanager", "tail-log", "e", "author", "aemerror", "--programId", "p", "--imsContextName", "ctx"]
    tail = process.StderrTail(4)
    tail.add(b"abc")
    assert not tail.truncated
    tail.add(b"def")
    assert tail.text() == "cdef" and tail.truncated


def test_child_is_stopped():
    child = process.Child([sys.executable, "-c", "import time\nwhile True: print('x' * 5000, flush=True)"])
    assert child.chunks.get(timeout=20)
    assert child.stop() != 0 and child.chunks.qsize() <= process.QUEUED


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    prepare(spark)
    yield spark
    spark.conf.unset(key)


def test_process_to_frames(rocks, tmp_path):
    process.register(rocks)
    log = tmp_path / "a.log"
    log.write_bytes(mixed_guard())
    argv = [sys.executable, "-c", f"import sys,time; sys.stdout.buffer.write(open({str(log)!r},'rb').read()); sys.stdout.flush(); time.sleep(60)"]
    chunks = rocks.readStream.format("faultline_process").option("argv", json.dumps(argv)).option("source", "s").load()
    found = []
    q = fr.frame_stream(chunks).writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(90):
            if len([r for r in found if r.kind == "event"]) == 27 or not q.isActive:
                break
            q.awaitTermination(1)
        assert q.exception() is None and len([r for r in found if r.kind == "event"]) == 27  # the last by the idle timer
    finally:
        q.stop()


def test_groups_of_a_stream(rocks, tmp_path):
    t = Tuning(levels=("ERROR", "WARN"))
    rows = [("s", k, e) for k, e in enumerate(texts(run(mixed_guard())))]
    for part in (rows[:15], rows[15:]):
        rocks.createDataFrame(part, "source_id string, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema("source_id string, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    prepared = ev.tokenize(ev.interpret(ev.select(ev.parse(stream), t.levels), "utc", arrival()))
    snap = gr.Snapshot(str(tmp_path / "out"))
    q = gr.group_stream(prepared, t).writeStream.foreachBatch(snap).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    out = [(r.id, r["count"], r.template) for r in snap.groups(rocks).orderBy("id").collect()]
    assert out == [(1, 12, "Failed to start bundle"), (2, 5, "Resource not found <*>"), (3, 6, "alpha <*> <*> <*> epsilon"), (5, 2, "Uncaught exception"), (6, 1, "ignored warn")]
    assert snap.groups(rocks).agg(F.sum("count")).first()[0] == 26


def test_snapshot_survives_a_restart(spark, tmp_path):
    row = {"level": "ERROR", "logger": "x", "terminal_exception": None, "terminal_frame": None, "token_count": 1, "merged_into": None, "first_seen": 0.0, "last_seen": 0.0, "template": "t", "nodes": ["n"], "nodes_capped": False, "fast": 0.0, "baseline": 0.0, "sample": "s", "sample_truncated": False, "overflow": 0}
    change = lambda slot, count: spark.createDataFrame([row | {"slot": slot, "created_seq": slot + 1, "count": count}], gr.OUT)
    gr.Snapshot(str(tmp_path))(change(0, 1), 0)
    gr.Snapshot(str(tmp_path))(change(1, 1), 1)
    for _ in range(2):  # the last batch is given again
        gr.Snapshot(str(tmp_path))(change(0, 5), 2)
    found = gr.Snapshot(str(tmp_path)).groups(spark, spark.createDataFrame([(2,)], "id long"))
    assert [(r.id, r["count"], r.muted) for r in found.orderBy("id").collect()] == [(1, 5, False), (2, 1, True)]


def test_end_of_a_process(rocks, tmp_path):
    process.register(rocks)
    argv = [sys.executable, "-c", f"import sys; sys.stdout.write({(H + 'one')!r})"]
    chunks = rocks.readStream.format("faultline_process").option("argv", json.dumps(argv)).load()
    reader = process._Reader({"argv": json.dumps(argv)})
    rows, at = [], {"chunk": 0}
    for _ in range(100):
        more, at = reader.read(at)
        rows += list(more)
        if rows and not rows[-1][2]:
            break
    assert [r[2] for r in rows] == [(H + "one").encode(), b""] and chunks.isStreaming
    with pytest.raises(RuntimeError):
        process._Reader({"argv": json.dumps(argv)}).readBetweenOffsets({"chunk": 0}, {"chunk": 1})
    f = fr.Framer(Tuning())
    assert [o[2] for data in (r[2] for r in rows) for o in (f.push(data) if data else f.finish())] == [H + "one"]


def test_records_of_a_batch(spark, tmp_path):
    row = {"level": "ERROR", "logger": "x", "terminal_exception": None, "terminal_frame": None, "token_count": 1, "merged_into": None, "first_seen": 0.0, "last_seen": 1.5, "template": "t", "nodes": ["n"], "nodes_capped": False, "fast": 0.25, "baseline": 0.5, "sample": "s", "sample_truncated": False, "overflow": 0}
    batch = lambda *rows: spark.createDataFrame([row | r for r in rows], gr.OUT)
    made = lambda slot, **more: {"slot": slot, "created_seq": slot + 1, "count": slot + 1} | more
    snap = gr.Snapshot(str(tmp_path))
    snap(batch(*map(made, range(5))), 0)
    assert sorted(json.loads(r.value)["group_id"] for r in snap.records(spark, "s").collect()) == [1, 2, 3, 4, 5]
    # 4 into 3, 3 into 1, 1 into 0; 2 is updated
    snap(batch(made(0, count=12), made(2, count=7), *(made(k, merged_into=to) for k, to in ((4, 3), (3, 1), (1, 0)))), 1)
    found = [r.value for r in snap.records(spark, "s", spark.createDataFrame([(3,)], "id long")).collect()]
    assert all(records.check(line) is None for line in found)
    found = [json.loads(line) for line in found]
    assert sorted((r["type"], r["group_id"], r.get("removed_id"), r["count"], r["muted"]) for r in found if r["type"] == "group_merged") == [("group_merged", 1, 2, 12, False), ("group_merged", 1, 4, 12, False), ("group_merged", 1, 5, 12, False)]
    assert sorted((r["group_id"], r["count"], r["muted"], r["last_seen"]) for r in found if r["type"] == "group_updated") == [(1, 12, False, "1970-01-01T00:00:01.500Z"), (3, 7, True, "1970-01-01T00:00:01.500Z")]

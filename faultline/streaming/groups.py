"""Groups of a stream: each bucket's templates and aggregates are one keyed state.

A bucket's state holds its live templates and, for each, count, first and last instants, nodes, decayed rates and
the first event's sample: everything an update record needs, bounded by the caps.  Output is one row per group
that a micro-batch changed, which is the coalescing of updates (a trigger of a second paces them); a removed
group's last row says what it merged into.  Dense ids are given where rows are collected (``Snapshot``), in the
order of creation.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Tuning
from ..functions.redact import redact, redact_sample
from ..functions.text import capture
from ..operators.groups import MAX_NODES
from ..operators.learner import BUCKET, CAPACITY, CREATED, Store
from ..operators.records import record_rows

OUT = "level string, logger string, terminal_exception string, terminal_frame string, token_count int, slot int, merged_into int, created_seq long, count long, first_seen double, last_seen double, template string, nodes array<string>, nodes_capped boolean, fast double, baseline double, sample string, sample_truncated boolean, overflow long"


class Bucket:
    """Templates and aggregates of one bucket."""

    def __init__(self, tuning: Tuning) -> None:
        self.t, self.store = tuning, Store(tuning.similarity, tuning.bucket_cap)
        self.groups: dict[int, dict] = {}
        self.overflow = 0

    def save(self) -> str:
        return json.dumps({"slots": self.store.slots, "live": self.store.live, "groups": self.groups, "overflow": self.overflow})

    @classmethod
    def load(cls, saved: str, tuning: Tuning) -> Bucket:
        self, state = cls(tuning), json.loads(saved)
        self.store.slots = [tuple(s) if s is not None else None for s in state["slots"]]
        self.store.live, self.overflow = state["live"], state["overflow"]
        self.groups = {int(k): v for k, v in state["groups"].items()}
        return self

    def _decayed(self, g: dict, at: float) -> None:
        for name, h in (("fast", self.t.fast_half_life_secs), ("baseline", self.t.baseline_half_life_secs)):
            g[name] *= 2 ** (-max(at - g["last"], 0) / h)
        g["last"] = max(g["last"], at)

    def _add_nodes(self, g: dict, nodes: list[str]) -> None:
        for n in nodes:
            if n not in g["nodes"]:
                if len(g["nodes"]) < MAX_NODES:
                    g["nodes"] = sorted([*g["nodes"], n])
                else:
                    g["capped"] = True

    def observe(self, seq: int, tokens: tuple[str, ...], instant: float, node: str, sample: str, truncated: bool) -> tuple[set[int], list[tuple[int, int, int]]]:
        """The slots that changed, and merges as (survivor, removed, when the removed group was created)."""
        got = self.store.learn(tokens)
        if got.kind == CAPACITY:
            self.overflow += 1
            return {-1}, []
        slot = got.slot
        for m in reversed(got.merges):  # the event counts for the slot that it matched, before that merges
            slot = m.removed if m.survivor == slot and m.removed in self.groups and slot not in self.groups else slot
        if got.kind == CREATED:
            self.groups[slot] = {"seq": seq, "count": 0, "first": instant, "last": instant, "nodes": [], "capped": False, "fast": 0.0, "baseline": 0.0, "sample": sample, "cut": truncated}
        g = self.groups[slot]
        self._decayed(g, instant)
        g["count"], g["first"] = g["count"] + 1, min(g["first"], instant)
        g["fast"] += math.log(2) / self.t.fast_half_life_secs
        g["baseline"] += math.log(2) / self.t.baseline_half_life_secs
        self._add_nodes(g, [node])
        changed, merges = {slot}, []
        for m in got.merges:
            a, b = self.groups.pop(m.survivor), self.groups.pop(m.removed)
            a, b = (a, b) if a["seq"] <= b["seq"] else (b, a)
            at = max(a["last"], b["last"])
            self._decayed(a, at)
            self._decayed(b, at)
            a.update(count=a["count"] + b["count"], first=min(a["first"], b["first"]), fast=a["fast"] + b["fast"], baseline=a["baseline"] + b["baseline"], capped=a["capped"] or b["capped"])
            self._add_nodes(a, b["nodes"])
            self.groups[m.survivor] = a
            changed = (changed - {m.removed}) | {m.survivor}
            merges.append((m.survivor, m.removed, b["seq"]))
        return changed, merges


class GroupProcessor(StatefulProcessor):
    def __init__(self, tuning: Tuning) -> None:
        self.tuning = tuning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "saved string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket = Bucket.load(self.state.get()[0], self.tuning) if self.state.exists() else Bucket(self.tuning)
        changed, merges = set(), []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            c, m = bucket.observe(int(row.seq), tuple(row.tokens), float(row.at), row.node, row.sample, bool(row.cut))
            changed |= c
            merges += m
        self.state.update((bucket.save(),))
        name = [None if pd.isna(k) else k for k in key]
        out = []
        for slot in sorted(changed):
            if slot == -1:
                out.append([*name, -1, None, None, 0, None, None, None, None, None, None, None, None, None, bucket.overflow])
            elif (g := bucket.groups.get(slot)) is not None:
                out.append([*name, slot, None, g["seq"], g["count"], g["first"], g["last"], " ".join(bucket.store.slots[slot]), g["nodes"], g["capped"], g["fast"], g["baseline"], g["sample"], g["cut"], 0])
        for keep, gone, made in merges:
            out.append([*name, gone, keep, made, 0, None, None, None, None, None, None, None, None, None, 0])
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield frame.astype({"token_count": "Int32", "slot": "Int32", "merged_into": "Int32", "created_seq": "Int64", "count": "Int64", "overflow": "Int64", "first_seen": "float64", "last_seen": "float64", "fast": "float64", "baseline": "float64"})

    def close(self) -> None:
        pass


def group_stream(prepared: DataFrame, tuning: Tuning | None = None) -> DataFrame:
    """Changed groups of a stream of prepared events (``operators.events``)."""
    t = tuning or Tuning()
    sample = capture(redact_sample(F.col("text"), False, t.extra_patterns), t.sample_max_bytes)
    rows = prepared.select(*BUCKET, "seq", "tokens", (F.unix_micros("instant") / 1e6).alias("at"), redact(F.col("node"), t.extra_patterns).alias("node"), sample["text"].alias("sample"), sample["truncated"].alias("cut"))
    return rows.groupBy(*BUCKET).transformWithStateInPandas(GroupProcessor(t), outputStructType=OUT, outputMode="update", timeMode="None")


class Snapshot:
    """The latest row of every group, kept by ``foreachBatch``: a version of the table for each batch, under its number.

    Which versions there are is read from the folder, so a restarted driver goes on where the last one stopped, and a
    batch that is given again overwrites its own version.  A folder belongs to one checkpoint."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def versions(self, spark) -> list[int]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        found = (x.getPath() for x in store.listStatus(folder))
        whole = (p.getName() for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        return sorted(int(name.partition("=")[2]) for name in whole if name.startswith("batch="))

    def __call__(self, changes: DataFrame, batch: int) -> None:
        spark, keys = changes.sparkSession, [*BUCKET, "slot"]
        new = changes.withColumn("_batch", F.lit(batch))
        if before := [n for n in self.versions(spark) if n < batch]:
            new = spark.read.parquet(self.at(before[-1])).unionByName(new)
        latest = new.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in new.columns if c not in keys)), "_batch").alias("r")).select(*keys, "r.*")
        latest.write.mode("overwrite").parquet(self.at(batch))

    def at(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def _numbered(self, spark) -> DataFrame:
        """All groups there ever were, with ids in the order of creation; over groups, whose number is capped."""
        rows = spark.read.parquet(self.at(self.versions(spark)[-1]))
        return rows.where("created_seq is not null").withColumn("id", F.row_number().over(Window.orderBy("created_seq")))

    def groups(self, spark, mutes: DataFrame | None = None) -> DataFrame:
        """Live groups.  ``mutes``: (id)."""
        live = self._numbered(spark).where("merged_into is null and slot >= 0").drop("_batch")
        if mutes is None:
            return live.withColumn("muted", F.lit(False))
        return live.join(mutes.select("id").distinct().withColumn("muted", F.lit(True)), "id", "left").withColumn("muted", F.coalesce("muted", F.lit(False)))

    def records(self, spark, session: str, mutes: DataFrame | None = None, emitted_at: Column | None = None) -> DataFrame:
        """NDJSON records of what the last batch changed: a group_merged for each group that was merged away, a
        group_updated for each other group, at most one a group."""
        version = self.versions(spark)[-1]
        all_ = self._numbered(spark)
        live = self.groups(spark, mutes).withColumns({"template": F.array("template"), **{c: F.timestamp_seconds(c) for c in ("first_seen", "last_seen")}})
        changed = all_.where(F.col("_batch") == version)
        updated = live.join(changed.select("id"), "id", "left_semi")
        # a survivor may have been merged as well: follow each to the live one, twice as far at each turn
        to = all_.where("slot >= 0").select(*BUCKET, "slot", F.coalesce("merged_into", "slot").alias("end")).cache()
        while True:
            on = to.select(*(F.col(c).alias(f"_{c}") for c in BUCKET), F.col("slot").alias("_slot"), F.col("end").alias("_end"))
            same = [to[c].eqNullSafe(on[f"_{c}"]) for c in BUCKET] + [to["end"] == on["_slot"]]
            further = to.join(on, same).select(*(to[c] for c in BUCKET), "slot", "end", "_end").cache()
            if further.where("end != _end").isEmpty():
                break
            to = further.select(*BUCKET, "slot", F.col("_end").alias("end"))
        gone = changed.where("merged_into is not null").select(*BUCKET, "slot", F.col("id").alias("removed_id"))
        ends = to.select(*(F.col(c).alias(f"_{c}") for c in BUCKET), F.col("slot").alias("_slot"), "end")
        gone = gone.join(ends, [gone[c].eqNullSafe(ends[f"_{c}"]) for c in BUCKET] + [gone["slot"] == ends["_slot"]]).select(*(gone[c].alias(f"_{c}") for c in BUCKET), "removed_id", "end")
        merged = live.join(gone, [live[c].eqNullSafe(gone[f"_{c}"]) for c in BUCKET] + [live["slot"] == gone["end"]])
        return record_rows(updated, merged, session, emitted_at)

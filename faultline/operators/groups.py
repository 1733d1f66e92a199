"""Groups and overflow: aggregates of assigned events.

A group is a bucket's surviving slot with all slots that merged into it.  Every aggregate is associative, so
merges need no order except for clocks: an event's clamped instant is the running maximum over what its group
was made of at the time, which the learner's lineage gives.  Events are assigned once, into a narrow staged table in
the order of slots and events, cut into even ranges: a slot with most events is many ranges, and a range's events need
only the largest instant before it.  Sample texts join at the end, for one event per group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions import rate
from ..functions.redact import redact, redact_sample
from ..functions.text import capture
from ..session import stage
from .learner import BUCKET, CAPACITY, CREATED, REJECTED, assign

MAX_NODES = 256
FACTS = "key long, seq long, grp long, moved boolean, instant timestamp, level string, node string, time_fault string, outcome string"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and the largest instant of each row's slot up to the row, within the range."""
    part, key, high = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").fill_null(-1).to_numpy()
        at = batch.column("instant").cast(pa.int64()).to_numpy().copy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if keys[a] == key:
                at[a] = max(at[a], high)
            np.maximum.accumulate(at[a:b], out=at[a:b])
            key, high = keys[a], at[b - 1]
        more = [pa.array(np.full(len(keys), part, np.int32)), pa.array(at).cast(batch.schema.field("instant").type)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "high"])


def facts(events: DataFrame, log: DataFrame) -> DataFrame:
    """A narrow row per assigned event, staged: FACTS and t_eff, the non-decreasing clock of its group at the event."""
    narrow = assign(events.select("seq", "v1", "v2", "instant", "level", "node", "time_fault"), log).drop("v1", "v2").withColumn("moved", F.lit(False))
    names = [x.split()[0] for x in FACTS.split(", ")]
    found = stage(narrow.select(*names), "assigned")
    over, inside = found.where("key is null"), found.where("key is not null")
    moves = log.where("kind = 'lineage'").select("key", "seq", "dest")
    highs = inside.groupBy("key").agg(F.max("instant").alias("instant"))
    arrivals = moves.join(highs, "key").select(F.col("dest").alias("key"), "seq", "instant", F.lit(True).alias("moved"))
    both = inside.unionByName(arrivals, allowMissingColumns=True)
    ranges = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = both.repartitionByRange(ranges, "key", "seq", "moved").sortWithinPartitions("key", "seq", "moved")
    run = stage(ordered.mapInArrow(_running, FACTS + ", part int, high timestamp"), "clock")
    # over ranges' slots: one row each, and one more for each range that a slot goes on in
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = run.groupBy("key", "part").agg(F.max("high").alias("_high")).withColumn("carry", F.max("_high").over(before)).where("carry is not null").select("key", "part", "carry")
    timed = run.where("not moved").join(F.broadcast(carry), ["key", "part"], "left")  # at most a row per range
    return timed.select(*names, F.greatest("high", "carry").alias("t_eff")).unionByName(over.withColumn("t_eff", F.col("instant"))).drop("moved")


def node_sets(events: DataFrame, keys: list[str], clean=None) -> DataFrame:
    """(keys, nodes, node_count, nodes_capped): the first 256 distinct nodes, sorted.  ``clean`` is applied to nodes
    once each has been counted."""
    seen = events.groupBy(*keys, "node").agg(F.min("seq").alias("_at"))
    if clean is not None:
        seen = seen.withColumn("node", clean(F.col("node"))).groupBy(*keys, "node").agg(F.min("_at").alias("_at"))
    rank = seen.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "node")))
    out = rank.where(F.col("_k") <= MAX_NODES + 1).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_k") <= MAX_NODES, F.col("node")))).alias("nodes"), (F.max("_k") > MAX_NODES).alias("nodes_capped"))
    return out.withColumn("node_count", F.size("nodes").cast("long") + F.col("nodes_capped").cast("long"))


def retained(steps: Iterator[tuple], budget: int) -> dict[int, int]:
    """Which samples stay under a byte budget: group id to the id whose sample it holds.  ``steps`` in order:
    ("created", id, bytes) or ("merged", kept id, removed id).  The oldest sample goes first; one that does not fit
    alone does not stay; a merge keeps the older group's sample if it is still there, else the other's."""
    held: dict[int, tuple[int, int, int]] = {}  # id: (tick, bytes, origin)
    age: list[tuple[int, int]] = []  # (tick, id), some no longer so
    used = 0
    for tick, (kind, a, b) in enumerate(steps):
        if kind == "merged":
            mine, other = held.pop(a, None), held.pop(b, None)
            if mine and other:
                used -= other[1]
            if mine or other:
                held[a] = mine or other
                heapq.heappush(age, (held[a][0], a))
            continue
        held[a] = (tick, b, a)
        used += b
        while used > budget:
            while age and held.get(age[0][1], (None,))[0] != age[0][0]:
                heapq.heappop(age)
            victim = heapq.heappop(age)[1] if age else a
            used -= held.pop(victim)[1]
            if victim == a:
                break
        else:
            heapq.heappush(age, (tick, a))
    return {k: v[2] for k, v in held.items()}


@dataclass(frozen=True)
class Analysis:
    events: DataFrame  # assigned, with outcome
    log: DataFrame
    groups: DataFrame
    overflow: DataFrame
    facts: DataFrame


def _ids(log: DataFrame, facts: DataFrame) -> DataFrame:
    """(seq, id): group ids in order of creation; a level's first overflow event takes one as well."""
    first = facts.where(F.col("outcome").isin(CAPACITY, REJECTED)).groupBy("level").agg(F.min("seq").alias("seq")).select("seq")
    made = log.where(F.col("kind") == CREATED).select("seq").union(first)
    # over creations, which are few next to events
    return made.withColumn("id", F.row_number().over(Window.orderBy("seq")).cast("long"))


def aggregate(prepared: DataFrame, log: DataFrame, tuning: Tuning, mutes: DataFrame | None = None, raw_sample: bool = False) -> Analysis:
    """Groups (as in FIXTURES section 1) and overflow of staged events and their learning log; both are staged."""
    known = facts(prepared, log)
    ids = stage(_ids(log, known), "ids")
    own = known.where("grp is not null")
    # live groups are at most groups.max, whose own bound is a million
    clock = F.broadcast(own.groupBy("grp").agg(F.max("instant").alias("_now")))
    sums = own.join(clock, "grp").groupBy("grp").agg(
        F.count("*").alias("count"), F.min("instant").alias("first_seen"), F.max("instant").alias("last_seen"),
        rate.rate(F.col("t_eff"), F.col("_now"), tuning.fast_half_life_secs).alias("fast"), rate.rate(F.col("t_eff"), F.col("_now"), tuning.baseline_half_life_secs).alias("baseline"),
    )
    clean = lambda node: redact(node, tuning.extra_patterns)
    templates = log.where("kind = 'template'").select("grp", *BUCKET, F.col("tokens").alias("template"))
    named = templates.join(ids, templates["grp"] == ids["seq"]).drop("seq")
    groups = sums.join(node_sets(own, ["grp"], clean), "grp").join(named, "grp")
    groups = _samples(groups, prepared, log, ids, tuning, raw_sample)
    muted = F.lit(False) if mutes is None else F.coalesce(F.col("_muted"), F.lit(False))
    if mutes is not None:
        groups = groups.join(mutes.select(F.col("id").alias("_mid"), F.lit(True).alias("_muted")).distinct(), F.col("id") == F.col("_mid"), "left").drop("_mid")
    groups = groups.withColumn("muted", muted).drop("_muted", "grp")
    return Analysis(assign(prepared, log), log, stage(groups, "groups"), stage(overflow(known, ids, tuning), "overflow"), known)


def _samples(groups: DataFrame, events: DataFrame, log: DataFrame, ids: DataFrame, tuning: Tuning, raw: bool) -> DataFrame:
    created = log.where(F.col("kind") == CREATED).select("seq").join(ids, "seq")
    made = events.select("seq", "text").join(created, "seq")
    taken = stage(made.select("id", capture(redact_sample(F.col("text"), raw, tuning.extra_patterns), tuning.sample_max_bytes).alias("s")).select("id", "s.*", F.octet_length("s.text").cast("long").alias("n")), "samples")
    if (taken.agg(F.sum("n")).first()[0] or 0) <= tuning.sample_budget_bytes:
        held = ids.select(F.col("id"), F.col("id").alias("_origin"))
    else:
        held = _held(log, taken.select("id", "n"), ids, tuning.sample_budget_bytes)
    samples = taken.select(F.col("id").alias("_origin"), F.col("text").alias("sample"), F.col("truncated").alias("sample_truncated"), F.col("original_bytes").alias("sample_original_bytes"), F.col("original_lines").alias("sample_original_lines"))
    out = groups.join(held, "id", "left").join(samples, "_origin", "left").drop("_origin")
    gone = F.col("sample").isNull()
    return out.withColumns({"sample_available": ~gone, "sample": F.coalesce("sample", F.lit("")), "sample_truncated": F.coalesce("sample_truncated", F.lit(False)), "sample_original_bytes": F.coalesce("sample_original_bytes", F.lit(0).cast("long")), "sample_original_lines": F.coalesce("sample_original_lines", F.lit(0).cast("long"))})


def _held(log: DataFrame, sizes: DataFrame, ids: DataFrame, budget: int) -> DataFrame:
    """Over budget: the order of creations and merges decides, in one pass over three numbers for each."""
    created = sizes.join(ids, "id").select("seq", F.lit(False).alias("merged"), F.col("id").alias("a"), F.col("n").alias("b"))
    named = ids.select(F.col("seq").alias("_seq"), F.col("id").alias("_id"))
    merges = log.where("kind = 'merged'").select("seq", "key", "dest")
    merges = merges.join(named, F.col("key") == F.col("_seq")).select("seq", F.col("_id").alias("a"), "dest").join(named, F.col("dest") == F.col("_seq"))
    steps = created.unionByName(merges.select("seq", F.lit(True).alias("merged"), "a", F.col("_id").alias("b")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("merged", "ascending")])
        columns = (c for part in table.select(["merged", "a", "b"]).to_batches(1 << 14) for c in zip(*(x.to_pylist() for x in part.columns), strict=True))
        found = retained((("merged" if m else "created", a, b) for m, a, b in columns), budget)
        return pa.table({"id": pa.array(found.keys(), pa.int64()), "_origin": pa.array(found.values(), pa.int64())})

    return steps.groupBy(F.lit("all")).applyInArrow(run, "id long, _origin long")


def overflow(facts: DataFrame, ids: DataFrame, tuning: Tuning) -> DataFrame:
    """(id, level, count, first_seen, last_seen, nodes, node_count, nodes_capped, global, template_bucket) by level."""
    over = facts.where(F.col("outcome").isin(CAPACITY, REJECTED))
    sums = over.groupBy("level").agg(F.count("*").alias("count"), F.min("instant").alias("first_seen"), F.max("instant").alias("last_seen"), F.count_if(F.col("outcome") == REJECTED).alias("global"), F.count_if(F.col("outcome") == CAPACITY).alias("template_bucket"), F.min("seq").alias("seq"))
    nodes = node_sets(over, ["level"], lambda node: redact(node, tuning.extra_patterns))
    return sums.join(nodes, "level").join(ids, "seq").drop("seq")

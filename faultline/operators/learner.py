"""Template learning, bucket by bucket.

``Store`` is the sequential model of one bucket.  Once a vector of tokens has been matched or has made a template, some
live template fits it exactly for good, so repeats change nothing and only each vector's first event goes to Python.
What may change is which template a repeat goes to, so a vector's assignment is a list of intervals of the event order,
and events find theirs by a range join on the vector's 128-bit key.

A vector that meets a full bucket, or a full set of groups, stays unlearned until a template fits it or there is room;
the change that makes it so is noticed.  Only where that happens is a bucket learned once more, with all events of its
unlearned vectors and the first events of the others.

A removed template's slot stays empty, so slots are stable names; a slot's key is the event that created it, and a
group's is that of its oldest slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions.normalize import WILDCARD
from ..session import stage

BUCKET = ("level", "logger", "terminal_exception", "terminal_frame", "token_count")
END_OF_TIME = 2**63 - 1
MATCHED, CREATED, CAPACITY, REJECTED = "matched", "created", "capacity", "rejected"


def similarity(template: tuple[str, ...], tokens: tuple[str, ...]) -> float:
    fixed = [(a, b) for a, b in zip(template, tokens, strict=True) if a != WILDCARD]
    return sum(a == b for a, b in fixed) / len(fixed) if fixed else 1.0


def generalize(template: tuple[str, ...], tokens: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(a if a == b else WILDCARD for a, b in zip(template, tokens, strict=True))


class Merge(NamedTuple):
    survivor: int
    removed: int


class Outcome(NamedTuple):
    kind: str
    slot: int | None
    merges: tuple[Merge, ...]
    changed: bool = False


class Store:
    """The live templates of one bucket."""

    def __init__(self, threshold: float, cap: int) -> None:
        self.threshold, self.cap = threshold, min(max(cap, 1), 1000)
        self.slots: list[tuple[str, ...] | None] = []
        self.live = 0

    def best(self, tokens: tuple[str, ...]) -> int | None:
        """The most similar slot at or over the threshold; the lowest of equals."""
        found, score = None, -1.0
        for k, template in enumerate(self.slots):
            if template is not None and (s := similarity(template, tokens)) >= self.threshold and s > score:
                found, score = k, s
                if s == 1.0:
                    break
        return found

    def _compatible(self, a: int, b: int) -> bool:
        x, y = self.slots[a], self.slots[b]
        return similarity(x, y) >= self.threshold and similarity(y, x) >= self.threshold

    def _collapse(self, changed: int) -> tuple[Merge, ...]:
        """Merge compatible pairs, the first in slot order each time.  Between events no pair is compatible, so
        only pairs with a slot that has changed can be."""
        out, dirty = [], {changed}
        while True:
            live = [k for k, t in enumerate(self.slots) if t is not None]
            pairs = {(min(a, b), max(a, b)) for a in dirty if self.slots[a] is not None for b in live if a != b}
            pair = next((p for p in sorted(pairs) if self._compatible(*p)), None)
            if pair is None:
                return tuple(out)
            keep, gone = pair
            self.slots[keep], self.slots[gone] = generalize(self.slots[keep], self.slots[gone]), None
            self.live -= 1
            dirty.add(keep)
            out.append(Merge(keep, gone))

    def learn(self, tokens: tuple[str, ...], may_create: bool = True) -> Outcome:
        slot = self.best(tokens)
        if slot is not None:
            new = generalize(self.slots[slot], tokens)
            if new == self.slots[slot]:
                return Outcome(MATCHED, slot, ())
            self.slots[slot] = new
            merges = self._collapse(slot)
            for m in merges:
                slot = m.survivor if m.removed == slot else slot
            return Outcome(MATCHED, slot, merges, True)
        if self.live >= self.cap:
            return Outcome(CAPACITY, None, ())
        if not may_create:
            return Outcome(REJECTED, None, ())
        self.slots.append(tokens)
        self.live += 1
        return Outcome(CREATED, len(self.slots) - 1, ())


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
#: key, grp and dest are creating events' seqs: of the slot, of its group in the end, of the other slot.
LOG = "kind string, seq long, until long, tokens array<string>, slot int, other int, key long, grp long, dest long, v1 long, v2 long, level string, logger string, terminal_exception string, terminal_frame string, token_count int"
ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in LOG.split(", ")])
ASSIGNED, AGAIN, ONCE = "assigned", "again", "once"


class Bucket:
    """One bucket's learning: its templates, where its vectors go, and what it leaves.

    Rows are (kind, seq, until, tokens, slot, other): assignment intervals, templates, creations, merges, and lineage,
    which says since when a slot's events count as another's."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.rows: list[tuple] = []
        self.at: dict[tuple, int] = {}  # learned vectors, and their slots
        self.since: dict[tuple, int] = {}
        self.learned: dict[tuple, int] = {}
        self.waiting: dict[tuple, tuple[str, int]] = {}  # the others: why, and since when
        self.made: dict[int, int] = {}  # slot: the event that created it
        self.joined: dict[int, set[int]] = {}  # slot: the slots whose events count as its

    def add(self, kind: str, seq: int, until: int | None, tokens: tuple | None, slot: int | None, other: int | None = None) -> None:
        self.rows.append((kind, seq, until, list(tokens) if tokens is not None else None, slot, other))

    def feed(self, seq: int, tokens: tuple[str, ...], room: bool = True) -> Outcome | None:
        """The next event, unless its vector is learned already; ``room``: whether another group may be created."""
        if tokens in self.at:
            return None
        got = self.store.learn(tokens, room)
        why, since = self.waiting.get(tokens, (got.kind, seq))
        if why != got.kind:
            self.add(why, since, seq - 1, tokens, None)
            del self.waiting[tokens]
        if got.slot is None:
            self.waiting.setdefault(tokens, (got.kind, seq))
            return got
        if got.kind == CREATED:
            self.add(CREATED, seq, None, tokens, got.slot)
            self.joined[got.slot], self.made[got.slot] = {got.slot}, seq
        for m in got.merges:
            self.add("merged", seq, None, None, m.survivor, m.removed)
            for k in self.joined[m.removed]:
                self.add("lineage", seq, None, None, k, m.survivor)
            self.joined[m.survivor] |= self.joined.pop(m.removed)
        if got.changed:  # something may fit earlier vectors better now
            for v, slot in self.at.items():
                if (now := self.store.best(v)) != slot:
                    self.add(ASSIGNED, self.since[v], seq, v, slot)
                    self.since[v], self.at[v] = seq + 1, now
        self.since[tokens], self.at[tokens], self.learned[tokens] = seq, got.slot, seq
        return got

    def learnable(self, room: bool) -> bool:
        """Whether a template, or room for one, has been made for a vector that waits."""
        return bool(self.waiting) and ((room and self.store.live < self.store.cap) or any(self.store.best(v) is not None for v in self.waiting))

    def close(self) -> None:
        for v, slot in self.at.items():
            self.add(ASSIGNED, self.since[v], END_OF_TIME, v, slot)
        for v, (why, since) in self.waiting.items():
            self.add(why, since, END_OF_TIME, v, None)
        for k, template in enumerate(self.store.slots):
            if template is not None:
                self.add("template", self.made[k], None, template, k)


def run_bucket(events: Iterator[tuple[int, tuple[str, ...]]], store: Store, distinct: bool) -> Bucket:
    """Feed events in order.  With ``distinct`` each vector comes once; without, every event comes and its own outcome
    is its assignment, which is the plain reading of the rules."""
    bucket = Bucket(store)
    for seq, tokens in events:
        got = bucket.feed(seq, tokens)
        if not distinct:
            bucket.add(ASSIGNED if got.slot is not None else got.kind, seq, seq, tokens, got.slot)
            bucket.at.clear()
            bucket.waiting.clear()
    if distinct:
        bucket.close()
    return bucket


class Learning:
    """Buckets that share a cap on live groups, fed in the order of events.  With ``watch`` vectors come once; from the
    change on at which one that waits could be learned, nothing more is."""

    def __init__(self, threshold: float, cap: int, max_groups: int | None, watch: bool) -> None:
        self.new = lambda: Bucket(Store(threshold, cap))
        self.most, self.watch = max_groups, watch
        self.buckets: dict[tuple, Bucket] = {}
        self.live, self.stale = 0, False
        self.later: list[tuple[tuple, tuple]] = []

    def _room(self) -> bool:
        return self.most is None or self.live < self.most

    def feed(self, seq: int, name: tuple, tokens: tuple[str, ...]) -> None:
        if self.stale:
            self.later.append((name, tokens))
            return
        bucket = self.buckets.get(name) or self.buckets.setdefault(name, self.new())
        before = self._room()
        got = bucket.feed(seq, tokens, before)
        if got is None:
            return
        self.live += (got.kind == CREATED) - len(got.merges)
        if self.watch and got.changed:
            freed = self._room() and not before
            self.stale = any(b.learnable(self._room()) for b in (self.buckets.values() if freed else (bucket,)))

    def rows(self, key: dict[tuple, tuple[int, int]]) -> Iterator[tuple]:
        """Rows of the log; ``key`` is what 128-bit key a bucket's vector has."""
        none = (None,) * 6
        for name, b in self.buckets.items():
            if self.stale:
                yield from ((ONCE, seq, None, list(v), *none[:5], *key[name, v], *name) for v, seq in b.learned.items())
                yield from ((AGAIN, 0, *none, None, *key[name, v], *name) for v in b.waiting)
                continue
            b.close()
            end = {k: slot for slot, members in b.joined.items() for k in members}
            for kind, seq, until, tokens, slot, other in b.rows:
                spans = kind in (ASSIGNED, CAPACITY, REJECTED)
                group = b.made[end[slot]] if slot is not None else None
                yield (kind, seq, until, None if spans else tokens, slot, other, b.made.get(slot), group, b.made.get(other), *(key[name, tuple(tokens)] if spans else none[:2]), *name)
        yield from ((AGAIN, 0, *none, None, *key[name, v], *name) for name, v in self.later)


def _learner(tuning: Tuning, max_groups: int | None, watch: bool):
    def run(table: pa.Table) -> pa.Table:
        learning, key = Learning(tuning.similarity, tuning.bucket_cap, max_groups, watch), {}
        for part in table.sort_by("seq").to_batches(1 << 14):
            for seq, v1, v2, tokens, *name in zip(*(part.column(c).to_pylist() for c in ("seq", "v1", "v2", "tokens", *BUCKET)), strict=True):
                at = (tuple(name), tuple(tokens))
                key[at] = (v1, v2)
                learning.feed(seq, *at)
        columns = list(zip(*learning.rows(key), strict=True)) or [[] for _ in ARROW]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return run


def group_key(slot: Column) -> Column:
    """A group's identity as text: its bucket and slot, joined by unit separators.  A missing exception and an empty one
    read alike, so joins are on columns, not on this."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BUCKET]
    return F.concat_ws("\x1f", *parts, slot.cast("string"))


def with_keys(events: DataFrame) -> DataFrame:
    """Adds v1 and v2, a 128-bit key of each event's bucket and tokens."""
    parts = [p for c in BUCKET for p in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return events.withColumns({f"v{k}": F.xxhash64(F.lit(k), *parts, "tokens") for k in (1, 2)})


def most_live(log: DataFrame) -> int:
    """The largest number of live groups at any time: a running sum over creations and merges only."""
    steps = log.where("kind in ('created', 'merged')").select("seq", F.when(F.col("kind") == CREATED, 1).otherwise(-1).alias("d"), (F.col("kind") == "merged").alias("late"))
    live = F.sum("d").over(Window.orderBy("seq", "late").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select(live.alias("n")).agg(F.max("n")).first()[0] or 0


def learn(events: DataFrame, tuning: Tuning) -> DataFrame:
    """The learning log of events (seq, v1, v2, tokens, bucket columns), staged.  As long as the cap on live groups is
    not reached, buckets do not see each other; once it is, what is created depends on all of them, and their distinct
    vectors are learned in one ordered pass."""
    columns = ["seq", "v1", "v2", "tokens", *BUCKET]
    vectors = stage(events.groupBy("v1", "v2", "tokens", *BUCKET).agg(F.min("seq").alias("seq")).select(*columns), "vectors")

    def run(scope: list, most: int | None) -> DataFrame:
        log = stage(vectors.groupBy(*scope).applyInArrow(_learner(tuning, most, True), LOG), "log")
        again = log.where(F.col("kind") == AGAIN)
        if again.isEmpty():
            return log
        every = events.select(*columns).join(again.select("v1", "v2"), ["v1", "v2"], "left_semi").select(*columns)
        once = log.where(F.col("kind") == ONCE).select(*columns)
        redone = every.unionByName(once).groupBy(*scope).applyInArrow(_learner(tuning, most, False), LOG)
        return stage(log.where(~F.col("kind").isin(AGAIN, ONCE)).unionByName(redone), "log")

    log = run(list(BUCKET), None)
    created = log.where(F.col("kind") == CREATED).limit(tuning.max_groups + 1).count()
    if created > tuning.max_groups and most_live(log) > tuning.max_groups:
        return run([F.lit("all")], tuning.max_groups)
    return log


def assign(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events with their slot's key, their group in the end, and outcome (assigned, capacity, rejected)."""
    spans = log.where(F.col("kind").isin(ASSIGNED, CAPACITY, REJECTED)).select(F.col("v1").alias("_v1"), F.col("v2").alias("_v2"), F.col("seq").alias("_from"), F.col("until").alias("_to"), "key", "grp", F.col("kind").alias("outcome"))
    on = [events["v1"] == spans["_v1"], events["v2"] == spans["_v2"], events["seq"].between(spans["_from"], spans["_to"])]
    return events.join(spans, on).select(*events.columns, "key", "grp", "outcome")

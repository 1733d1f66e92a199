"""Snapshots, ranked views, search and detail over groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions import rate
from ..functions.text import escape_visible

#: Sort columns of each view, the default first; every sort is descending.
SORTS = {"volume": ("count", "last_seen", "fast"), "new": ("first_seen", "count", "last_seen"), "increasing": ("ratio", "fast", "count"), "muted": ("count", "last_seen", "fast")}
MAX_SEARCH_BYTES = 256


def snapshot(groups: DataFrame, tuning: Tuning, now: Column | None = None) -> DataFrame:
    """Groups with rates decayed to one clock, the latest event of any group unless ``now`` is given, and with
    ratio, is_new, is_increasing and trend."""
    clock = groups.agg(F.max("last_seen").alias("now")) if now is None else groups.agg(now.alias("now"))
    out = groups.crossJoin(F.broadcast(clock))  # one row
    elapsed = rate.seconds(F.col("now")) - rate.seconds(F.col("last_seen"))
    out = out.withColumns({"fast": F.col("fast") * rate.decay(elapsed, tuning.fast_half_life_secs), "baseline": F.col("baseline") * rate.decay(elapsed, tuning.baseline_half_life_secs)})
    out = out.withColumns({
        "ratio": rate.ratio(F.col("fast"), F.col("baseline")),
        "is_new": rate.is_new(F.col("first_seen"), F.col("now"), tuning.new_age_secs),
        "is_increasing": rate.is_increasing(F.col("first_seen"), F.col("now"), F.col("fast"), F.col("baseline"), tuning.increasing_min_age_secs, tuning.increasing_ratio, tuning.increasing_min_rate),
    })
    return out.withColumn("trend", F.when(F.col("is_increasing"), "^").when(F.col("is_new"), "+").otherwise(" "))


def in_view(view: str) -> Column:
    quiet = ~F.col("muted")
    return {"volume": quiet, "new": quiet & F.col("is_new"), "increasing": quiet & F.col("is_increasing"), "muted": F.col("muted")}[view]


def ranked(snap: DataFrame, view: str, sort: str | None = None) -> DataFrame:
    """A view's groups, the largest first; ties by id, ratios first by the fast rate."""
    sort = sort or SORTS[view][0]
    if sort not in SORTS[view]:
        raise ValueError(f"{view} is not sorted by {sort}")
    order = [F.desc(sort)] + ([F.desc("fast")] if sort == "ratio" else []) + [F.asc("id")]
    return snap.where(in_view(view)).orderBy(*order)


def by_id(snap: DataFrame) -> DataFrame:
    return snap.orderBy("id")


def haystack() -> Column:
    return F.concat_ws(" ", F.col("id").cast("string"), F.col("count").cast("string"), "level", "logger", F.coalesce("terminal_exception", F.lit("")), F.array_join("template", " "), F.array_join("nodes", ","))


def search(groups: DataFrame, query: str) -> DataFrame:
    """Groups whose metadata hold the text, whatever its case; ``re:`` asks for a pattern.  An empty query matches
    all; a pattern that is too long or invalid matches none.  Samples are never searched."""
    if query.startswith("re:"):
        pattern = query[3:]
        try:
            ok = len(pattern.encode()) <= MAX_SEARCH_BYTES and re.compile(pattern) is not None
        except re.error:
            ok = False
        return groups.where(haystack().rlike(f"(?iuU){pattern}")) if ok else groups.limit(0)
    return groups.where(F.contains(F.lower(haystack()), F.lit(query.lower()))) if query else groups


def evidence_status() -> Column:
    size = F.concat(F.col("sample_original_bytes").cast("string"), F.lit("B "), F.col("sample_original_lines").cast("string"), F.lit("L"))
    return F.when(~F.col("sample_available"), "evidence unavailable").when(F.col("sample_truncated"), F.concat(F.lit("evidence truncated "), size)).otherwise(F.concat(F.lit("evidence "), size))


def detail(groups: DataFrame) -> DataFrame:
    """(id, lines): what the detail pane of each group says."""
    say = lambda name, value: F.concat(F.lit(name + " "), value)
    sample = F.when(~F.col("sample_available"), F.array(F.lit("sample unavailable"))).when(F.col("sample") == "", F.array(F.lit("(empty)"))).otherwise(F.transform(F.split("sample", "\n", -1), escape_visible))
    lines = [
        say("id", F.col("id").cast("string")), say("count", F.col("count").cast("string")), say("level", F.col("level")), say("logger", escape_visible(F.col("logger"))),
        say("exception", F.coalesce(escape_visible(F.col("terminal_exception")), F.lit("-"))), say("template", escape_visible(F.array_join("template", " "))), say("nodes", escape_visible(F.array_join("nodes", ","))),
        say("first", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")), say("last", F.date_format("last_seen", "HH:mm:ss")), say("muted", F.col("muted").cast("string")), evidence_status(), F.lit(""), F.lit("sample"),
    ]
    return groups.select("id", F.concat(F.array(*lines), sample).alias("lines"))


def cells(snap: DataFrame) -> DataFrame:
    """The table's cells as text."""
    return snap.select("id", F.format_string("%.2f", "fast").alias("RATE"), F.col("count").cast("string").alias("COUNT"), F.col("level").alias("LEVEL"), F.col("logger").alias("LOGGER"), F.coalesce("terminal_exception", F.lit("-")).alias("EXCEPT"), F.array_join("template", " ").alias("TEMPLATE"), F.array_join("nodes", ",").alias("NODES"), F.date_format("last_seen", "HH:mm:ss").alias("LAST"))


def uptime(seconds: Column) -> Column:
    """Hours, minutes and seconds of a whole number of seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def counters(events: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: selected_events, and diagnostics, which counts lost bytes and time faults."""
    lost = diagnostics.agg(F.coalesce(F.sum(F.greatest("count", F.lit(1))), F.lit(0)).alias("lost"))
    faults = events.agg(F.count("*").alias("selected_events"), F.count_if(F.col("time_fault").isNotNull()).alias("faults"))
    return faults.crossJoin(F.broadcast(lost)).select("selected_events", (F.col("faults") + F.col("lost")).alias("diagnostics"))


def checksum(groups: DataFrame, overflow: DataFrame) -> int:
    """The ordered fold over (id, count) and the overflow total, in unsigned 64-bit arithmetic.  Groups are capped."""
    out = 0
    for row in groups.select("id", "count").orderBy("id").toLocalIterator():
        out = ((out * 1_000_003 + row[0]) * 1_000_003 + row[1]) % 2**64
    return (out * 1_000_003 + (overflow.agg(F.sum("count")).first()[0] or 0)) % 2**64

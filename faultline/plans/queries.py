"""Queries over the test tables.  The events table is projected into log lines; each operator has a query, and SQL
that says the same wherever SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions import exception, header, normalize, rate, time
from ..functions.redact import redact
from ..functions.text import capture, escape_visible, head_bytes
from ..operators import events as ev
from ..operators import framing, groups, learner, records, views
from ..session import prepare, shared_dir
from ..sources.lines import numbered, scan_log
from . import batch

LEVEL = {"error": "ERROR", "signup": "WARN", "purchase": "INFO", "view": "DEBUG", "click": "TRACE"}
ALL = Tuning(levels=tuple(LEVEL.values()))
PLAIN = "request failed after {value}s for {type}"
STACK = "\njava.lang.IllegalStateException: boom\n\tat com.example.{type}.Service.call(Service.java:7)\nCaused by: java.io.IOException: gone\n\tat com.example.{type}.Store.read(Store.java:9)\n"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _level(kind: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for k, v in LEVEL.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def log_events(spark: SparkSession, sf_dir: str, message: str = PLAIN, body: str = "", in_order: bool = False) -> DataFrame:
    """The events table as framed events; rows without a time or a type are none.  ``in_order`` adds seq: unique, and
    in the order of times and, at one time, of ids."""
    rows = _table(spark, sf_dir, "events")
    tasks = spark.sparkContext.defaultParallelism
    short = len(rows.inputFiles()) < tasks
    rows = rows.where("ts is not null and event_type is not null").select("event_id", "event_type", "user_id", "value", "ts")
    if in_order:  # the range and the place in it number a row, however many rows share a time
        order = (F.col("ts"), F.asc_nulls_last("event_id"))
        ranges = max(tasks, rows.rdd.getNumPartitions())
        rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    elif short:  # a file or two would be parsed in as many tasks: deal the narrow rows first
        rows = rows.repartition(tasks)

    def fill(text: str) -> F.Column:
        parts = text
        out = F.lit(parts)
        for name, value in (("{value}", F.col("value").cast("string")), ("{type}", F.col("event_type")), ("{user}", F.col("user_id").cast("string"))):
            out = F.replace(out, F.lit(name), value)
        return out

    line = F.concat(F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSS"), F.lit(" node-"), (F.col("user_id") % 7).cast("string"), F.lit(" *"), _level(F.col("event_type")), F.lit("* [worker] com.example."), F.col("event_type"), F.lit(" "), fill(message), fill(body))
    return rows.select(F.lit("events").alias("source_id"), *(["seq"] if in_order else []), line.alias("text"), "event_id", "event_type", "user_id", "value", "ts")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log for each fifth of the users, with every event over five lines (what follows the last newline is none)."""
    rows = log_events(spark, sf_dir, body=STACK).withColumn("source_id", (F.col("user_id") % 5).cast("string"))
    rows = rows.select("source_id", F.floor(F.col("event_id") / 512).alias("block"), "event_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where("k < 5")
    return numbered(rows.select("source_id", "block", (F.col("event_id") * 8 + F.col("k")).alias("pos"), F.col("line").cast("binary").alias("raw"), (F.octet_length("line") + 1).cast("long").alias("size"), F.lit(True).alias("ended")))


def _groups(spark: SparkSession, sf_dir: str, tuning: Tuning = ALL, message: str = PLAIN, body: str = "") -> groups.Analysis:
    return batch.analyze_events(log_events(spark, sf_dir, message, body, in_order=True).select("source_id", "seq", "text"), tuning, F.lit("2024-02-01").cast("timestamp"))


def redact_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("redacted"))


def redact_page_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", redact(F.col("url")).alias("redacted"))


def normalize_messages(spark, sf_dir):
    text = F.concat_ws(" ", F.lit("took"), F.concat(F.col("value").cast("string"), F.lit("ms")), F.lit("at"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("/p?user="), F.col("user_id").cast("string"), F.lit("&t="), F.col("event_type")), F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")), F.concat(F.lit("Obj@"), F.lpad(F.lower(F.hex("event_id")), 6, "0")), (F.col("event_id") + 995).cast("string"), F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(normalize.normalize(text), " ").alias("tokens"))


def header_metadata(spark, sf_dir):
    return header.parse(log_events(spark, sf_dir)).select("event_id", *header.FIELDS, F.col("offsets.message.start").alias("message_start"))


def request_context(spark, sf_dir):
    thread = F.concat(F.lit("192.0.2."), (F.col("user_id") % 256).cast("string"), F.lit(" ["), F.col("event_id").cast("string"), F.lit("] GET /"), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, " extra").otherwise(""), F.lit(" HTTP/1.1"))
    c = header.request_context(thread)
    return _table(spark, sf_dir, "events").select("event_id", c["client_ip"].alias("client_ip"), c["request_id"].alias("request_id"), c["path"].alias("path"))


def exception_identity(spark, sf_dir):
    rows = log_events(spark, sf_dir, body=STACK).select("event_id", "text").withColumn("i", exception.terminal_identity(F.col("text"), F.lit("x")))
    return rows.select("event_id", "i.exception", "i.frame")


def frame_events(spark, sf_dir):
    events, _ = framing.frame(_lines(spark, sf_dir), Tuning())
    return events.select("source_id", F.substring("text", 1, 23).alias("stamp"), F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def frame_diagnostics(spark, sf_dir):
    """A cap of two lines cuts every event; what is lost is counted by source."""
    _, found = framing.frame(_lines(spark, sf_dir), Tuning(event_max_lines=2))
    return found.groupBy("source_id", "reason").agg(F.count("*").alias("n"), F.sum("count").alias("lost"))


def byte_caps(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", head_bytes(F.col("text"), 101).alias("head"))


def sample_capture(spark, sf_dir):
    c = capture(F.col("text"), 64)
    return _table(spark, sf_dir, "documents").select("doc_id", c["text"].alias("sample"), c["original_bytes"].alias("original_bytes"), c["original_lines"].alias("original_lines"), c["truncated"].alias("truncated"))


def visible_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", escape_visible(F.col("text")).alias("visible"))


def level_filter(spark, sf_dir):
    kept = ev.select(ev.parse(log_events(spark, sf_dir).select("source_id", "text")), ("ERROR", "WARN"))
    return kept.groupBy("level", "logger").agg(F.count("*").alias("n"))


def utc_interpretation(spark, sf_dir):
    t = time.interpret(F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSS"), "America/New_York", F.lit("2030-01-01").cast("timestamp"))
    return _table(spark, sf_dir, "events").select("event_id", time.rfc3339(t["instant"]).alias("instant"))


def dst_faults(spark, sf_dir):
    """Each event's time of day on the days on which New York changes its clocks."""
    days = F.explode(F.array(F.lit("10.03.2024"), F.lit("03.11.2024"), F.lit("31.02.2024"))).alias("day")
    rows = _table(spark, sf_dir, "events").select(days, F.date_format("ts", "HH:mm:ss.SSS").alias("at"))
    t = time.interpret(F.concat_ws(" ", "day", "at"), "America/New_York", F.lit("2030-01-01").cast("timestamp"))
    return rows.select("day", t["fault"].alias("fault")).groupBy("day", "fault").agg(F.count("*").alias("n"))


def ewma_rates(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").cast("timestamp").alias("now"))
    at = F.col("ts").cast("timestamp")
    both = rows.crossJoin(F.broadcast(now))  # one row
    sums = both.groupBy("event_type").agg(rate.rate(at, F.col("now"), 3600).alias("fast"), rate.rate(at, F.col("now"), 86400).alias("baseline"))
    return sums.select("event_type", F.round("fast", 6).alias("fast"), F.round("baseline", 6).alias("baseline"), F.round(rate.ratio(F.col("fast"), F.col("baseline")), 4).alias("ratio"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "count", "level", "logger", F.array_join("template", " ").alias("template"), time.rfc3339(F.col("first_seen")).alias("first"), time.rfc3339(F.col("last_seen")).alias("last"), F.array_join("nodes", ",").alias("nodes"))


def _view(name: str, tuning: Tuning = ALL, muted: bool = False, now: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _groups(spark, sf_dir, tuning).groups
        found = found.withColumn("muted", F.col("id") <= 2) if muted else found
        return _shown(views.ranked(views.snapshot(found, tuning, F.lit(now).cast("timestamp") if now else None), name))

    return run


#: A clock at which some groups of the events table are new.
FIRST_MINUTES = "2024-01-01 00:07:00"
#: Half-lives and ages of the events table's scale: a month.
SLOW = Tuning(levels=ALL.levels, fast_half_life_secs=43_200, baseline_half_life_secs=86_400, new_age_secs=86_400, increasing_ratio=1.0, increasing_min_rate=0.0)


def group_rates(spark, sf_dir):
    found = _groups(spark, sf_dir, SLOW).groups
    return found.select("logger", F.round("fast", 8).alias("fast"), F.round("baseline", 8).alias("baseline"))


def search_groups(spark, sf_dir):
    return _shown(views.search(_groups(spark, sf_dir).groups, "FOR P"))


def group_detail(spark, sf_dir):
    return views.detail(_groups(spark, sf_dir, body=STACK).groups).select("id", F.array_join("lines", "\n").alias("detail"))


CAPPED = Tuning(levels=ALL.levels, similarity=1.0, bucket_cap=100)


def overflow_by_level(spark, sf_dir):
    """Every user a template: those after a bucket's first hundred overflow."""
    out = _groups(spark, sf_dir, CAPPED, "user u{user} failed").overflow
    return out.select("level", "count", "global", "template_bucket")


def group_counts_capped(spark, sf_dir):
    out = _groups(spark, sf_dir, CAPPED, "user u{user} failed").groups
    return out.select("level", F.array_join("template", " ").alias("template"), "count")


def learn_groups(spark, sf_dir):
    """Templates mined from messages that vary: what becomes one depends on the order of events."""
    out = _groups(spark, sf_dir, ALL, "user u{user} had {type} trouble with value {value}").groups
    return _shown(out)


def similarity_pairs(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("a"))
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = parts.join(other, "p_partkey").where(F.size("a") == F.size("b"))
    merged = normalize.generalize(F.col("a"), F.col("b"))
    return both.select("p_partkey", F.round(normalize.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.array_join(merged, " ").alias("general"))


def nodes_capped(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").cast("string").alias("node"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return groups.node_sets(rows, ["l_returnflag"]).select("l_returnflag", F.array_join("nodes", ",").alias("nodes"), "node_count", "nodes_capped")


def ndjson_updated(spark, sf_dir):
    return records.updated(_groups(spark, sf_dir).groups, "00000000-0000-4000-8000-000000000000", F.lit("2024-02-01").cast("timestamp"))


def ndjson_created(spark, sf_dir):
    found = _groups(spark, sf_dir, body=STACK)
    ids = groups._ids(found.log, found.facts)
    return records.created(found, ids, "00000000-0000-4000-8000-000000000000", ALL, emitted_at=F.lit("2024-02-01").cast("timestamp")).select("value")


def count_checksum(spark, sf_dir):
    found = _groups(spark, sf_dir)
    return spark.createDataFrame([(str(views.checksum(found.groups, found.overflow)),)], "checksum string")


def log_files(spark, sf_dir):
    """The events as log files, a loose line first, written and then read: events by their texts."""
    rows = log_events(spark, sf_dir, body=STACK, in_order=True).select((F.col("user_id") % 5).alias("source"), "seq", F.regexp_replace("text", r"\n\z", "").alias("value"))
    loose = spark.range(5).select(F.col("id").alias("source"), F.lit(-1).cast("long").alias("seq"), F.lit("no header yet").alias("value"))
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    rows.unionByName(loose).repartition("source").sortWithinPartitions("source", "seq").drop("seq").write.partitionBy("source").text(folder, lineSep="\n")
    events, lost = framing.frame(scan_log(spark, folder), Tuning())
    name = F.regexp_extract("source_id", "source=([0-9]+)", 1).alias("source")
    found = events.select(name, F.lit("event").alias("kind"), F.col("seq").alias("line"), F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return found.unionByName(lost.select(name, F.col("reason").alias("kind"), "line", F.col("count").alias("bytes"), F.md5(F.col("sample").cast("binary")).alias("digest")))


def invalid_bytes(spark, sf_dir):
    """Each event's line ends in one to three bytes that are not UTF-8: a diagnostic for the line, and where it is."""
    rows = log_events(spark, sf_dir).select((F.col("user_id") % 5).cast("string").alias("source_id"), F.floor(F.col("event_id") / 512).alias("block"), F.col("event_id").alias("pos"), F.concat(F.col("text").cast("binary"), F.substring(F.lit(b"\xff\xfe\xfd"), F.lit(1), (F.col("user_id") % 3).cast("int") + 1)).alias("raw"))
    events, lost = framing.frame(numbered(rows.withColumn("size", F.octet_length("raw").cast("long") + 1).withColumn("ended", F.lit(True))), Tuning())
    replaced = events.groupBy("source_id").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))).alias("replaced"))
    return lost.groupBy("source_id", "reason").agg(F.count("*").alias("n"), F.sum("count").alias("faults"), F.max("line").alias("last_line"), F.max("offset").alias("last_offset")).join(replaced, "source_id")


def byte_limited(spark, sf_dir):
    """A byte cap that falls within every header line: what is kept, and what is lost."""
    events, lost = framing.frame(_lines(spark, sf_dir), Tuning(event_max_bytes=64))
    kept = events.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("kept"), F.min(F.substring("text", 1, 64)).alias("first"))
    return kept.join(lost.groupBy("source_id", "reason").agg(F.count("*").alias("cuts"), F.sum("count").alias("lost")), "source_id")


def search_pattern(spark, sf_dir):
    return _shown(views.search(_groups(spark, sf_dir).groups, "re:for (p|CLICK)"))


def mute_command(spark, sf_dir):
    mutes = spark.createDataFrame([(2,), (4,), (99,)], "id long")
    events = log_events(spark, sf_dir, in_order=True).select("source_id", "seq", "text")
    found = batch.analyze_events(events, ALL, F.lit("2024-02-01").cast("timestamp"), mutes).groups
    return _shown(views.ranked(views.snapshot(found, ALL), "muted"))


def samples_budget(spark, sf_dir):
    """A budget for two samples of at most 40 bytes: the youngest groups keep theirs."""
    tuning = Tuning(levels=ALL.levels, sample_max_bytes=40, sample_budget_bytes=80)
    return _groups(spark, sf_dir, tuning).groups.select("id", "sample_available", "sample_truncated", F.octet_length("sample").cast("long").alias("bytes"))


def selected_count(spark, sf_dir):
    """Selected events, and diagnostics: lost bytes and stamps without an instant."""
    found = batch.analyze(_lines(spark, sf_dir), Tuning(levels=("ERROR", "WARN"), event_max_lines=2), F.lit("2024-02-01").cast("timestamp"))
    return views.counters(found.analysis.events, found.diagnostics)


def trend(spark, sf_dir):
    snap = views.snapshot(_groups(spark, sf_dir, SLOW).groups, SLOW, F.lit(FIRST_MINUTES).cast("timestamp"))
    return snap.select("id", "is_new", "trend")


#: A cap on all groups that the events reach.
FEW_GROUPS = Tuning(levels=ALL.levels, similarity=1.0, bucket_cap=1000, max_groups=50)


def group_cap(spark, sf_dir):
    """Fifty groups for all users of all levels: counts by level of what has one, and of what has none."""
    found = _groups(spark, sf_dir, FEW_GROUPS, "user u{user} failed")
    over = found.overflow.select("level", F.lit(False).alias("grouped"), F.col("count").alias("n"), F.col("global").alias("rejected"))
    return found.groups.groupBy("level").agg(F.sum("count").alias("n")).select("level", F.lit(True).alias("grouped"), "n", F.lit(0).cast("long").alias("rejected")).unionByName(over)


def bucket_counts(spark, sf_dir):
    return _groups(spark, sf_dir, body=STACK).groups.groupBy("level", "logger", "terminal_exception", "terminal_frame", "token_count").agg(F.count("*").alias("templates"), F.sum("count").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (redact_documents, redact_page_urls, normalize_messages, header_metadata, request_context, exception_identity, frame_events, frame_diagnostics, byte_caps, sample_capture, visible_documents, level_filter, utc_interpretation, dst_faults, ewma_rates, group_rates, search_groups, group_detail, overflow_by_level, group_counts_capped, learn_groups, similarity_pairs, nodes_capped, ndjson_updated, ndjson_created, count_checksum, log_files, invalid_bytes, byte_limited, search_pattern, mute_command, samples_budget, selected_count, trend, group_cap, bucket_counts)
} | {"view_volume": _view("volume"), "view_new": _view("new", ALL, now=FIRST_MINUTES), "view_increasing": _view("increasing", SLOW), "view_muted": _view("muted", muted=True)}


# What redaction replaces, in its order, as the SQL says it by itself.
_REDACTED = (
    (r"(authorization\s*:\s*)\S+(?:\s+\S+)?", r"\1[REDACTED:authorization]"),
    (r"(\bbearer\s+)[A-Za-z0-9._\-+/=]{8,}", r"\1[REDACTED:bearer]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", r"[REDACTED:jwt]"),
    (r'''(\b(?:password|passwd|pwd)\s*[=:]\s*)(?:"[^"]*"|'[^']*'|[^\s,;&]+)''', r"\1[REDACTED:password]"),
    (r'''(\bapi[_-]?key\s*[=:]\s*)(?:"[^"]*"|'[^']*'|[^\s,;&]+)''', r"\1[REDACTED:api_key]"),
    (r'''(\b(?:(?:access|refresh|id)[_-]?token|token)\s*[=:]\s*)(?:"[^"]*"|'[^']*'|[^\s,;&]+)''', r"\1[REDACTED:token]"),
    (r"([?&][^=&#\s]+=)([^&#\s]*)", r"\1[REDACTED:query]"),
    (r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", r"[REDACTED:email]"),
    (r"\b(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:)*[0-9a-f]{2,4}::[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)\b", r"[REDACTED:ip]"),
    (r"(^|[^0-9A-Za-z:])(::1)([^0-9A-Za-z:]|$)", r"\1[REDACTED:ip]\3"),
    (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", r"[REDACTED:ip]"),
)


def _redact_sql(column: str) -> str:
    for pattern, keep in _REDACTED:
        column = f"regexp_replace({column}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', '{keep}', 'g')"
    return column


_LEVEL_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in LEVEL.items()) + " end"
_MS = "strftime(date_trunc('milliseconds', {}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_G = f"""
    with e as (select *, date_trunc('milliseconds', ts) t, {_LEVEL_SQL} as level, row_number() over (order by ts, event_id) r from events),
    g as (select event_type, level, count(*) n, min(t) f, max(t) l, min(r) r, string_agg(distinct 'node-' || (user_id % 7), ',' order by 'node-' || (user_id % 7)) nodes from e group by all),
    v as (select row_number() over (order by r) id, n as count, level, 'com.example.' || event_type as logger, 'request failed after <*> for ' || event_type as template,
                 {_MS.format('f')} as first, {_MS.format('l')} as last, nodes, event_type, f, l from g),
    now as (select max(t) now from e),
    rates as (select event_type, ln(2) / 43200 * sum(pow(2, -(epoch_us(now) - epoch_us(t)) / 1e6 / 43200)) fast, ln(2) / 86400 * sum(pow(2, -(epoch_us(now) - epoch_us(t)) / 1e6 / 86400)) base from e, now group by 1)"""
_V = "id, count, level, logger, template, first, last, nodes"
_LINES = ("java.lang.IllegalStateException: boom", "\tat com.example.{type}.Service.call(Service.java:7)", "Caused by: java.io.IOException: gone", "\tat com.example.{type}.Store.read(Store.java:9)")
_HEAD_SQL = f"strftime(ts, '%d.%m.%Y %H:%M:%S.%g') || ' node-' || (user_id % 7) || ' *' || {_LEVEL_SQL} || '* [worker] com.example.' || event_type || ' request failed after ' || value || 's for ' || event_type"
_TEXT_SQL = _HEAD_SQL + "".join(" || chr(10) || " + "'" + x.replace("\t", "' || chr(9) || '").replace("{type}", "' || event_type || '") + "'" for x in _LINES) + " || chr(10)"

_VISIBLE_SQL = "replace(text, chr(92), repeat(chr(92), 2))"
for _code in [*range(1, 10), *range(11, 32), *range(127, 160)]:
    _VISIBLE_SQL = f"replace({_VISIBLE_SQL}, chr({_code}), chr(92) || '{'t' if _code == 9 else 'r' if _code == 13 else f'x{_code:02x}'}')"

ORACLES: dict[str, str] = {
    "redact_documents": f"select doc_id, {_redact_sql('text')} redacted from documents",
    "redact_page_urls": f"select page_id, {_redact_sql('url')} redacted from pages",
    "normalize_messages": "select event_id, 'took <*> at <*> /p?user=<*>&t=<*> <*> Obj@<*> ' || case when event_id + 995 >= 1000 then '<*>' else (event_id + 995)::varchar end || ' ' || event_type tokens from events",
    "header_metadata": f"select event_id, strftime(ts, '%d.%m.%Y %H:%M:%S.%g') as timestamp, 'node-' || (user_id % 7) node, {_LEVEL_SQL} as level, 'worker' thread, 'com.example.' || event_type logger, 'request failed after ' || value || 's for ' || event_type message, strlen({_HEAD_SQL}) - strlen('request failed after ' || value || 's for ' || event_type) message_start from events",
    "request_context": "select event_id, case when event_id % 3 > 0 then '192.0.2.' || (user_id % 256) end client_ip, case when event_id % 3 > 0 then event_id::varchar end request_id, case when event_id % 3 > 0 then '/' || event_type end path from events",
    "exception_identity": "select event_id, 'java.io.IOException' as exception, 'com.example.' || event_type || '.Store.read' as frame from events",
    "frame_events": f"select (user_id % 5)::varchar source_id, strftime(ts, '%d.%m.%Y %H:%M:%S.%g') stamp, length({_TEXT_SQL})::bigint chars, md5({_TEXT_SQL}) digest from events",
    "frame_diagnostics": "select (user_id % 5)::varchar source_id, 'event_line_limit' reason, count(*) n, sum(strlen('\tat com.example..Service.call(Service.java:7)') + strlen('Caused by: java.io.IOException: gone') + strlen('\tat com.example..Store.read(Store.java:9)') + 2 * strlen(event_type) + 3)::bigint lost from events group by 1",
    "byte_caps": "select doc_id, coalesce((select max(left(text, k)) from range(0, 102) r(k) where strlen(left(text, k)) <= 101), '') head from documents",
    "level_filter": f"select {_LEVEL_SQL} as level, 'com.example.' || event_type logger, count(*) n from events where event_type in ('error', 'signup') group by all",
    "utc_interpretation": f"select event_id, {_MS.format(chr(39).join(('timezone(', 'UTC', ', timezone(', 'America/New_York', ', ts))')))} as instant from events",
    "dst_faults": """with d as (select unnest(['10.03.2024', '03.11.2024', '31.02.2024']) as day, hour(ts) h from events)
        select day, case when day = '31.02.2024' or day = '10.03.2024' and h = 2 then 'nonexistent_wall_time' when day = '03.11.2024' and h = 1 then 'ambiguous_wall_time' end fault, count(*) n from d group by all""",
    "ewma_rates": """with n as (select max(ts) now from events), r as (select event_type, ln(2) / 3600 * sum(pow(2, -(epoch_us(now) - epoch_us(ts)) / 1e6 / 3600)) f, ln(2) / 86400 * sum(pow(2, -(epoch_us(now) - epoch_us(ts)) / 1e6 / 86400)) b from events, n group by 1)
        select event_type, round(f, 6) fast, round(b, 6) baseline, round(f / b, 4) ratio from r""",
    "group_rates": f"""{_G}, own as (select e.event_type, round(ln(2) / 43200 * sum(pow(2, -(epoch_us(l) - epoch_us(t)) / 1e6 / 43200)), 8) fast, round(ln(2) / 86400 * sum(pow(2, -(epoch_us(l) - epoch_us(t)) / 1e6 / 86400)), 8) baseline from e join g using (event_type) group by 1)
        select 'com.example.' || event_type logger, fast, baseline from own""",
    "search_groups": f"{_G} select {_V} from v where contains(lower(template), 'for p')",
    "view_volume": f"{_G} select {_V} from v",
    "view_new": f"{_G} select {_V} from v where epoch_us(timestamp '{FIRST_MINUTES}') - epoch_us(f) <= 60e6",
    "view_increasing": f"{_G} select {_V} from v join rates using (event_type), now where epoch_us(now) - epoch_us(f) >= 60e6 and fast >= base",
    "view_muted": f"{_G} select {_V} from v where id <= 2",
    "overflow_by_level": f"""with e as (select *, {_LEVEL_SQL} as level from events), u as (select level, user_id, count(*) n, min((ts, event_id)) f from e group by all), k as (select *, row_number() over (partition by level order by f) k from u)
        select level, sum(n)::bigint as count, 0::bigint as global, sum(n)::bigint template_bucket from k where k > 100 group by 1""",
    "group_counts_capped": f"""with e as (select *, {_LEVEL_SQL} as level from events), u as (select level, user_id, count(*) n, min((ts, event_id)) f from e group by all), k as (select *, row_number() over (partition by level order by f) k from u)
        select level, 'user u' || user_id || ' failed' template, n as count from k where k <= 100""",
    "similarity_pairs": """with p as (select p_partkey, string_split(p_type, ' ') a from part), q as (select p.p_partkey, p.a, o.a b from p join p o on o.p_partkey = p.p_partkey + 1 where len(p.a) = len(o.a))
        select p_partkey, round(len(list_filter(list_zip(a, b), lambda x: x[1] = x[2])) / len(a), 6) similarity, array_to_string(list_transform(list_zip(a, b), lambda x: case when x[1] = x[2] then x[1] else '<*>' end), ' ') general from q""",
    "nodes_capped": """with s as (select l_returnflag, l_partkey::varchar node, min(l_orderkey * 8 + l_linenumber) f from lineitem group by all), k as (select *, row_number() over (partition by l_returnflag order by f, node) k from s)
        select l_returnflag, string_agg(node, ',' order by node) filter (k <= 256) nodes, least(max(k), 257)::bigint node_count, max(k) > 256 nodes_capped from k group by 1""",
    "log_files": f"""with e as (select (user_id % 5)::varchar source, {_TEXT_SQL} as t, row_number() over (partition by user_id % 5 order by ts, event_id) k from events)
        select source, 'event' kind, (2 + 5 * (k - 1))::bigint line, strlen(t)::bigint bytes, md5(t) digest from e
        union all select distinct source, 'unframed_prefix', 1::bigint, 14::bigint, md5('no header yet' || chr(10)) from e""",
    "invalid_bytes": f"""with e as (select (user_id % 5)::varchar source_id, event_id, user_id % 3 + 1 f, strlen({_HEAD_SQL}) s, row_number() over (partition by user_id % 5 order by event_id) k from events),
        o as (select *, sum(s + f + 1) over (partition by source_id order by event_id) - f - 1 fault_at from e)
        select source_id, 'invalid_utf8' reason, count(*) n, sum(f)::bigint faults, max(k) last_line, max(fault_at)::bigint last_offset, sum(f)::bigint replaced from o group by 1""",
    "byte_limited": f"""with e as (select (user_id % 5)::varchar source_id, {_TEXT_SQL} as t from events)
        select source_id, count(*) n, (64 * count(*))::bigint kept, min(left(t, 64)) as first, 'event_byte_limit' reason, count(*) cuts, sum(strlen(t) - 64)::bigint lost from e group by 1""",
    "search_pattern": f"{_G} select {_V} from v where template like '%for p%' or template like '%for click%'",
    "mute_command": f"{_G} select {_V} from v where id in (2, 4)",
    "samples_budget": f"{_G} select id, id > max(id) over () - 2 sample_available, id > max(id) over () - 2 sample_truncated, case when id > max(id) over () - 2 then 40 else 0 end::bigint bytes from v",
    "selected_count": "select count(*) filter (event_type in ('error', 'signup')) selected_events, sum(strlen('\tat com.example..Service.call(Service.java:7)') + strlen('Caused by: java.io.IOException: gone') + strlen('\tat com.example..Store.read(Store.java:9)') + 2 * strlen(event_type) + 3)::bigint diagnostics from events",
    "trend": f"{_G}, c as (select *, greatest(epoch_us(timestamp '{FIRST_MINUTES}') - epoch_us(f), 0) / 1e6 age from v) select id, age <= 86400 is_new, case when age <= 86400 then '+' else ' ' end as trend from c",
    "group_cap": f"""with e as (select *, {_LEVEL_SQL} as level from events), u as (select level, user_id, count(*) n, min((ts, event_id)) f from e group by all), k as (select *, row_number() over (order by f) k from u)
        select level, k <= 50 as grouped, sum(n)::bigint n, case when k <= 50 then 0 else sum(n) end::bigint rejected from k group by level, k <= 50""",
    "bucket_counts": "select case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in LEVEL.items()) + " end as level, 'com.example.' || event_type logger, 'java.io.IOException' terminal_exception, 'com.example.' || event_type || '.Store.read' terminal_frame, 6 token_count, 1::bigint templates, count(*) n from events group by event_type",
    "sample_capture": """select doc_id, case when strlen(text) <= 64 then text else (select arg_max(left(text, k), k) from range(0, 33) r(k) where strlen(left(text, k)) <= 32) || (select arg_max(right(text, k), k) from range(0, 33) r(k) where strlen(right(text, k)) <= 32) end sample,
        strlen(text)::bigint original_bytes, (case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when ends_with(text, chr(10)) then 0 else 1 end end)::bigint original_lines, strlen(text) > 64 truncated from documents""",
    "visible_documents": "select doc_id, " + _VISIBLE_SQL + " visible from documents",
    "count_checksum": f"{_G}, f as (select flatten(list([id::hugeint, count::hugeint] order by id)) x from v) select (list_reduce(list_concat([0::hugeint], x, [0::hugeint]), lambda a, b: (a * 1000003 + b) % 18446744073709551616::hugeint))::varchar checksum from f",
}

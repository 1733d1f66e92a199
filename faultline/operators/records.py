"""Change records as NDJSON: one text column, one record per row.

Fields that a record must carry are written as null when they have no value; the two optional ones are left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions import rate
from ..functions.redact import redact, redact_request
from ..functions.text import head_bytes
from ..functions.time import rfc3339
from .groups import Analysis

VERSION = 1
STDERR_BYTES = 64 << 10
#: Required fields of each record beside version, type, session_id and emitted_at (fixed values).
REQUIRED: dict[str, tuple[str, ...]] = {
    "session_started": ("source", "levels"),
    "group_created": ("group_id", "count", "first_seen", "last_seen", "template", "nodes", "muted", "level", "sample", "sample_truncated", "fast_rate", "baseline_rate", "timestamp", "node", "thread", "logger", "message", "request_context", "terminal_exception", "terminal_frame", "source_offsets"),
    "group_updated": ("group_id", "count", "first_seen", "last_seen", "template", "nodes", "muted", "level", "fast_rate", "baseline_rate"),
    "group_merged": ("group_id", "count", "first_seen", "last_seen", "template", "nodes", "muted", "level", "fast_rate", "baseline_rate", "removed_id", "sample", "sample_truncated"),
    "parser_error": ("reason", "count", "sample", "sample_truncated", "line", "offset"),
    "source_ended": ("status", "stderr", "stderr_truncated"),
}
OPTIONAL = {"group_created": ("time_fallback",)}
ENVELOPE = ("version", "type", "session_id", "emitted_at")


def session_id() -> str:
    return str(uuid.uuid4())


def _json(kind: str, session: str, fields: dict[str, Column], emitted_at: Column | None = None) -> Column:
    at = rfc3339(F.current_timestamp() if emitted_at is None else emitted_at)
    head = {"version": F.lit(VERSION), "type": F.lit(kind), "session_id": F.lit(session), "emitted_at": at}
    return F.to_json(F.struct(*(c.alias(n) for n, c in (head | fields).items())), {"ignoreNullFields": "false"})


def _group(rates: bool = True) -> dict[str, Column]:
    out = {"group_id": F.col("id"), "count": F.col("count"), "first_seen": rfc3339(F.col("first_seen")), "last_seen": rfc3339(F.col("last_seen")), "template": F.array_join("template", " "), "nodes": F.col("nodes"), "muted": F.col("muted"), "level": F.col("level")}
    return out | ({"fast_rate": rate.rounded(F.col("fast")), "baseline_rate": rate.rounded(F.col("baseline"))} if rates else {})


def updated(groups: DataFrame, session: str, emitted_at: Column | None = None) -> DataFrame:
    """A record of each group's present state, in the order of ids; rates are at the group's own clock."""
    return groups.orderBy("id").select(_json("group_updated", session, _group(), emitted_at).alias("value"))


def created(analysis: Analysis, ids: DataFrame, session: str, tuning: Tuning, raw_sample: bool = False, emitted_at: Column | None = None) -> DataFrame:
    """(seq, value): a record for each event that made a group, with the group as it then was.  ``ids``: (seq, id)."""
    from ..functions.redact import redact_sample
    from ..functions.text import capture

    first = analysis.events.join(analysis.log.where("kind = 'created'").select("seq").join(ids, "seq"), "seq")
    clean = lambda c: redact(F.col(c), tuning.extra_patterns)
    rows = first.withColumn("_s", capture(redact_sample(F.col("text"), raw_sample, tuning.extra_patterns), tuning.sample_max_bytes))
    impulse = lambda h: F.round(F.lit(0.6931471805599453 / h), 3)
    stamp = rfc3339(F.col("instant"))
    fields = {
        "group_id": F.col("id"), "count": F.lit(1), "first_seen": stamp, "last_seen": stamp, "template": F.array_join("tokens", " "), "nodes": F.array(clean("node")), "muted": F.lit(False), "level": F.col("level"),
        "sample": F.col("_s.text"), "sample_truncated": F.col("_s.truncated"), "fast_rate": impulse(tuning.fast_half_life_secs), "baseline_rate": impulse(tuning.baseline_half_life_secs), "timestamp": stamp,
        "time_fallback": F.lit(True), "node": clean("node"), "thread": clean("thread"), "logger": clean("logger"), "message": clean("message"), "request_context": redact_request(F.col("request_context"), tuning.extra_patterns),
        "terminal_exception": clean("terminal_exception"), "terminal_frame": clean("terminal_frame"), "source_offsets": F.col("offsets"),
    }
    plain = {k: v for k, v in fields.items() if k != "time_fallback"}
    value = F.when(F.col("time_fault").isNotNull(), _json("group_created", session, fields, emitted_at)).otherwise(_json("group_created", session, plain, emitted_at))
    return rows.select("seq", value.alias("value"))


def merged(analysis: Analysis, ids: DataFrame, session: str, emitted_at: Column | None = None) -> DataFrame:
    """(seq, value): a record for each merge.  The surviving group's figures are those of its final state."""
    names = ids.select(F.col("seq").alias("_seq"), F.col("id").alias("_id"))
    rows = analysis.log.where("kind = 'merged'").select("seq", "grp", "dest")
    rows = rows.join(names, F.col("dest") == F.col("_seq")).select("seq", "grp", F.col("_id").alias("removed_id")).join(names, F.col("grp") == F.col("_seq")).select("seq", "removed_id", F.col("_id").alias("id"))
    full = rows.join(analysis.groups, "id")
    fields = _group() | {"removed_id": F.col("removed_id"), "sample": F.col("sample"), "sample_truncated": F.col("sample_truncated")}
    return full.select("seq", _json("group_merged", session, fields, emitted_at).alias("value"))


def record_rows(updated: DataFrame, merged: DataFrame, session: str, emitted_at: Column | None = None) -> DataFrame:
    """group_updated and group_merged (with removed_id) records of groups, merges first."""
    fields = _group() | {"removed_id": F.col("removed_id"), "sample": F.col("sample"), "sample_truncated": F.col("sample_truncated")}
    return merged.select(_json("group_merged", session, fields, emitted_at).alias("value")).unionByName(updated.select(_json("group_updated", session, _group(), emitted_at).alias("value")))


def parser_errors(diagnostics: DataFrame, session: str, tuning: Tuning, emitted_at: Column | None = None) -> DataFrame:
    sample = redact(F.col("sample"), tuning.extra_patterns)
    cut = head_bytes(sample, tuning.sample_max_bytes)
    fields = {"reason": F.col("reason"), "count": F.col("count"), "sample": cut, "sample_truncated": F.octet_length(sample) > tuning.sample_max_bytes, "line": F.col("line"), "offset": F.col("offset")}
    return diagnostics.orderBy("source_id", "line").select(_json("parser_error", session, fields, emitted_at).alias("value"))


def session_started(spark: SparkSession, session: str, tuning: Tuning, program_id: str, environment_id: str, service: str, log: str, ims_context: str | None = None) -> DataFrame:
    source = {"program_id": program_id, "environment_id": environment_id, "service": service, "log": log} | ({"ims_context": ims_context} if ims_context else {})
    fields = {"source": F.struct(*(F.lit(v).alias(k) for k, v in source.items())), "levels": F.array(*map(F.lit, tuning.levels))}
    return spark.range(1).select(_json("session_started", session, fields).alias("value"))


def source_ended(spark: SparkSession, session: str, status: int | None, stderr: bytes, tuning: Tuning) -> DataFrame:
    """The last record: the exit status and the redacted last 64 KiB of the source's stderr."""
    tail = stderr[-STDERR_BYTES:].decode("utf-8", "replace")
    fields = {"status": F.lit(status).cast("int"), "stderr": redact(F.lit(tail), tuning.extra_patterns), "stderr_truncated": F.lit(len(stderr) > STDERR_BYTES)}
    return spark.range(1).select(_json("source_ended", session, fields).alias("value"))


def check(line: str) -> str | None:
    """Why a line is no valid record, or None: the envelope, and exactly the fields of its type."""
    try:
        record = json.loads(line, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
    except ValueError as error:
        return f"not JSON: {error}"
    if not isinstance(record, dict) or (kind := record.get("type")) not in REQUIRED:
        return "unknown type"
    if record.get("version") != VERSION:
        return "unknown version"
    needed = {*ENVELOPE, *REQUIRED[kind]}
    if missing := needed - record.keys():
        return f"missing {sorted(missing)}"
    if more := record.keys() - needed - set(OPTIONAL.get(kind, ())):
        return f"unknown fields {sorted(more)}"
    for name in ("fast_rate", "baseline_rate"):
        if name in record and not 0 <= record[name] <= 1_000_000:
            return f"{name} out of bounds"
    return None


def write(records: DataFrame, path: str) -> None:
    """NDJSON files, one record to a line."""
    records.select("value").write.text(path, lineSep="\n")

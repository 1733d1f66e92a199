"""Framing: lines to events and diagnostics.

A header starts an event and later lines belong to it until the next header; caps cut an event at its first line
that does not fit, and what follows up to the next header is counted as discarded.

A block (one split of a file) is framed where it is read, from Arrow batches and without a row per line leaving the
task: events that begin and end in it are complete.  What its first header does not own (its head) and its last
event (open) are pieces, cut to what the caps could ever let through.  One narrow row per block then tells which
event each head continues and where the block lies in its file, by windows over blocks; only pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Tuning
from ..session import few, stage
from ..sources.lines import Log, in_order
from .caps import INVALID, PREFIX, Held, Lost, content, is_header, prefix, utf8_faults

DIAGNOSTICS = ("source_id", "reason", "count", "sample", "line", "offset")
EVENT, CUT, FAULT, HEAD, OPEN = "event", "cut", "fault", "head", "open"
#: line and at are counted from the block's start.  Of a head, the loose fields are for the case that no event owns it.
PIECES = "tag long, block long, kind string, line long, at long, text string, reason string, count long, n_lines long, n_bytes long, headed boolean, sizes array<long>, payload binary, loose_line long, loose_at long, blank_end boolean"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in PIECES.split(", ")])


@dataclass
class Region:
    """Successive lines of a block that belong together, cut to what the caps could let through."""

    line: int
    at: int
    lines: int = 0
    bytes: int = 0
    sizes: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    held: int = 0
    loose: Lost | None = None
    blank_end: bool = False

    def add(self, data: memoryview, offs: np.ndarray, a: int, b: int, t: Tuning) -> None:
        """Lines a to b - 1 of a batch."""
        k = a
        while k < b and self.held <= t.event_max_bytes and len(self.sizes) <= t.event_max_lines:
            fits = min(b, k + t.event_max_lines + 1 - len(self.sizes), int(np.searchsorted(offs, offs[k] + t.event_max_bytes - self.held, "right")) - 1)
            if fits > k:  # lines that fit as a whole
                self.parts.append(bytes(data[offs[k] : offs[fits]]))
                self.sizes += np.diff(offs[k : fits + 1]).tolist()
            else:
                fits = k + 1
                self.parts.append(bytes(data[offs[k] : min(offs[fits], offs[k] + t.event_max_bytes + 1)]))
                self.sizes.append(int(offs[fits] - offs[k]))
            self.held += int(offs[fits] - offs[k])
            k = fits
        self.lines += b - a
        self.bytes += int(offs[b] - offs[a])

    def note_loose(self, data: memoryview, offs: np.ndarray, a: int, b: int, t: Tuning, line0: int, at0: int) -> None:
        """For heads: counts the lines that are not blank."""
        for k in range(a, b):
            raw = bytes(data[offs[k] : min(offs[k + 1], offs[k] + t.event_max_bytes + 1)])
            self.blank_end = not content(raw)
            if self.blank_end:
                continue
            if self.loose:
                self.loose.count += int(offs[k + 1] - offs[k])
            else:
                self.loose = Lost(PREFIX, int(offs[k + 1] - offs[k]), prefix(raw.decode("utf-8", "replace"), t.sample_max_bytes), line0 + k, at0 + int(offs[k]))

    def each(self, t: Tuning) -> Iterator[tuple[bytes, int]]:
        payload, at = b"".join(self.parts), 0
        for size in self.sizes:
            n = min(size, t.event_max_bytes + 1)
            yield payload[at : at + n], size
            at += n


def _hold(pieces: Iterator[tuple[int, int, int, int, Iterator[tuple[bytes, int]]]], t: Tuning) -> Held:
    """An event under its caps, from its pieces in order: (line, at, lines, bytes, what is known of the lines)."""
    held = Held(t)
    for line, at, lines, size, known in pieces:
        for raw, n in known:
            held.add(raw.decode("utf-8", "replace"), n, line, at)
            line, at, lines, size = line + 1, at + n, lines - 1, size - n
        if lines and held.lost:  # a piece is cut short only where its event is
            held.lost.count += size
    return held


class _Block:
    """Frames one block from its lines in order."""

    def __init__(self, tag: int, block: int, t: Tuning) -> None:
        self.tag, self.block, self.t = tag, block, t
        self.line = self.at = 0
        self.region, self.head = Region(0, 0), None
        self.rows: list[tuple] = []

    def _row(self, kind: str, line: int, at: int, text: str | None = None, reason: str | None = None, count: int | None = None, more: tuple = (None,) * 8) -> None:
        self.rows.append((self.tag, self.block, kind, line, at, text, reason, count, *more))

    def _cut(self, region: Region) -> None:
        """A complete event that the fast way does not take."""
        held = _hold(iter([(region.line, region.at, region.lines, region.bytes, region.each(self.t))]), self.t)
        self._row(EVENT, region.line, region.at, held.text)
        if held.lost:
            self._row(CUT, held.lost.line, held.lost.offset, held.lost.sample, held.lost.reason, held.lost.count)

    def _faulty(self, data: memoryview, offs: np.ndarray) -> np.ndarray:
        """Which lines are not valid UTF-8; a diagnostic for each."""
        bad = np.zeros(len(offs) - 1, bool)
        try:
            bytes(data[offs[0] : offs[-1]]).decode("utf-8")
            return bad
        except UnicodeDecodeError:
            pass
        high = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] > 0x7F)))
        for k in np.flatnonzero(high[offs[1:] - offs[0]] > high[offs[:-1] - offs[0]]).tolist():
            raw = bytes(data[offs[k] : offs[k + 1]])
            at, count = utf8_faults(raw)
            if count:
                bad[k] = True
                sample = prefix(raw[: self.t.event_max_bytes + 1].decode("utf-8", "replace"), self.t.sample_max_bytes)
                self._row(FAULT, self.line + k, self.at + int(offs[k] - offs[0]) + at, sample, INVALID, count)
        return bad

    def add(self, data: memoryview, offs: np.ndarray) -> pa.RecordBatch | None:
        """The next lines; events that are complete and whole come back as a batch that shares their bytes."""
        t, n = self.t, len(offs) - 1
        bad = self._faulty(data, offs)
        heads = _headers(data, offs, t)
        first = int(heads[0]) if len(heads) else n
        line0, at0 = self.line, self.at - int(offs[0])
        self.region.add(data, offs, 0, first, t)
        if self.head is None:
            self.region.note_loose(data, offs, 0, first, t, line0, at0)
        fast = None
        if len(heads):
            if self.head is None:
                self.head = self.region
            else:
                self._cut(self.region)
            start, end = heads[:-1], heads[1:]
            size, faults = offs[end] - offs[start], np.concatenate(([0], np.cumsum(bad)))
            whole = (size <= t.event_max_bytes) & (end - start <= t.event_max_lines) & (faults[end] == faults[start])
            for a, b in zip(start[~whole].tolist(), end[~whole].tolist(), strict=True):
                region = Region(line0 + a, at0 + int(offs[a]))
                region.add(data, offs, a, b, t)
                self._cut(region)
            if whole.any():
                fast = self._whole(data, offs, start[whole], end[whole], line0, at0)
            last = int(heads[-1])
            self.region = Region(line0 + last, at0 + int(offs[last]))
            self.region.add(data, offs, last, n, t)
        self.line += n
        self.at += int(offs[-1] - offs[0])
        return fast

    def _whole(self, data: memoryview, offs: np.ndarray, start: np.ndarray, end: np.ndarray, line0: int, at0: int) -> pa.RecordBatch:
        n, size = len(start), offs[end] - offs[start]
        if (start[1:] == end[:-1]).all():  # neighbours: one run of bytes
            body = np.frombuffer(data, np.uint8)[offs[start[0]] : offs[end[-1]]]
        else:
            body = np.concatenate([np.frombuffer(data, np.uint8)[offs[a] : offs[b]] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        text = pa.StringArray.from_buffers(n, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body)))
        columns = {"tag": pa.array(np.full(n, self.tag)), "block": pa.array(np.full(n, self.block)), "kind": pa.array([EVENT] * n), "line": pa.array(line0 + start), "at": pa.array(at0 + offs[start]), "text": text}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)

    def end(self) -> None:
        """The head, which also has the block's totals, and the open event."""
        t = self.t

        def piece(kind: str, r: Region) -> None:
            loose = r.loose or Lost(PREFIX, 0, "", None, None)
            known = list(r.each(t))
            self._row(kind, r.line, r.at, loose.sample, loose.reason, loose.count, (r.lines, r.bytes, kind == OPEN or self.head is not None, [n for _, n in known], b"".join(x for x, _ in known), loose.line, loose.offset, r.blank_end))

        piece(HEAD, self.region if self.head is None else self.head)
        if self.head is not None:
            piece(OPEN, self.region)

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA) if rows else None


#: Places and bytes of a stamp's marks: what nearly all lines that are no headers fail at.
_MARKS = ((2, b"."), (5, b"."), (10, b" "), (13, b":"), (16, b":"), (19, b"."), (23, b" "))


def _headers(data: memoryview, offs: np.ndarray, t: Tuning) -> np.ndarray:
    """Which lines are headers."""
    raw = np.frombuffer(data, np.uint8)
    maybe = np.flatnonzero(np.diff(offs) > 24)
    for place, mark in _MARKS:
        maybe = maybe[raw[offs[maybe] + place] == mark[0]]
    most = t.event_max_bytes + 1
    return np.array([k for k in maybe.tolist() if is_header(content(bytes(data[offs[k] : min(offs[k + 1], offs[k] + most)])))], np.int64)


def _framer(t: Tuning):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tag, block = (batch.column(c).to_numpy() for c in ("tag", "block"))
            raw, n = batch.column("raw").cast(pa.large_binary()), batch.num_rows
            edges = [0, n]  # a block's lines stand together
            if tag[0] != tag[-1] or block[0] != block[-1]:
                edges[1:1] = (np.flatnonzero((np.diff(tag) != 0) | (np.diff(block) != 0)) + 1).tolist()
            offs = np.frombuffer(raw.buffers()[1], np.int64, n + 1, 8 * raw.offset)
            data = memoryview(raw.buffers()[2] or b"")
            for a, b in zip(edges, edges[1:], strict=False):
                name = (int(tag[a]), int(block[a]))
                if now is None or (now.tag, now.block) != name:
                    if now is not None:
                        now.end()
                        yield now.take()
                    now = _Block(*name, t)
                fast = now.add(data, offs[a : b + 1])
                if fast is not None:
                    yield fast
                if (rows := now.take()) is not None:
                    yield rows
        if now is not None:
            now.end()
            yield now.take()

    return run


def pieces(log: Log, t: Tuning) -> DataFrame:
    return log.lines.mapInArrow(_framer(t), PIECES)


def _layout(found: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per block: where it lies, how much of its file is before it, whose event its head continues, how much of
    that event is before the head, and whether its last line is the file's last and has no newline."""
    totals = found.where(F.col("kind").isin(HEAD, OPEN)).groupBy("tag", "block").agg(
        F.max(F.col("line") + F.col("n_lines")).alias("lines"), F.max(F.col("at") + F.col("n_bytes")).alias("bytes"), F.max(F.when(F.col("kind") == HEAD, F.col("n_lines"))).alias("head_lines"), F.max(F.when(F.col("kind") == HEAD, F.col("n_bytes"))).alias("head_bytes"),
        F.max(F.when(F.col("kind") == OPEN, F.col("n_lines"))).alias("open_lines"), F.max(F.when(F.col("kind") == OPEN, F.col("n_bytes"))).alias("open_bytes"),
    )
    # ids of sources are places in the order of their names: over files, not over lines
    totals = totals.join(sources.withColumn("rank", F.row_number().over(Window.orderBy("source_id")) - 1), "tag")
    before = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("source_id")
    headed = F.col("open_lines").isNotNull()
    out = totals.withColumns({
        "line0": F.coalesce(F.sum("lines").over(before), F.lit(0)), "at0": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "owner": F.max(F.when(headed, F.col("block"))).over(before),
        "unended": (F.col("block") == F.max("block").over(all_)) & (F.sum("bytes").over(all_) == F.col("file_size") + 1),
    })
    inside = Window.partitionBy("source_id", "owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opens = out.where(headed).select("source_id", F.col("block").alias("owner"), F.col("open_lines").alias("_l"), F.col("open_bytes").alias("_b"))
    out = out.join(opens, ["source_id", "owner"], "left")
    return out.select(
        "tag", "source_id", "block", "owner", "lines", "line0", "at0", "unended", headed.alias("opens"), "rank",
        (F.col("_l") + F.coalesce(F.sum("head_lines").over(inside), F.lit(0))).alias("held_lines"), (F.col("_b") + F.coalesce(F.sum("head_bytes").over(inside), F.lit(0))).alias("held_bytes"),
    )


_JOINED = "source_id string, block long, kind string, rank int, line long, at long, text string, reason string, count long"
_JOINED_SCHEMA = pa.schema([("source_id", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("rank", pa.int32()), ("line", pa.int64()), ("at", pa.int64()), ("text", pa.string()), ("reason", pa.string()), ("count", pa.int64())])


def _joiner(t: Tuning):
    """An event from its pieces."""

    def known(row: dict) -> Iterator[tuple[bytes, int]]:
        at = 0
        for k, size in enumerate(row["sizes"] or ()):
            n = min(size, t.event_max_bytes + 1)
            raw, at = row["payload"][at : at + n], at + n
            if row["unended"] and k == row["n_lines"] - 1:
                yield raw[: size - 1], size - 1
            else:
                yield raw, size

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()  # an open event's block comes before the heads that continue it
        first = rows[0]
        held = _hold(((r["line"], r["at"], r["n_lines"], r["n_bytes"] - bool(r["unended"]), known(r)) for r in rows), t)
        base = (first["source_id"], first["block"])
        out = [(*base, EVENT, first["rank"], first["line"], first["at"], held.text, None, None)]
        if held.lost:
            out.append((*base, CUT, first["rank"], held.lost.line, held.lost.offset, held.lost.sample, held.lost.reason, held.lost.count))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _JOINED_SCHEMA, strict=True)], schema=_JOINED_SCHEMA)

    return run


@dataclass(frozen=True)
class Frames:
    """events: source_id, rank (of the source), seq (its header's line number), text, and what ``shape`` adds."""

    events: DataFrame
    diagnostics: DataFrame


def frames(log: Log, t: Tuning, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Frames:
    """``shape`` works on rows with a text; rows without one (and those of other kinds) must stay.  It runs in the
    stage that frames, so events are written once."""
    ours = [c for c in _NAMES if c != "text"]
    found = stage(shape(pieces(log, t)), "frames")
    layout = stage(_layout(found.select(*ours), log.sources), "blocks")
    few_blocks = few(layout.select("tag", "source_id", "block", "lines", "line0", "at0", "rank", "unended"))
    added = [c for c in found.columns if c not in _NAMES]
    here = found.where(F.col("kind") == EVENT).join(few_blocks, ["tag", "block"]).select("source_id", "rank", (F.col("line0") + F.col("line") + 1).alias("seq"), "text", *added)

    ends = found.where(F.col("kind").isin(HEAD, OPEN)).select(*ours).join(few(layout), ["tag", "block"])
    mine = (F.col("kind") == OPEN) | (F.col("owner").isNotNull() & (F.col("n_lines") > 0))
    # what comes after more than the caps let through is only counted
    over = (F.col("kind") == HEAD) & ((F.col("held_lines") > t.event_max_lines) | (F.col("held_bytes") > t.event_max_bytes))
    last_piece = F.col("unended") & ((F.col("kind") == OPEN) | ~F.col("opens"))
    parts = ends.where(mine).select(
        "source_id", "block", F.when(F.col("kind") == OPEN, F.col("block")).otherwise(F.col("owner")).alias("owner"), "rank", (F.col("line0") + F.col("line") + 1).alias("line"), (F.col("at0") + F.col("at")).alias("at"),
        "n_lines", "n_bytes", F.when(~over, F.col("sizes")).alias("sizes"), F.when(~over, F.col("payload")).alias("payload"), last_piece.alias("unended"),
    )
    joined = parts.groupBy("source_id", "owner").applyInArrow(_joiner(t), _JOINED)
    # shaped like the others: the shape's columns need a text
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(PIECES) if f.name not in {x.split()[0] for x in _JOINED.split(", ")}]
    joined = stage(shape(joined.select("*", *blank)), "joined")
    there = joined.where(F.col("kind") == EVENT).select("source_id", "rank", F.col("line").alias("seq"), "text", *added)

    strip = lambda text, last: F.when(last, F.regexp_replace(text, r"\n\z", "")).otherwise(text)
    raw = found.where(F.col("kind").isin(CUT, FAULT)).select("tag", "block", "line", "at", "text", "reason", "count").join(few_blocks, ["tag", "block"])
    raw = raw.select("source_id", "reason", "count", strip(F.col("text"), F.col("unended") & (F.col("reason") == INVALID) & (F.col("line") == F.col("lines") - 1)).alias("sample"), (F.col("line0") + F.col("line") + 1).alias("line"), (F.col("at0") + F.col("at")).alias("offset"))
    cuts = joined.where(F.col("kind") == CUT).select("source_id", "reason", "count", F.col("text").alias("sample"), "line", F.col("at").alias("offset"))
    loose = found.where((F.col("kind") == HEAD) & F.col("loose_line").isNotNull()).select("tag", "block", "count", "text", "loose_line", "loose_at", "blank_end", "headed", "n_lines")
    loose = loose.join(few(layout), ["tag", "block"]).where("owner is null")
    last = F.col("unended") & ~F.col("opens")
    loose = loose.select("source_id", F.lit(PREFIX).alias("reason"), (F.col("count") - F.when(last & ~F.col("blank_end"), 1).otherwise(0)).alias("count"), strip(F.col("text"), last & (F.col("loose_line") == F.col("n_lines") - 1)).alias("sample"), (F.col("line0") + F.col("loose_line") + 1).alias("line"), (F.col("at0") + F.col("loose_at")).alias("offset"))
    start = lambda c: F.min_by(c, "line").alias(c)
    loose = loose.groupBy("source_id", "reason").agg(F.sum("count").alias("count"), start("sample"), start("offset"), F.min("line").alias("line")).select(*DIAGNOSTICS)
    return Frames(here.unionByName(there), raw.unionByName(cuts).unionByName(loose))


def frame(lines: DataFrame | Log, tuning: Tuning | None = None) -> tuple[DataFrame, DataFrame]:
    """events (source_id, seq, text) and diagnostics; seq is the line number of the event's header.  Diagnostics come in
    no order; line and offset give it."""
    found = frames(lines if isinstance(lines, Log) else in_order(lines), tuning or Tuning())
    return found.events.select("source_id", "seq", "text"), found.diagnostics

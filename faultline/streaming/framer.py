"""Framing of byte chunks, one source at a time, for streams.

``Framer`` is a fold over lines: each is a header, part of the event in hand, or loose, and the event in hand is the
``Held`` that batch framing uses, so caps and cuts are the same.  On a stream it is the state of a keyed processor with
a processing-time timer: two seconds without bytes flush what is in hand; a chunk with no bytes ends its source.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Tuning
from ..operators.caps import INVALID, LATE, PREFIX, Held, Lost, content, is_header, prefix, utf8_faults

IDLE_MS = 2_000
OUT = "source_id string, kind string, seq long, text string, reason string, count long, line long, offset long"


class Framer:
    """Bytes in, events and diagnostics out, in the order of the source."""

    def __init__(self, tuning: Tuning) -> None:
        self.t = tuning
        self.rest = b""  # the unterminated line
        self.line, self.offset = 1, 0  # of the next line
        self.held: Held | None = None
        self.seq = 0  # the line of the event in hand
        self.given = False  # whether its text has gone out: it was cut, or the source was idle
        self.idled = False
        self.loose: Lost | None = None

    def save(self) -> str:
        held = self.held and [self.held.parts, self.held.size, self.held.lost and asdict(self.held.lost)]
        return json.dumps([self.rest.hex(), self.line, self.offset, held, self.seq, self.given, self.idled, self.loose and asdict(self.loose)])

    @classmethod
    def load(cls, saved: str, tuning: Tuning) -> Framer:
        self = cls(tuning)
        rest, self.line, self.offset, held, self.seq, self.given, self.idled, loose = json.loads(saved)
        self.rest, self.loose = bytes.fromhex(rest), Lost(**loose) if loose else None
        if held:
            self.held = Held(tuning, held[0], held[1], Lost(**held[2]) if held[2] else None)
        return self

    def push(self, data: bytes) -> list[tuple]:
        *lines, self.rest = (self.rest + data).split(b"\n")
        out = [row for line in lines for row in self._take(line + b"\n")]
        in_hand = self.held.size if self.held is not None and not self.given else 0
        if in_hand + len(self.rest) > self.t.event_max_bytes:  # what can't fit is taken as a line: memory stays bounded
            out += self._end_line()
        return out

    def idle(self) -> list[tuple]:
        """No bytes for a while: the line is whole and the event complete; what follows it is late."""
        out = self._end_line()
        if self.held is not None and not self.given:
            out += self._give()
            self.held, self.idled = None, True
        return out + self._flush_loose()

    def finish(self) -> list[tuple]:
        """The source has ended."""
        out = self._end_line() + self._close() + self._flush_loose()
        self.held = None
        return out

    def _end_line(self) -> list[tuple]:
        line, self.rest = self.rest, b""
        return self._take(line) if line else []

    def _give(self) -> list[tuple]:
        self.given = True
        return [("event", self.seq, self.held.text, None, None, None, None)]

    def _close(self) -> list[tuple]:
        """All that is still to say of the event in hand."""
        if self.held is None:
            return []
        out = [] if self.given else self._give()
        return out + ([_said(self.held.lost)] if self.held.lost else [])

    def _flush_loose(self) -> list[tuple]:
        loose, self.loose = self.loose, None
        return [_said(loose)] if loose else []

    def _take(self, raw: bytes) -> list[tuple]:
        known = raw[: self.t.event_max_bytes + 1]
        text, out = known.decode("utf-8", "replace"), []
        at, faults = utf8_faults(raw)
        if faults:
            out.append(_said(Lost(INVALID, faults, prefix(text, self.t.sample_max_bytes), self.line, self.offset + at)))
        if header := is_header(content(known)):
            # what was cut off comes before what was loose, and both before the event that ends them
            closed = self._close()
            out += [r for r in closed if r[0] != "event"] + self._flush_loose() + [r for r in closed if r[0] == "event"]
            self.held, self.seq, self.given, self.idled = Held(self.t), self.line, False, False
        if self.held is not None:
            cut = self.held.lost is not None
            if not self.held.add(text, len(raw), self.line, self.offset) and not cut:
                out += self._give()
                self.held.parts = []  # the text is out; what is cut off goes on being counted
        elif not header and content(known):
            if self.loose:
                self.loose.count += len(raw)
            else:
                self.loose = Lost(LATE if self.idled else PREFIX, len(raw), prefix(text, self.t.sample_max_bytes), self.line, self.offset)
        self.line, self.offset = self.line + 1, self.offset + len(raw)
        return out


def _said(lost: Lost) -> tuple:
    return ("diagnostic", None, lost.sample, lost.reason, lost.count, lost.line, lost.offset)


class FramerProcessor(StatefulProcessor):
    """One framer per source.  Chunks are put in the order of their numbers within a batch."""

    def __init__(self, tuning: Tuning) -> None:
        self.tuning = tuning

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("framer", "saved string")

    def _rows(self, key, framer: Framer, found: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((framer.save(),))
        rows = [(key[0], *f) for f in found]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({c: "Int64" for c in ("seq", "count", "line", "offset")})

    def _framer(self) -> Framer:
        return Framer.load(self.state.get()[0], self.tuning) if self.state.exists() else Framer(self.tuning)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        framer, found, ended = self._framer(), [], False
        chunks = sorted((int(k), bytes(b)) for pdf in rows for k, b in zip(pdf["chunk_seq"], pdf["bytes"], strict=True))
        for _, data in chunks:
            found += framer.push(data) if data else framer.finish()
            ended = not data
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + IDLE_MS)
        yield from self._rows(key, framer, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        framer = self._framer()
        yield from self._rows(key, framer, framer.idle())

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame, tuning: Tuning | None = None) -> DataFrame:
    """Events and diagnostics of a stream of (source_id, chunk_seq, bytes); needs the RocksDB state store."""
    return chunks.groupBy("source_id").transformWithStateInPandas(FramerProcessor(tuning or Tuning()), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime")

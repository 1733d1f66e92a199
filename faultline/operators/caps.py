"""What batch and stream framing share: which lines are headers, and how much of an event its caps let through."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field

from ..config import Tuning

BYTE_LIMIT, LINE_LIMIT, PREFIX, LATE, INVALID = "event_byte_limit", "event_line_limit", "unframed_prefix", "unframed_late", "invalid_utf8"

_HEAD = re.compile(rb"[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3} [^ ]+ \*(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\* (?=\[)")
_BRACKET = re.compile(rb"[\[\]]")


def content(line: bytes) -> bytes:
    """A line without its newline and one return before it."""
    return line.removesuffix(b"\n").removesuffix(b"\r")


def is_header(line: bytes) -> bool:
    """Whether a line's stamp, node and level are followed by a context whose brackets close, however deep."""
    if not (found := _HEAD.match(line)):
        return False
    depth = 0
    for bracket in _BRACKET.finditer(line, found.end()):
        depth += 1 if bracket[0] == b"[" else -1
        if not depth:
            return True
    return False


def utf8_faults(raw: bytes) -> tuple[int, int]:
    """(offset of the first fault, number of faults) of bytes that are not valid UTF-8."""
    at: list[int] = []

    def note(error: UnicodeDecodeError) -> tuple[str, int]:
        at.append(error.start)
        return "", error.end

    codecs.register_error("faultline-note", note)
    raw.decode("utf-8", "faultline-note")
    return (at[0], len(at)) if at else (0, 0)


def prefix(text: str, size: int) -> str:
    """The longest prefix of at most ``size`` bytes."""
    return text if len(text) <= size >> 2 else text.encode()[: max(size, 0)].decode("utf-8", "ignore")


@dataclass
class Lost:
    """Bytes that are in no event: where they begin, how many, and the first of them."""

    reason: str
    count: int
    sample: str
    line: int
    offset: int


@dataclass
class Held:
    """An event's text so far, and what its caps have cut off."""

    tuning: Tuning
    parts: list[str] = field(default_factory=list)
    size: int = 0
    lost: Lost | None = None

    def add(self, text: str, size: int, line: int, offset: int) -> bool:
        """Takes a line of ``size`` bytes, of which ``text`` has those up to one past the byte cap; whether it fit."""
        if self.lost:
            self.lost.count += size
            return False
        t, own = self.tuning, len(text.encode())
        if self.parts and len(self.parts) >= t.event_max_lines:
            reason, kept = LINE_LIMIT, ""
        elif self.size + size > t.event_max_bytes or (not self.parts and own > t.event_max_bytes):
            reason, kept = BYTE_LIMIT, prefix(text, t.event_max_bytes - self.size)
        else:
            self.parts.append(text)
            self.size += own
            return True
        used = len(kept.encode())
        self.parts.append(kept)
        self.lost = Lost(reason, max(size - used, 0), prefix(text[len(kept) :], t.sample_max_bytes), line, offset + used)
        return False

    @property
    def text(self) -> str:
        return "".join(self.parts)

"""Redaction: ordered replacements of secrets and personal data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, in the order in which they are applied, with what is kept of a match.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s,;&]+)"""
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("authorization", r"(authorization\s*:\s*)\S+(?:\s+\S+)?", "$1{}"),
    ("bearer", r"(\bbearer\s+)[A-Za-z0-9._\-+/=]{8,}", "$1{}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "{}"),
    ("password", rf"(\b(?:password|passwd|pwd)\s*[=:]\s*){_VALUE}", "$1{}"),
    ("api_key", rf"(\bapi[_-]?key\s*[=:]\s*){_VALUE}", "$1{}"),
    ("token", rf"(\b(?:(?:access|refresh|id)[_-]?token|token)\s*[=:]\s*){_VALUE}", "$1{}"),
    ("query", r"([?&][^=&#\s]+=)([^&#\s]*)", "$1{}"),
    ("email", r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", "{}"),
    ("ip", r"\b(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:)*[0-9a-f]{2,4}::[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)\b", "{}"),
    ("ip", r"(^|[^0-9A-Za-z:])(::1)([^0-9A-Za-z:]|$)", "$1{}$3"),
    ("ip", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "{}"),
)
#: Markers that differ from the pattern's name, if any.
MARK = "[REDACTED:{}]"


def redact(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """All built-in patterns, then the user's, each of whose whole matches becomes a plain marker."""
    for name, pattern, keep in PATTERNS:
        end = pattern.replace("|$)", r"|\z)")
        text = F.regexp_replace(text, "(?iuU)" + end, keep.format(MARK.format(name)))
    for pattern in extra:
        text = F.regexp_replace(text, "(?U)" + pattern, "[REDACTED]")
    return text


def redact_sample(text: Column, raw: bool = False, extra: tuple[str, ...] = ()) -> Column:
    return text if raw else redact(text, extra)


def redact_request(context: Column, extra: tuple[str, ...] = ()) -> Column:
    """A request context with its address and path redacted."""
    rest = ("request_id", "method")
    fields = [redact(context["client_ip"], extra).alias("client_ip"), *(context[k].alias(k) for k in rest), redact(context["path"], extra).alias("path"), context["protocol"].alias("protocol")]
    return F.when(context.isNotNull(), F.struct(*fields))


def check_pattern(pattern: str) -> str | None:
    """Why a user pattern is refused, or None.  Lookaround and backreferences are, for linear-time matching."""
    if re.search(r"\(\?<?[=!]", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        return "lookaround and backreferences are not supported"
    try:
        re.compile(pattern)
    except re.error as error:
        return f"not a valid regex: {error}"
    return None

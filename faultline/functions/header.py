"""Log headers: the boundary test, and every field of a header line with its byte range.

``dd.MM.yyyy HH:mm:ss.SSS node *LEVEL* [context] [logger] message``; brackets balance to any practical depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Nested brackets in a context; each level adds a few characters to the pattern.
DEPTH = 24

_STAMP = r"[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}"


def _brackets(depth: int) -> str:
    inner = r"[^\[\]]*+"
    for _ in range(depth):
        inner = rf"[^\[\]]*+(?:\[{inner}\][^\[\]]*+)*+"
    return rf"\[{inner}\]"


#: Possessive throughout: a long context costs no stack and no backtracking.
HEADER = rf"(?s)\A({_STAMP}) ([^ ]++) \*({'|'.join(LEVELS)})\* ({_brackets(DEPTH)})"
FULL = HEADER + r" (.*)\z"
_DOTTED = r"\A[A-Za-z0-9_$]++(?:\.[A-Za-z0-9_$]++)++\z"
_REQUEST = r"(?s)\A((?:(?! \[).)++) \[((?:(?!\] ).)++)\] (?U:\s*+)(?U:(\S++)\s++(\S++)\s++(\S++)\s*+)\z"


def content(line: Column) -> Column:
    """A line without its newline and one return before it."""
    return F.regexp_replace(line, r"\r?\n?\z", "")


def is_header(line: Column) -> Column:
    return F.coalesce(content(line).rlike(HEADER), F.lit(False))


def _trim_start(text: Column) -> Column:
    return F.regexp_replace(text, r"\A(?U:\s)++", "")


def request_context(thread: Column) -> Column:
    """struct(client_ip, request_id, method, path, protocol), null unless there are exactly three request fields."""
    names = ("client_ip", "request_id", "method", "path", "protocol")
    return F.when(thread.rlike(_REQUEST), F.struct(*(F.regexp_extract(thread, _REQUEST, k).alias(n) for k, n in enumerate(names, 1))))


FIELDS = ("timestamp", "node", "level", "thread", "logger", "message")


def parse(events: DataFrame, text: str = "text") -> DataFrame:
    """Adds timestamp, node, level, thread, logger, message, request_context and offsets of the first line; all are
    null if it is no complete header.  One pattern decides, one finds the context, the rest is cut by position; the
    steps are columns of their own, so nothing is worked out twice."""
    c, size = F.col, F.octet_length
    out = events.withColumn("_line", F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", ""))
    out = out.withColumn("_line", F.when(c("_line").rlike(FULL), c("_line")))
    out = out.withColumn("node", F.substring_index(F.substring(c("_line"), 25, 2**31 - 1), " ", 1))
    out = out.withColumn("_after", F.substring(c("_line"), F.length("node") + 27, F.lit(2**31 - 1)))
    out = out.withColumn("level", F.substring_index("_after", "*", 1))
    out = out.withColumn("_after", F.substring(c("_after"), F.length("level") + 3, F.lit(2**31 - 1)))
    out = out.withColumn("_context", F.regexp_extract("_after", r"\A" + _brackets(DEPTH), 0))
    out = out.withColumns({"_rest": F.substring(c("_after"), F.length("_context") + 2, F.lit(2**31 - 1)), "thread": F.substring(c("_context"), F.lit(2), F.length("_context") - 2)})
    out = out.withColumn("_first", F.regexp_extract("_rest", r"(?sU)\A(\S*+)", 1))
    out = out.withColumn("_own", F.when(c("_first").rlike(_DOTTED), 1).when(c("thread").rlike(_DOTTED), 2).when(c("_line").isNotNull(), 0))
    out = out.withColumns({"logger": F.when(c("_own") == 1, c("_first")).when(c("_own") == 2, c("thread")).when(c("_own") == 0, "unknown"), "message": _trim_start(F.when(c("_own") == 1, F.substring(c("_rest"), F.length("_first") + 2, F.lit(2**31 - 1))).otherwise(c("_rest")))})
    span = lambda start, text: F.struct(start.cast("long").alias("start"), (start + size(text)).cast("long").alias("end"))
    out = out.withColumn("_at", F.lit(28) + size("node") + size("level"))  # of the context
    at_rest, zero = c("_at") + size("_context") + 1, F.lit(0).cast("long")
    offsets = F.struct(
        span(F.lit(0), F.substring(c("_line"), 1, 23)).alias("timestamp"), span(F.lit(24), c("node")).alias("node"), span(F.lit(26) + size("node"), c("level")).alias("level"), span(c("_at") + 1, c("thread")).alias("thread"),
        F.when(c("_own") == 0, F.struct(zero.alias("start"), zero.alias("end"))).otherwise(span(F.when(c("_own") == 1, at_rest).otherwise(c("_at") + 1), c("logger"))).alias("logger"),
        span(size("_line") - size("message"), c("message")).alias("message"),
    )
    out = out.withColumns({"timestamp": F.substring(c("_line"), 1, 23), "request_context": request_context(c("thread")), "offsets": F.when(c("_line").isNotNull(), offsets)})
    return out.drop("_line", "_after", "_context", "_rest", "_first", "_own", "_at")


def grouping_key() -> Column:
    """What events of one exact message share: level, logger and message of a parsed event, joined by unit separators."""
    return F.concat_ws("\x1f", "level", "logger", "message")


def exact_key(text: Column) -> Column:
    """struct(level, key) of an event's text, key being the text from the level on; null unless its first line is a
    complete header."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")
    node, level = F.regexp_extract(line, HEADER, 2), F.regexp_extract(line, HEADER, 3)
    return F.when(line.rlike(HEADER), F.struct(level.alias("level"), F.substring(text, F.length(node) + 26, F.lit(2**31 - 1)).alias("key")))

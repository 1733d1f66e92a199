"""Exception identity: the last declaration of an event and the first stack frame after it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = r"(?:[A-Za-z_][A-Za-z0-9_$]*+\.)++[A-Z][A-Za-z0-9_$]*+"
DECLARED = rf"\A(?U:\s*+)(?:Caused by: |Suppressed: )?({_TYPE})(?=:|\z)"
FRAME = r"\A(?U:\s*+)at (?:[^/]*/|(?![^/]*/))((?:[A-Za-z_][A-Za-z0-9_$]*\.)+(?:<init>|<clinit>|[A-Za-z_][A-Za-z0-9_$]*))\("


def _found(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def declaration(line: Column) -> Column:
    return _found(line, DECLARED)


def frame(line: Column) -> Column:
    return _found(line, FRAME)


def terminal_identity(event: Column, message: Column) -> Column:
    """struct(exception, frame): the last declaration and the first frame after it; the header's message takes part as
    the first line.  Most lines of a stack are frames, which are known by their first characters and of which only the
    first after a declaration is looked at, so few lines meet a pattern."""
    rest = F.substring(event, F.instr(event, "\n") + 1, F.lit(2**31 - 1))
    body = F.when(F.instr(event, "\n") > 0, F.split(F.replace(rest, F.lit("\r\n"), F.lit("\n")), "\n")).otherwise(F.array().cast("array<string>"))
    null = F.lit(None).cast("string")
    head = declaration(message)
    start = F.struct(head.alias("exception"), null.alias("frame"), head.isNotNull().alias("open"))

    def step(state: Column, line: Column) -> Column:
        framed = F.startswith(line, F.lit("\tat "))
        declared = F.when(~framed, declaration(line))
        at = F.when(state["open"], frame(line))
        new = F.struct(declared.alias("exception"), null.alias("frame"), F.lit(True).alias("open"))
        placed = F.struct(state["exception"].alias("exception"), at.alias("frame"), F.lit(False).alias("open"))
        return F.when(framed & ~state["open"], state).when(declared.isNotNull(), new).when(at.isNotNull(), placed).otherwise(state)

    return F.aggregate(body, start, step, lambda s: F.struct(s["exception"].alias("exception"), s["frame"].alias("frame")))

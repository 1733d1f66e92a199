"""Wall-clock stamps to instants, with gaps, overlaps and impossible dates told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONEXISTENT, AMBIGUOUS = "nonexistent_wall_time", "ambiguous_wall_time"


def wall_time(stamp: Column) -> Column:
    """``dd.MM.yyyy HH:mm:ss.SSS`` as a time without zone; null for dates that do not exist."""
    return F.try_to_timestamp(stamp, F.lit("dd.MM.yyyy HH:mm:ss.SSS")).cast("timestamp_ntz")


def interpret(stamp: Column, zone: str, arrival: Column) -> Column:
    """struct(instant, fault).  A wall time that a zone's clocks skip or show twice falls back to the arrival.

    Needs the session zone to be UTC.  The offsets a day before and after are the candidates; one is valid if the
    instant it gives shows the wall time again.  At most one change of offset in two days is assumed."""
    wall = wall_time(stamp)
    null = F.lit(None).cast("string")
    if zone.lower() == "utc":
        instant = wall.cast("timestamp")
        fault = F.when(wall.isNull(), NONEXISTENT).otherwise(null)
        return F.struct(F.coalesce(instant, arrival).alias("instant"), fault.alias("fault"))
    utc = wall.cast("timestamp")
    shown = lambda t: F.from_utc_timestamp(t, zone)
    seconds = lambda t: F.unix_micros(t)
    day = F.expr("interval 1 day")
    candidates = [F.timestamp_micros(seconds(utc) - (seconds(shown(utc + d)) - seconds(utc + d))) for d in (-day, day)]
    valid = [F.when(shown(c) == utc, c) for c in candidates]
    a, b = valid
    none, two = a.isNull() & b.isNull(), a.isNotNull() & b.isNotNull() & (a != b)
    fault = F.when(wall.isNull() | none, NONEXISTENT).when(two, AMBIGUOUS).otherwise(null)
    return F.struct(F.when(fault.isNull(), F.coalesce(a, b)).otherwise(arrival).alias("instant"), fault.alias("fault"))


def rfc3339(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

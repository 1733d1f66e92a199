"""Framed events to selected, timed, tokenised ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions import header, normalize, time
from ..functions.exception import terminal_identity
from .learner import with_keys


def ordered(events: DataFrame) -> DataFrame:
    """Makes seq unique over sources and ordered by source, then line.  Sources are few next to their events."""
    sources = events.select("source_id").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("source_id")) - 1)
    return events.join(sources, "source_id").withColumn("seq", F.col("_rank") * F.lit(1 << 40) + F.col("seq")).drop("_rank")


def parse(events: DataFrame) -> DataFrame:
    """Adds the header's fields and the terminal exception; events without a complete header are dropped."""
    return _parsed(events).where("timestamp is not null")


def _parsed(events: DataFrame) -> DataFrame:
    identity = terminal_identity(F.col("text"), F.col("message"))
    return header.parse(events).withColumn("_id", identity).withColumns({"terminal_exception": F.col("_id.exception"), "terminal_frame": F.col("_id.frame")}).drop("_id")


def select(parsed: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    return parsed.where(F.col("level").isin(*levels))


def interpret(parsed: DataFrame, zone: str, arrival: Column) -> DataFrame:
    """Adds instant and time_fault."""
    return parsed.withColumn("_t", time.interpret(F.col("timestamp"), zone, arrival)).withColumns({"instant": F.col("_t.instant"), "time_fault": F.col("_t.fault")}).drop("_t")


def tokenize(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("tokens", normalize.normalize(F.col("message"))).withColumn("token_count", F.size("tokens"))


def prepare(rows: DataFrame, tuning: Tuning, arrival: Column | None = None) -> DataFrame:
    """All of the above for rows with a text, and the learner's keys.  Events of other levels go; rows without a
    complete header stay, with no timestamp.  ``arrival`` stands in for instants that a stamp does not give; now,
    unless it is given."""
    zone = tuning.timezone if tuning.timezone != "local" else rows.sparkSession.conf.get("spark.sql.session.timeZone")
    kept = _parsed(rows).where(F.col("level").isNull() | F.col("level").isin(*tuning.levels))
    return with_keys(tokenize(interpret(kept, zone, F.current_timestamp() if arrival is None else arrival)))

"""The whole batch dataflow: lines to events, groups, overflow and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Tuning
from ..operators import events as ev
from ..operators import groups as gr
from ..operators import learner
from ..operators.framing import frames
from ..session import prepare, stage
from ..sources.lines import Log, in_order


@dataclass(frozen=True)
class Run:
    analysis: gr.Analysis
    diagnostics: DataFrame

    @property
    def groups(self) -> DataFrame:
        return self.analysis.groups


def analyze(lines: DataFrame | Log, tuning: Tuning | None = None, arrival: Column | None = None, mutes: DataFrame | None = None, raw_sample: bool = False) -> Run:
    """``arrival`` is the instant for stamps that give none; pass a literal for repeatable results.  Lines are framed,
    parsed and written in one stage; all else is built on what it wrote."""
    t = tuning or Tuning()
    log = lines if isinstance(lines, Log) else in_order(lines)
    prepare(log.lines.sparkSession)
    found = frames(log, t, lambda rows: ev.prepare(rows, t, arrival))
    events = found.events.withColumn("seq", F.col("rank") * F.lit(1 << 40) + F.col("seq")).where("timestamp is not null")
    return Run(gr.aggregate(events, learner.learn(events, t), t, mutes, raw_sample), found.diagnostics)


def analyze_events(events: DataFrame, tuning: Tuning | None = None, arrival: Column | None = None, mutes: DataFrame | None = None, raw_sample: bool = False) -> gr.Analysis:
    t = tuning or Tuning()
    prepare(events.sparkSession)
    prepared = stage(ev.prepare(ev.ordered(events), t, arrival).where("timestamp is not null"), "events")
    return gr.aggregate(prepared, learner.learn(prepared, t), t, mutes, raw_sample)

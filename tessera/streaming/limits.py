"""Error limits over all sources: repeats, a limit and a breaker for each source, then one limit for all together.

Two streams: the first keeps state for each source and lets at most its limit through; the second counts what came through, of all sources, under one key.
So the one key meets a bounded number of rows of each source, and a flood of one source stays in that source's task. State of a source ends by a timer once all
it says is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.shared import ship_code


class Limits(NamedTuple):
    """Errors of a source, and of all, that pass in a stretch of seconds; seconds in which repeats are dropped, and for which a flooding source is shut out."""

    per_source: int = 50
    together: int = 200
    stretch: float = 3600.0
    repeats: float = 60.0
    shut: float = 900.0


class Source:
    """What a source's next error meets. seen: times that passed; marks: fingerprints with their times; until: end of the shut-out; held: errors held back since one passed."""

    def __init__(self, limits: Limits, seen=(), marks=(), times=(), until: float = -1e18, held: int = 0):
        self.limits, self.seen, self.marks, self.until, self.held = limits, list(seen), dict(zip(marks, times)), until, held

    def judge(self, now: float, mark: str) -> str:
        if now < self.until:
            self.held += 1
            return "shut"
        if self.until > -1e18:
            self.until, self.held = -1e18, 0
        self.marks = {k: t for k, t in self.marks.items() if now - t < self.limits.repeats}
        if mark in self.marks:
            return "repeat"
        self.marks[mark] = now
        self.seen = [t for t in self.seen if t > now - self.limits.stretch]
        if len(self.seen) < self.limits.per_source:
            self.seen.append(now)
            return "passed"
        self.held += 1
        if self.held >= self.limits.per_source:
            self.until = now + self.limits.shut
        return "limited"

    @property
    def state(self) -> tuple:
        return self.seen, list(self.marks), list(self.marks.values()), self.until, self.held


def _by_time(frames: Iterator[pd.DataFrame]) -> Iterator:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples(index=False)


def by_source(errors: DataFrame, limits: Limits = Limits(), lateness: str = "10 minutes") -> DataFrame:
    """source, event_id, ts, verdict (passed, repeat, limited, shut) of a stream of errors (source, event_id, ts, mark); those of a batch are taken in order of time."""
    ship_code(errors.sparkSession)

    def run(name: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        source, out, last = Source(limits, *kept.get) if kept.exists else Source(limits), [], 0.0
        for row in _by_time(frames):
            last = row.ts.timestamp()
            out.append((row.source, row.event_id, row.ts, source.judge(last, row.mark)))
        kept.update(source.state)
        kept.setTimeoutTimestamp(max(int(1000 * (last + limits.stretch + limits.shut)), kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "event_id", "ts", "verdict"])

    state = "seen array<double>, marks array<string>, times array<double>, until double, held long"
    rows = errors.select("source", "event_id", "ts", "mark").withWatermark("ts", lateness)
    return rows.groupBy("source").applyInPandasWithState(run, "source string, event_id long, ts timestamp, verdict string", state, "append", GroupStateTimeout.EventTimeTimeout)


def together(passed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """source, event_id, allowed: of the errors that passed their source's limits (source, event_id, ts), those within the limit for all sources in a stretch."""
    ship_code(passed.sparkSession)

    def run(name: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        seen, out = list(kept.get[0]) if kept.exists else [], []
        for row in _by_time(frames):
            now = row.ts.timestamp()
            seen = [t for t in seen if t > now - limits.stretch]
            allowed = len(seen) < limits.together
            if allowed:
                seen.append(now)
            out.append((row.source, row.event_id, allowed))
        kept.update((seen,))
        yield pd.DataFrame(out, columns=["source", "event_id", "allowed"])

    rows = passed.select("source", "event_id", "ts", F.lit("all").alias("all"))
    return rows.groupBy("all").applyInPandasWithState(run, "source string, event_id long, allowed boolean", "seen array<double>", "append", GroupStateTimeout.NoTimeout)

"""Stateful twins of the order-dependent operators: state is kept for each key across micro-batches, and rows of a batch are taken in order.

Each gives, once all events have come in order, what its batch twin gives. State of a key is a few numbers, whatever the length of its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folded(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable, output: str, state: str) -> DataFrame:
    """Rows of each key folded in their order: step(state, row) gives the next state and the output rows. start: the state of a new key."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now, out = kept.get if kept.exists else start, []
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            now, made = step(now, row)
            out += made
        kept.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in output.split(", ")])

    return rows.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def segments(stream: DataFrame, threshold: float = 0.74) -> DataFrame:
    """session, position, segment of a stream (session, position, embedding): twin of vectors.segments."""

    def step(now, row):
        number, recent = now
        x = np.asarray(row.embedding, np.float64)
        last = np.frombuffer(recent, np.float64).reshape(-1, len(x))
        if len(last):
            m = last.mean(axis=0)
            if x @ m / max(1e-12, np.linalg.norm(x) * np.linalg.norm(m)) < threshold:
                number, last = number + 1, last[:0]
        last = np.concatenate([last[-1:], x[None]])
        return (number, last.tobytes()), [(row.session, row.position, number)]

    return folded(stream.select("session", "position", "embedding"), "session", ["position"], (0, b""), step, "session string, position long, segment long", "number long, recent binary")


def heartbeats(events: DataFrame, mark: str = "error") -> DataFrame:
    """event_id, user_id, since: events of a user since the last of type mark; twin of activity.since_mark."""

    def step(now, row):
        since = 0 if row.event_type == mark else now[0] + 1
        return (since,), [(row.event_id, row.user_id, since)]

    return folded(events.select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], (0,), step, "event_id long, user_id long, since long", "since long")


def recall_updates(turns: DataFrame) -> DataFrame:
    """conv_id, turn (of a user message), state as it changes: LOGGED, then RESPONSE, then FEEDBACK. The last state of a turn is that of feedback.recall_states."""

    def step(now, row):
        asked, answered = now
        out = []
        if row.role == "assistant" and asked >= 0 and not answered:
            answered = True
            out.append((row.conv_id, asked, "RESPONSE"))
        if row.role == "user":
            if asked >= 0 and answered:
                out.append((row.conv_id, asked, "FEEDBACK"))
            asked, answered = row.turn, False
            out.append((row.conv_id, asked, "LOGGED"))
        return (asked, answered), out

    return folded(turns.select("conv_id", "turn", "role"), "conv_id", ["turn"], (-1, False), step, "conv_id long, turn long, state string", "asked long, answered boolean")


def limited(errors: DataFrame, per_source: int = 5, total: int = 50, minutes: int = 10) -> DataFrame:
    """errors (source, event_id, ts) with passed: whether a source is under its limit in the current stretch of minutes, and its breaker closed.

    A stretch starts with its first error; after `total` errors in one the breaker opens and nothing passes until it is over.
    """

    def step(now, row):
        began, n = now
        at = int(row.ts.timestamp())
        if at - began >= 60 * minutes:
            began, n = at, 0
        n += 1
        return (began, n), [(row.source, row.event_id, bool(n <= per_source and n <= total))]

    return folded(errors.select("source", "event_id", "ts"), "source", ["ts", "event_id"], (-(10**12), 0), step, "source string, event_id long, passed boolean", "began long, n long")


def drained(stream: DataFrame, key: str) -> DataFrame:
    """Rows of a file stream, each surfaced once: the checkpoint holds the mark. Repeats of a key in one run are dropped."""
    return stream.dropDuplicates([key]).withColumn("surfaced", F.lit(True))

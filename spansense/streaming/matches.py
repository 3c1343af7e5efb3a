"""The same queries over streams: finders and expression judges keep no state, counts and sequences keep a bounded one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spansense.operators.pattern import Pattern


def stream_findall(texts: DataFrame, pattern: Pattern, keep: list[str]) -> DataFrame:
    """The matches of a stream of texts with the columns ``keep``; append mode. The judge must be an expression or function, not a join."""
    from spansense.functions.units import explode_spans

    spans = explode_spans(texts, pattern.unit, keys=[pattern.id_col, *keep], text=pattern.text_col)
    return pattern.judge.score(spans, pattern.wording).where(F.col("p") >= pattern.threshold)


def windowed_counts(matches: DataFrame, time: str, *, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``(window_start, window_end, by, matches)`` per tumbling or, with ``slide``, sliding window; rows later than ``late`` are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    rows = matches.withWatermark(time, late).groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("matches"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "matches")


def session_counts(matches: DataFrame, time: str, key: str, *, late: str = "10 minutes", pause: str = "30 minutes") -> DataFrame:
    """``(session_start, session_end, key, matches)``: a key's matches without a pause of ``pause``."""
    rows = matches.withWatermark(time, late).groupBy(F.session_window(time, pause).alias("w"), key).agg(F.count(F.lit(1)).alias("matches"))
    return rows.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "matches")


def stream_sequences(events: DataFrame, *, key: str, time: str, kind: str, steps: list[str], gap: int, within_seconds: float, late: str = "10 minutes") -> DataFrame:
    """``(key, times)`` of each tuple of events of one key whose kinds are ``steps`` in order, at most ``gap`` others between two, within a time.

    A key's state is the partial tuples that can still grow: a tuple is dropped once its gap or time is used up, so the state is bounded by the
    gaps and the steps, not by the stream. Events of a micro-batch are taken by time.
    """

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [list(t) for t in (eval_state(state.get[0]) if state.exists else [])]
        out = []
        if state.hasTimedOut:  # the watermark has passed all that could still grow
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([time, kind])
        for t, what in zip(rows[time].tolist(), rows[kind].tolist()):
            at, fresh = t.timestamp(), []
            for times, skipped in open_:
                if at - times[0] > within_seconds:
                    continue
                if steps[len(times)] == what:
                    grown = [*times, at]
                    (out if len(grown) == len(steps) else fresh).append(grown if len(grown) == len(steps) else [grown, 0])
                if skipped < gap:
                    fresh.append([times, skipped + 1])
            if what == steps[0]:
                (out if len(steps) == 1 else fresh).append([at] if len(steps) == 1 else [[at], 0])
            open_ = fresh
        if open_:
            state.update((dump_state(open_),))
            last = max(max(times) for times, _ in open_)
            state.setTimeoutTimestamp(max(int((last + within_seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "times": out})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.select(key, time, kind).withWatermark(time, late).groupBy(key).applyInPandasWithState(advance, f"{key} {kinds[key]}, times array<double>", "open string", "append", GroupStateTimeout.EventTimeTimeout)


def dump_state(open_: list) -> str:
    import json

    return json.dumps(open_)


def eval_state(text: str) -> list:
    import json

    return json.loads(text)

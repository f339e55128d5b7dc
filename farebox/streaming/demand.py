"""Streams of taps: demand by quarter of an hour and journeys by session windows, with a watermark for late taps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def demand_windows(taps: DataFrame, by: str, at: str = "ts", size: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return taps.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("trips")).select("w.start", by, "trips")


def journey_windows(taps: DataFrame, card: str, at: str = "ts", gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """A journey ends when no tap follows within the gap."""
    return taps.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), card).agg(F.count("*").alias("legs"), F.max(at).alias("last")).select(card, F.col("s.start").alias("start"), "last", "legs")


def journey_states(taps: DataFrame, card: str, tap_id: str = "tap_id", at: str = "ts", starts: str = "starts", gap: int = 3600, late: str = "2 hours") -> DataFrame:
    """(card, start, last, legs) of each journey of a stream of taps: a new one begins after more than gap seconds, or at a tap that starts one
    (starts), which a session window can't say.

    A card's state is its open journey and the taps after the watermark. Taps are taken in order of time and tap_id once the watermark has passed
    them, so taps that are late by less than `late` are in their place; later ones are dropped. A timer closes a journey when no tap can follow
    any more. The state of a card is as large as what it does in `late` and one journey's ends.
    """
    millis = gap * 1000

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, legs, waiting = None, None, 0, []
        if state.exists:
            first, last, legs, times, ids, new = state.get
            waiting = list(zip(times, ids, new, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip((f["at"].astype("int64")).tolist(), f["tap_id"].tolist(), f["new"].astype(bool).tolist(), strict=True)
        passed, out = state.getCurrentWatermarkMs(), []
        waiting.sort()
        ready = [w for w in waiting if w[0] <= passed]
        waiting = waiting[len(ready) :]
        for t, _, new in ready:
            if legs and not new and t - last <= millis:
                last, legs = t, legs + 1
            else:
                if legs:
                    out.append((*key, first, last, legs))
                first, last, legs = t, t, 1
        if legs and passed > last + millis:
            out.append((*key, first, last, legs))
            first, last, legs = None, None, 0
        if legs or waiting:
            state.update((first, last, legs, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            due = [last + millis + 1] if legs else []
            state.setTimeoutTimestamp(max(passed + 1, min([*due, *(w[0] for w in waiting[:1])])))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["card", "start", "last", "legs"])

    kind = dict(taps.dtypes)[card]
    rows = taps.select(F.col(card).alias("card"), F.col(at).alias("_ts"), F.unix_millis(at).alias("at"), F.col(tap_id).cast("long").alias("tap_id"), F.coalesce(F.col(starts).cast("boolean"), F.lit(False)).alias("new"))
    states = "first long, last long, legs long, times array<long>, ids array<long>, new array<boolean>"
    found = rows.withWatermark("_ts", late).groupBy("card").applyInPandasWithState(run, f"card {kind}, start long, last long, legs long", states, "append", "EventTimeTimeout")
    return found.select(F.col("card").alias(card), F.timestamp_millis("start").alias("start"), F.timestamp_millis("last").alias("last"), "legs")

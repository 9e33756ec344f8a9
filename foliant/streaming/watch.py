"""Silent jobs on a stream of heartbeats: a timer for each job raises a row when its own threshold has passed, without any
further input from it.

Beats are job, stage, at, seq, threshold_sec. Before they are shuffled each task keeps the last beat of a job in a batch of
Arrow rows, so a job with a large part of all beats sends few. Beats without job or time are dropped; one without threshold has
the least that a run has, one without seq has 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "stage string, at_us long, seq long, threshold_sec long, told boolean"
_US = 1_000_000
#: Seconds of silence that are allowed to any run. Fixed value.
LEAST = 360


class Silence(StatefulProcessor):
    """The last beat of a job and a timer at the first moment at which it has been silent for longer than its threshold."""

    def __init__(self, final: str) -> None:
        self.final = final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best = (held[1], held[2]) if held else None
        newest = None
        for found in rows:
            for stage, at, seq, threshold in zip(found["stage"], found["at_us"], found["seq"], found["threshold_sec"]):
                if best is None or (at, seq) > best:
                    best, newest = (int(at), int(seq)), (stage, int(at), int(seq), int(threshold))
        if newest is None:
            return
        if held and held[4]:
            yield self._row(key, newest, "resumed", newest[1])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((*newest, False))
        if newest[0] != self.final:
            self.handle.registerTimer(self._expiry(newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        beat = self.last.get()
        if beat and not beat[4] and expiredTimerInfo.getExpiryTimeInMs() == self._expiry(beat):
            self.last.update((*beat[:4], True))
            yield self._row(key, beat, "silent", (beat[1] // _US + beat[3] + 1) * _US)

    def close(self) -> None:
        pass

    def _expiry(self, beat: tuple) -> int:
        """A millisecond before the first whole second at which the silence is longer than the threshold: a timer fires once the
        clock is past it."""
        return (beat[1] // _US + beat[3] + 1) * 1000 - 1

    def _row(self, key, beat: tuple, event: str, told: int) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "stage": [beat[0]], "at_us": [beat[1]], "threshold_sec": [beat[3]], "event": [event], "told_us": [told]})


def _last_of_batch(batches):
    for b in batches:
        yield b.sort_values(["at_us", "seq"], kind="stable").drop_duplicates("job", keep="last")


def alerts(beats: DataFrame, late: str = "1 hour", final: str = "complete", clock: str = "event") -> DataFrame:
    """Rows job, stage, at, threshold_sec, event, told_at of a stream of beats: `silent` once a job's silence is longer than the
    threshold of its last beat, unless its stage is the final one; `resumed` when a beat comes after that.

    By the event clock time passes with the watermark, `late` behind the latest beat of any job, and beats older than that are
    ignored; by the processing clock it passes by itself, also when no job sends anything.
    """
    rows = beats.where("job IS NOT NULL AND at IS NOT NULL").select("job", "stage", F.unix_micros("at").alias("at_us"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce(F.col("threshold_sec").cast("long"), F.lit(LEAST)).alias("threshold_sec"), "at")
    rows = rows.mapInPandas(_last_of_batch, rows.schema)
    if clock == "event":
        rows = rows.withWatermark("at", late)
    job = rows.schema["job"].dataType.simpleString()
    told = rows.groupBy("job").transformWithStateInPandas(
        Silence(final), f"job {job}, stage string, at_us long, threshold_sec long, event string, told_us long", "Append", "EventTime" if clock == "event" else "ProcessingTime")
    return told.select("job", "stage", F.timestamp_micros("at_us").alias("at"), "threshold_sec", "event", F.timestamp_micros("told_us").alias("told_at"))


def suspected(told: DataFrame) -> DataFrame:
    """The jobs that are silent now, by all rows that the stream has raised: those whose last row is `silent`."""
    last = told.groupBy("job").agg(F.max_by(F.struct("stage", "at", "threshold_sec", "told_at", "event"), F.struct("at", F.col("event") == "silent")).alias("l"))
    return last.select("job", "l.*").where("event = 'silent'").drop("event")

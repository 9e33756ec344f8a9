"""Progress of one's own jobs as heartbeats: job, stage, at, seq, threshold_sec, rows, as latest_state, hung and alerts take them.

A batch run beats when a stage has been written, with the rows that an Observation counted on the way (no second pass); a
stream beats with every micro-batch. Beats of a run are files in a folder, so others can follow it as a stream.
"""

from __future__ import annotations

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "job string, stage string, at timestamp, seq long, threshold_sec long, rows long"
#: The stage of a job that is over. Fixed value.
FINAL = "complete"


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Run:
    """A batch job whose stages are written one after the other below a folder, each followed by a beat."""

    def __init__(self, spark: SparkSession, job: str, folder: str, threshold_sec: int = 360) -> None:
        self.spark, self.job, self.folder, self.threshold, self.seq = spark, job, folder.rstrip("/"), threshold_sec, 0

    def _beat(self, stage: str, rows: int | None) -> None:
        beat = self.spark.createDataFrame([(self.job, stage, _now(), self.seq, self.threshold, rows)], SCHEMA)
        beat.coalesce(1).write.mode("append").parquet(f"{self.folder}/beats")
        self.seq += 1

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as a written table; the beat carries how many there are. A stage that fails leaves no beat."""
        seen = Observation(f"{self.job}/{name}/{self.seq}")
        path = f"{self.folder}/{self.seq:03d}-{name}"
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self._beat(name, seen.get["rows"])
        return self.spark.read.schema(rows.schema).parquet(path)

    def finish(self) -> None:
        self._beat(FINAL, None)

    def beats(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/beats")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/beats")


class StreamProgress(StreamingQueryListener):
    """Beats of the streams of a session, by their names: one when a stream starts, one a micro-batch, one when it ends without
    an error. A listener hears of all streams; at most `keep` beats are held, the oldest go."""

    def __init__(self, threshold_sec: int = 360, keep: int = 100_000) -> None:
        self.threshold, self.keep, self.names, self.held, self.lock = threshold_sec, keep, {}, [], threading.Lock()

    def _beat(self, run: str, stage: str, rows: int | None) -> None:
        with self.lock:
            seq = self.held[-1][3] + 1 if self.held else 0
            self.held = [*self.held, (self.names.get(run, run), stage, _now(), seq, self.threshold, rows)][-self.keep :]

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._beat(str(event.runId), "started", None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._beat(str(p.runId), f"batch {p.batchId}", p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._beat(str(event.runId), "idle", 0)

    def onQueryTerminated(self, event) -> None:
        self._beat(str(event.runId), FINAL if event.exception is None else "failed", None)

    def beats(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(self.held, SCHEMA)

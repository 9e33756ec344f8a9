"""The last lines of each job's log, kept while lines arrive.

Lines are job, at (any whole number that orders them), seq, line; ties of at and seq go by the line. A state of at most `most`
lines a job is the ring that new ones push out of. Each task first keeps the last lines of a job in a batch of Arrow rows, so
that no job sends more than `most` of them. Lines without job or text are dropped; null at or seq counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliant.streaming.state import latest, maintain

#: Lines that a log panel shows. Fixed value.
SHOWN = 100


class Ring(StatefulProcessor):
    """The last lines of a job, in a list state."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "at long, seq long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(at), int(seq), line) for at, seq, line in self.lines.get()]
        before = list(held)
        for found in rows:
            new = zip(found["at"].tolist(), found["seq"].tolist(), found["line"].tolist())
            held = sorted([*held, *new])[-self.most :]
        if held != before:
            self.lines.put(held)
            yield pd.DataFrame({"job": [key[0]], "tail": [[line for _, _, line in held]]})

    def close(self) -> None:
        pass


def tails(lines: DataFrame, most: int = SHOWN) -> DataFrame:
    """job, tail (an array, oldest first) of a stream of lines, whenever a job's tail changes."""
    rows = lines.where("job IS NOT NULL AND line IS NOT NULL").select("job", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("at", "seq")), "line")

    def last_of_batch(batches):
        for b in batches:
            yield b.sort_values(["at", "seq", "line"], kind="stable").groupby("job", sort=False).tail(most)

    job = rows.schema["job"].dataType.simpleString()
    return rows.mapInPandas(last_of_batch, rows.schema).groupBy("job").transformWithStateInPandas(Ring(most), f"job {job}, tail array<string>", "Update", "None")


def drain(lines: DataFrame, path: str, checkpoint: str, most: int = SHOWN) -> StreamingQuery:
    """Starts a stream that keeps the tails in a table; a batch that runs again changes nothing."""
    return maintain(tails(lines, most), path, checkpoint)


def shown(spark: SparkSession, path: str, job: str = "string") -> DataFrame:
    """job and tail as the table has them now."""
    return latest(spark, path, f"job {job}, tail array<string>", ["job"])

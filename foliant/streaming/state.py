"""Running streams with keyed state, and tables of the latest row of each key that they maintain."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch writes what it changed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of a partition's files takes megabytes ahead
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed processors need; a stream holds on to the settings it
    started with, so others of the session aren't touched."""
    old = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch to a folder of its own, named by its id: a batch that runs again after a
    failure replaces what it had written."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def maintain(rows: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Starts a stream into such folders; by default it ends with what has arrived."""
    with rocksdb(rows.sparkSession):
        stream = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        return stream.trigger(**trigger or {"availableNow": True}).foreachBatch(by_batch(path)).start()


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that such a stream wrote, with their batch; none if no batch ever ran."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


def latest(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The row of each key that the last batch with that key wrote."""
    rows = history(spark, path, schema)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")

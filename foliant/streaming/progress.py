"""Progress of jobs as a stream of heartbeats: latest state, and silences that tell of a hung job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def heartbeats(events: DataFrame) -> DataFrame:
    """events as heartbeats: job, stage, at."""
    return events.select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


def latest_state(beats: DataFrame) -> DataFrame:
    """The last heartbeat of each job. Works on a batch and, in complete mode, on a stream."""
    return beats.groupBy("job").agg(F.max_by("stage", F.struct("at", "seq")).alias("stage"), F.max("at").alias("at"), F.count("*").alias("beats"))


def sessions(beats: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of heartbeats of a job without a silence longer than the gap; a session's end is the moment of suspicion."""
    marked = beats.withWatermark("at", late) if beats.isStreaming else beats
    return marked.groupBy("job", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("beats")).select("job", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def flushed(closed: DataFrame, beats: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """The sessions that a stream has closed and, its input being over, those of all beats that it still held open."""
    told = closed.select("job", "start", F.lit(True).alias("_told"))
    # An anti join would be pushed below the merging of session windows, where it compares single heartbeats.
    return closed.unionByName(sessions(beats, gap).join(told, ["job", "start"], "left").where("_told IS NULL").select(closed.columns))


def hung(beats: DataFrame, thresholds: DataFrame, as_of: str, done: str = "complete") -> DataFrame:
    """Jobs whose last stage isn't the final one and whose last heartbeat is older than the job's own threshold
    (thresholds: job, threshold_sec). Works on a batch and, in complete mode, on a stream."""
    last = latest_state(beats).join(thresholds, "job")
    silent = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("at")
    return last.select("job", "stage", silent.alias("seconds_since_progress"), "threshold_sec", ((F.col("stage") != done) & (silent > F.col("threshold_sec"))).alias("hung_suspected"))


def stage_history(beats: DataFrame) -> DataFrame:
    """Stages of each job in the order of their first heartbeat."""
    first = beats.groupBy("job", "stage").agg(F.min(F.struct("at", "seq")).alias("f"), F.count("*").alias("beats"))
    return first.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "stage"))), lambda x: x["stage"]).alias("stages"), F.sum("beats").alias("beats"))


def stream_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Heartbeats from files of events as they arrive in a folder."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return heartbeats(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder))


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A table's rows as a stream of its files, whether the table is a folder or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that has arrived and is final."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

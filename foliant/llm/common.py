"""What the operators of this subpackage share: the shared folder, written tables, words and hashes."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space between words: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


class Scratch:
    """The folders and tables that one run of operators has written."""

    def __init__(self) -> None:
        self.folders: list[str] = []
        self.tables: list[str] = []

    def sweep(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Removes them, but for the folder of keep, a written() table. For whoever has consumed or written the operators'
        results, which are lazy and read these folders."""
        kept = getattr(keep, "_folder", None)
        for name in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for folder in [f for f in self.folders if f != kept]:
            _delete(spark, folder)
            self.folders.remove(folder)
        self.tables.clear()


class _Owner:
    """Whose run this thread's operators work for; what runs outside a scope is kept for the process. Workers, which get this
    module by value, start with one of their own."""

    def __init__(self) -> None:
        self.var: ContextVar[Scratch] = ContextVar("scratch", default=Scratch())

    def __reduce__(self):
        return _Owner, ()


_OWNER = _Owner()


def owner() -> Scratch:
    return _OWNER.var.get()


@contextmanager
def scope() -> Iterator[Scratch]:
    """A run of its own: what operators write inside, in this thread, belongs to it and to no other run."""
    mine = Scratch()
    token = _OWNER.var.set(mine)
    try:
        yield mine
    finally:
        _OWNER.var.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one in local mode;
    on a cluster there is no folder to fall back on, so it fails."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    owner().folders.append(folder)
    return folder


#: Bytes of a batch that Spark hands to Python while operators write. Batches of its 64 MB leave executors and workers with
#: memory that neither gives back: buffers beyond the pools' chunks of 4 MB come from malloc, which keeps what is freed.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class _Narrow:
    """Which sessions have small batches for now: how many threads want them, and the setting before. As _Owner, workers start
    with one of their own."""

    def __init__(self) -> None:
        self.lock, self.held = threading.Lock(), {}

    def __reduce__(self):
        return _Narrow, ()


_NARROW = _Narrow()


def _wide(spark: SparkSession) -> bool:
    return spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES


def keep_batches_small(spark: SparkSession) -> None:
    """small_batches() for the rest of the session: for applications whose lazy results are written after they return."""
    with _NARROW.lock:
        if _wide(spark):
            spark.conf.set(_BATCH, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_BYTES at most, or one row, go to Python while this is open; the session's setting comes back when the
    last of its threads has left."""
    own = spark._jsparkSession.sessionUUID()
    with _NARROW.lock:
        n, before = _NARROW.held.get(own, (0, None))
        if not n:
            before = spark.conf.get(_BATCH, None)
            if _wide(spark):
                spark.conf.set(_BATCH, BATCH_BYTES)
        _NARROW.held[own] = (n + 1, before)
    try:
        yield
    finally:
        with _NARROW.lock:
            n, before = _NARROW.held.pop(own)
            if n > 1:
                _NARROW.held[own] = (n - 1, before)
            elif before is None:
                spark.conf.unset(_BATCH)
            else:
                spark.conf.set(_BATCH, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Removes the folder of a written() table that nothing reads any more."""
    _delete(df.sparkSession, df._folder)


def lean(run):
    """run, a function of Arrow batches, that gives back what it has freed: a reused worker else keeps the peak of every
    operator that ran in it."""

    def lean_run(batches):
        import ctypes

        import pyarrow as pa

        try:
            trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            trim = lambda _: None
        for b in run(batches):
            yield b
            b = None  # freed before the next is made
            trim(0)
        pa.default_memory_pool().release_unused()
        trim(0)

    return lean_run


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns of these names (in any case) under names of their own, and what selects docs' columns, under
    their old names, from a result that has kept them."""
    taken = {n.lower() for n in names}
    new = {c: f"_aside{i}_{uuid.uuid4().hex}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{k}`").alias(c) for c, k in new.items()])

    return docs.select(*[F.col(f"`{c}`").alias(k) for c, k in new.items()]), back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text in order; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, as long; a null has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))

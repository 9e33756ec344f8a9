"""Versions of a set of tables that readers see change together.

A version's tables are written to a folder of their own; it counts once a file of its number, which names that folder, stands in
root/_committed. The file is written elsewhere and renamed, which never replaces another. So readers have all tables of a version
or all of the one before, a publisher that fails leaves but a folder that nobody reads, and of two that start from the same
version one fails and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _store(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that count, ascending."""
    return [int(n) for n in _names(spark, f"{root}/_committed") if n.isdigit()]


def _folder(spark: SparkSession, root: str, version: int) -> str:
    fs, at = _store(spark, f"{root}/_committed/{version:08d}")
    with_it = fs.open(at)
    try:
        return f"{root}/" + spark._jvm.org.apache.commons.io.IOUtils.toString(with_it, "UTF-8")
    finally:
        with_it.close()


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or of the last; none where nothing was published."""
    there = versions(spark, root)
    if version is None and not there:
        return {}
    version = there[-1] if version is None else version
    if version not in there:
        raise ValueError(f"no version {version}")
    folder = _folder(spark, root, version)
    return {n: spark.read.parquet(f"{folder}/{n}") for n in _names(spark, folder)}


def publish(tables: dict[str, DataFrame], root: str, base: int | None = None) -> int:
    """Writes the tables as the version that follows base (the last one by default); its number. Tables may be made from older
    versions of root. Fails, and changes nothing, if base has been followed already."""
    spark = next(iter(tables.values())).sparkSession
    version = (max(versions(spark, root), default=0) if base is None else base) + 1
    name = f"tables-{version:08d}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    fs, mark = _store(spark, f"{root}/_committed/{version:08d}")
    draft = _store(spark, f"{root}/{name}.version")[1]
    out = fs.create(draft, True)
    out.write(name.encode())
    out.close()
    fs.mkdirs(mark.getParent())
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: nothing is replaced
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(mark.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, mark, options)
    except Exception as e:
        for path in (f"{root}/{name}", f"{root}/{name}.version"):
            at = _store(spark, path)[1]
            fs.delete(at, True)
        raise FileExistsError(f"version {version} is there already") from e
    return version


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Removes all versions but the last `keep`, marks first, so no reader finds half a version; the numbers that went. The last
    one always stays."""
    old = versions(spark, root)[: -max(1, keep)]
    for v in old:
        folder = _folder(spark, root, v)
        for path in (f"{root}/_committed/{v:08d}", folder):
            fs, at = _store(spark, path)
            fs.delete(at, True)
    return old

"""Files of output folders as a long frame: folder, path (below it), modified, size, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as X

#: What is published, and what is not. Fixed values.
PUBLISHED, SKIPPED = ("pdf", "png", "jpg", "jpeg", "json", "tex", "txt"), ("log", "aux", "out", "toc")


def scan(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """All files below root/<folder>/; an absent root gives no rows. Without contents only names and sizes are read."""
    schema = "folder string, path string, modified timestamp, size long" + (", content binary" if contents else "")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    whole = store.makeQualified(path).toString().rstrip("/") + "/"
    below = F.when(F.col("path").startswith(whole), F.substring("path", len(whole) + 1, 1 << 30)).otherwise("")
    return files.where(below.contains("/")).select(F.split_part(below, F.lit("/"), F.lit(1)).alias("folder"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if contents else []))


def texts(files: DataFrame) -> DataFrame:
    """JSON and log files with their content as text."""
    return files.where(F.col("path").rlike(r"\.(json|log)$")).withColumn("content", F.decode("content", "UTF-8"))


def publishable(files: DataFrame, name: Column) -> DataFrame:
    """What may be published, with type, size and MIME type."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(ext.isin(*PUBLISHED) & ~ext.isin(*SKIPPED)).select("folder", F.col("path").alias("relative_path"), X.asset_type(F.col("path"), name).alias("asset_type"), F.col("size").alias("byte_size"), X.mime_type(F.col("path")).alias("mime_type"))


def page_numbers(files: DataFrame) -> DataFrame:
    """Pages that have a source, by folder, in order."""
    number = F.regexp_extract("path", r"^page_(\d{3})\.tex$", 1)
    return files.where(number != "").groupBy("folder").agg(F.array_sort(F.collect_set(number.cast("int"))).alias("pages"))


def output_names(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """The one name that a folder's files share, or why there is none."""
    top = files.where(~F.col("path").contains("/")).groupBy("folder").agg(F.collect_list("path").alias("files"))
    return top.select("folder", X.output_name(F.col("files"), suffixes).alias("n")).select("folder", "n.*")


def last_updated(files: DataFrame) -> DataFrame:
    """When a folder's reports last changed."""
    reports = F.col("path").rlike(r"^[^/]*_(quality_report|publish_report|pipeline_state|metadata)\.json$")
    return files.groupBy("folder").agg(F.date_format(F.max(F.when(reports, F.col("modified"))), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"))

"""Search without a scan of all texts: an index of trigrams in blocks.

Documents are dealt to blocks of about `block` by a hash of their id, so a trigram's documents in a block are a short array of
their places, however common it is and whatever the ids. A query's tokens are cut into trigrams; the rarest few of each token name the blocks and, intersected
there, the candidates, whose texts are then searched for the tokens themselves. So the result is that of catalog.search: a
token shorter than three characters names no candidates and is only checked; if all are, all texts are scanned.

Tables below the index's folder: texts (part, block, place, id, text) and grams (bucket, gram, block, places), both sorted so that
filters skip files and row groups, and sizes (gram, bucket, blocks, documents).
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import catalog as C

_WIDE = 256  # blocks of a part of the texts
_SCHEMAS = {
    "texts": "block int, place int, id long, text string, part int",
    "grams": "block int, gram string, places array<int>, bucket int",
    "sizes": "gram string, blocks long, documents long, bucket int",
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the index, which may be empty."""
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, block: int = 4096, buckets: int | None = None) -> None:
    """Writes the index of documents; ids are unique. Texts that are null or empty hold no token and are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("id").cast("long").alias("id"), C.search_text().alias("text")).where("text <> '' AND id IS NOT NULL")
    blocks = max(1, ceil(rows.count() / block))
    buckets = buckets or max(64, blocks // 16)
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1  # a block's rows
    texts = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("place", place)
    texts.withColumn("part", F.floor(F.col("block") / _WIDE).cast("int")).sortWithinPartitions("part", "block", "place").write.partitionBy("part").parquet(f"{path}/texts")
    # Dealt by block, a block's trigrams meet without another shuffle; only their arrays move, to their buckets.
    held = _table(spark, path, "texts").select("block", "place", "text").repartition("block")
    each = held.select("block", "place", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)(?=(.{3}))"), 1))).alias("gram"))
    grams = each.groupBy("block", "gram").agg(F.array_sort(F.collect_list("place")).alias("places")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    grams.repartition("bucket", F.floor(F.col("block") / _WIDE)).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/grams")
    sizes = _table(spark, path, "grams").groupBy("gram").agg(F.count("*").alias("blocks"), F.sum(F.size("places")).alias("documents"), F.first("bucket").alias("bucket"))
    sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/sizes")


def grams_of(token: str) -> list[str]:
    return list(dict.fromkeys(token[i : i + 3] for i in range(len(token) - 2)))


def chosen(spark: SparkSession, path: str, query: str, few: int = 2) -> list[tuple[str, int, int]] | None:
    """gram, bucket and blocks of the rarest grams of the query's tokens, `few` of each; None if one is nowhere."""
    wanted = {t: grams_of(t) for t in C.tokens(query)}
    names = sorted({g for gs in wanted.values() for g in gs})
    rows = _table(spark, path, "sizes").where(F.col("gram").isin(names)).collect() if names else []  # as many as the query has grams
    found = {r.gram: r for r in rows}
    if len(found) < len(names):
        return None
    best = {g for gs in wanted.values() for g in sorted(gs, key=lambda g: (found[g].documents, g))[:few]}
    return [(g, found[g].bucket, found[g].blocks) for g in sorted(best)]


def candidates(spark: SparkSession, path: str, some: list[tuple[str, int, int]]) -> DataFrame:
    """block and place of documents that hold all of some grams; a block brings one array of each gram."""
    grams = _table(spark, path, "grams").where(F.col("bucket").isin(sorted({b for _, b, _ in some})) & F.col("gram").isin([g for g, _, _ in some]))
    met = grams.groupBy("block").agg(F.collect_list("places").alias("all")).where(F.size("all") == len(some))
    both = F.aggregate(F.slice("all", 2, max(1, len(some) - 1)), F.col("all")[0], F.array_intersect) if len(some) > 1 else F.col("all")[0]
    return met.select("block", F.explode(both).alias("place"))


def search(spark: SparkSession, path: str, query: str, few: int = 2) -> DataFrame:
    """id of the documents whose search text holds every token of the query."""
    found = C.tokens(query)
    texts = _table(spark, path, "texts")
    some = chosen(spark, path, query, few)
    if some is None:
        return texts.select("id").limit(0)
    if some:
        named = candidates(spark, path, some).withColumn("part", F.floor(F.col("block") / _WIDE).cast("int"))
        texts = texts.join(named, ["part", "block", "place"], "left_semi")
    return texts.where(reduce(and_, (F.col("text").contains(t) for t in found), F.lit(True))).select("id")

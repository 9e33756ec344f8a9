"""The corpus pipeline: toxicity, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the one before has kept, and returns a DataFrame; all but the
last return the columns of documents as they are, whatever their names; columns that a stage computes on the way don't
replace them. Rows whose doc_id is null pass the dedup stages. Of rows that repeat an id, those with unlike texts are
documents of their own; of those with the same text one stays, the least by its JSON. Null texts count as empty ones. Other
columns than those of documents go by names of their own within a stage, so names may hold anything. The stages bound the
bytes of a batch that the session hands to Python, also for what is written after they return (common.BATCH_BYTES).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, mixing, packing, repeats, shingles, toxicity

#: Words of a passage that may stand in one document only.
PASSAGE = 13
#: The tokenizer by whose ids documents are packed.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The columns of documents.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def of_documents(stage: Stage) -> Stage:
    """The stage on documents whose other columns, whatever their names, have plain ones; they get theirs back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.keep_batches_small(spark)
        names = {c if c in OWN else f"_column{i}": c for i, c in enumerate(docs.columns)}
        plain = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in names.items()])
        return stage(spark, plain, sf_dir).select(*[F.col(n).alias(c) for n, c in names.items()])

    return run


@of_documents
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels, doesn't call toxic."""
    model = toxicity.train(spark, docs, sf_dir)
    held, back = common.aside(docs, "score", "predicted")
    return back(toxicity.score(held, model).where("predicted = 0"))


@of_documents
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near copies; of rows that repeat an id, those whose texts are no near copies.

    Few rows are dropped or repeated; a filter of bounded size tells which rows may be, and only these are shuffled.
    """
    found = shingles.near_copies(docs)
    each = found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    odd = each.join(least, "component").withColumn("drop", F.struct("doc_id", "key") != F.col("least")).where("drop OR n > 1")
    odd = common.written(odd.select("key", F.col("doc_id").alias("id"), "drop"))
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("id"))
    rows = shingles.filtered(rows, "key", odd)
    some = rows.where("_may").join(odd, ["key", "id"], "left")
    one = some.where("NOT drop").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    kept = rows.where("NOT _may").select("row.*").union(some.where("drop IS NULL").select("row.*")).union(one.select("row.*"))
    return kept.union(docs.where("doc_id IS NULL"))


@of_documents
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a lesser one holds; those of which nothing is left go."""
    held, back = common.aside(docs, "n_words", "n_removed", "kept_sha256", "removed")
    cut = repeats.remove_repeats(held, PASSAGE).where("n_removed = 0 OR n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return back(cut.withColumn("n_chars", chars))


@of_documents
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    held, back = common.aside(docs, *mixing.RESULT)
    return back(mixing.mix(held, mixing.WEIGHTS).where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their tokens, in bins of 2048 tokens."""
    common.keep_batches_small(spark)
    docs = docs.select("doc_id", "source", "text")
    pieces = packing.pack(packing.token_units(docs, TOKENIZER))
    return packing.placed(pieces, docs, TOKENIZER).drop("key")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scope() as own:
        for _, stage in STAGES:
            docs = common.written(stage(spark, docs, sf_dir))
            own.sweep(spark, docs)
    return docs

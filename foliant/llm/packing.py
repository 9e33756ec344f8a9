"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are placed in decreasing order of size into the fullest bin that can take them. Bins are kept in order of
their residual capacity and carry bitmaps: which duplicate clusters they hold, and, in one plane for each place, which
sources. From the least sufficient residual the search goes on to successors until the tightest compatible bin is
found; a bin never holds two members of a cluster nor more than `per_source` documents of a source. A document larger
than a bin is cut: whole bins, and a rest that is packed like a document. Nothing is dropped.

Packing runs in groups of about `group` documents, dealt by a hash, so a source or cluster of any share of the rows is
spread over all of them; conflicts are exact, for bins don't cross groups.

Sizes are a tokenizer's ids (token_units, whose ids placed() gives by pieces and sequences() by bins, with the documents' bounds) or words
(units_of). A null text has size 1, the end token, as an empty one has, and no cluster. Null sources are a source of their own.
Repeated rows are copies (0, 1, ...) of one another, and of one cluster. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import lean, let, table, word_array, written
from foliant.llm.tokens import Encoder, slices

#: Bytes of text that a task encodes at once, and the pieces whose ids it keeps: what a worker holds goes with its task.
_SLICE, _KEPT = 2 << 20, 100_000
SCHEMA = "bin_id long, doc_id long, copy int, source string, piece int, start long, n_tokens long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each item. sizes are at most the capacity; sources and clusters are small numbers (cluster -1: none)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[tuple[int, int]] = []
    held: list[int] = []
    planes: list[list[int]] = []
    out = [0] * len(sizes)
    for i in order:
        size, source, cluster = sizes[i], 1 << sources[i], 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (held[b := bins[at][1]] & cluster or planes[b][-1] & source):
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
        else:
            left, b = capacity, len(held)
            held.append(0)
            planes.append([0] * per_source)
        out[i] = b
        held[b] |= cluster
        for k, p in enumerate(planes[b]):
            if not p & source:
                planes[b][k] = p | source
                break
        if left > size:
            insort(bins, (left - size, b))
    return out


def _small(values: list) -> list[int]:
    numbers: dict = {}
    return [numbers.setdefault(v, len(numbers)) for v in values]


def pack(units: DataFrame, capacity: int = 2048, per_source: int = 4, group: int = 8192) -> DataFrame:
    """The pieces of units (doc_id, source, n_tokens, cluster, and a key if they have one; equal rows are copies; other
    columns are not read): SCHEMA, and the key, a row for each piece. Units of equal size are placed by a hash of the row."""
    own = ["doc_id", "source", "n_tokens", "cluster", *(["key"] if "key" in units.columns else [])]
    schema = SCHEMA + (", key long" if "key" in own else "")
    rows = units.groupBy(*own).agg(F.count("*").alias("_n"))
    rows = written(rows.select(*own, F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("copy")))
    groups = max(1, ceil(rows.count() / group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_order"], ascending=[False, True], kind="stable")
        whole, rest = (pdf["n_tokens"] // capacity).tolist(), (pdf["n_tokens"] % capacity).tolist()
        placed = [i for i, r in enumerate(rest) if r]
        sources = _small([None if pd.isna(s) else s for s in pdf["source"]])
        clusters = pdf["_cluster"].tolist()
        times: dict = {}
        for i in placed:
            times[clusters[i]] = times.get(clusters[i], 0) + 1
        bits = {c: n for n, c in enumerate(c for c, t in times.items() if c and t > 1)}
        at = best_fit([rest[i] for i in placed], [sources[i] for i in placed], [bits.get(clusters[i], -1) for i in placed], capacity, per_source)
        bins, n = dict(zip(placed, at)), max(at, default=-1) + 1
        base, out = int(pdf["_part"].iloc[0]) << 32, []
        keys = [(k,) for k in pdf["key"]] if "key" in own else [()] * len(pdf)
        for i, (doc, copy, source) in enumerate(zip(pdf["doc_id"], pdf["copy"], pdf["source"])):
            doc, source = None if pd.isna(doc) else int(doc), None if pd.isna(source) else source
            for k in range(whole[i]):
                out.append((base + n, doc, copy, source, k, k * capacity, capacity, *keys[i]))
                n += 1
            if rest[i]:
                out.append((base + bins[i], doc, copy, source, whole[i], whole[i] * capacity, rest[i], *keys[i]))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")]).astype({"doc_id": "Int64"})

    order = F.xxhash64("copy", *own)
    dealt = rows.select("*", order.alias("_order"), F.coalesce(F.hex("cluster"), F.lit("")).alias("_cluster"), F.pmod(order, F.lit(groups)).alias("_part"))
    return dealt.groupBy("_part").applyInPandas(run, schema)


def _encoded(docs: DataFrame, path: str, text: str, end_id: int) -> DataFrame:
    """id, key (a hash of the text) and the ids of each text with the end token."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(path, _KEPT)
        for b in batches:
            for lo, hi in slices(b.column(2), _SLICE):
                n, ids = encode.column(b.column(2).slice(lo, hi - lo))
                closed = np.full(len(ids) + len(n), end_id, np.int32)
                closed[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                bounds = pa.array(np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:2]), pa.ListArray.from_arrays(bounds, pa.array(closed))], ["id", "key", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "id long, key long, ids array<int>")


def units_of(docs: DataFrame, text: str = "text", cluster: Column | None = None) -> DataFrame:
    """What pack() takes: tokens are words and an end; a cluster is the texts with the same words in any case."""
    words = let(word_array(F.lower(F.col(text))), lambda w: F.struct((F.size(w) + 1).cast("long").alias("n"), F.when(F.size(w) > 0, F.xxhash64(w)).alias("h")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("w"), (F.lit(None).cast("long") if cluster is None else cluster.cast("long")).alias("c"))
    return found.select("doc_id", "source", F.col("w.n").alias("n_tokens"), (F.col("w.h") if cluster is None else F.col("c")).alias("cluster"))


def token_units(docs: DataFrame, path: str, text: str = "text", end_id: int = 0) -> DataFrame:
    """What pack() takes, by the ids of a tokenizer's file and an end token; a cluster is the texts that are the same but
    for white space and the case of A-Z. key is a hash of the text."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).alias("unit"), F.xxhash64(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def plain(t: pa.Scalar) -> bytes:
        return b" ".join(t.as_py().encode("utf-8", "surrogatepass").lower().split())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(path, _KEPT)
        for b in batches:
            for lo, hi in slices(b.column(2), _SLICE):
                some = b.column(2).slice(lo, hi - lo)
                n, _ = encode.column(some)
                cluster = pa.array([xxhash.xxh64_intdigest(w) - (1 << 63) if (w := plain(t)) else None for t in some], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:2]), pa.array(n + 1), cluster], ["unit", "key", "n_tokens", "cluster"])

    return rows.mapInArrow(lean(run), "unit struct<doc_id: long, source: string>, key long, n_tokens long, cluster long").select("unit.*", "n_tokens", "cluster", "key")


def placed(pieces: DataFrame, docs: DataFrame, path: str, text: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of token_units() of docs with their tokens (ids)."""
    ids = _encoded(docs, path, text, end_id).dropDuplicates(["id", "key"]).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("ids").alias("_ids"))
    cut = pieces.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return cut.withColumn("ids", F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))).drop("_id", "_key", "_ids")


def sequences(pieces: DataFrame, docs: DataFrame, path: str, text: str = "text", end_id: int = 0) -> DataFrame:
    """bin_id, ids (the bin's tokens) and documents (doc_id, copy, a, b: where each piece lies in ids) of the pieces of
    token_units() of docs."""
    row = F.struct("piece", "doc_id", "copy", "key", "ids")
    held = placed(pieces, docs, path, text, end_id).select("bin_id", row.alias("r")).groupBy("bin_id").agg(F.array_sort(F.collect_list("r")).alias("r"))  # a bin's capacity of tokens
    ends = F.transform("r", lambda x, i: F.aggregate(F.slice("r", F.lit(1), i + 1), F.lit(0), lambda s, y: s + F.size(y["ids"])))
    places = F.zip_with("r", ends, lambda x, e: F.struct(x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), (e - F.size(x["ids"])).alias("a"), e.alias("b")))
    return held.select("bin_id", F.flatten(F.transform("r", lambda x: x["ids"])).alias("ids"), places.alias("documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(token_units(docs, public_tokenizers.path("byte_bpe_50k.json"))).drop("key")

"""Packs of documents, and what operators exchange between packs and hash buckets.

A pack holds some megabytes of texts, compressed, under an id; it is written once to a table bucketed by that id. A task
turns a pack into sorted arrays of hashes and sends them to hash buckets; a bucket answers each pack with an array
that is aligned with what the pack sent. So a hash that very many documents share is one entry for each pack, and
what moves is a few bytes for each word.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import lean, owner, shared_dir, small_batches

#: Odd multipliers for the places of a window, by splitmix64.
MULTIPLIERS = []
_x = 0x243F6A8885A308D3
for _ in range(2 * 64):
    _x = (_x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    _z = ((_x ^ (_x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    _z = ((_z ^ (_z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    MULTIPLIERS.append((_z ^ (_z >> 31)) | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as an array of two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, 2)


def window_hashes(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each window of `width` entries of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += h[j : j + n] * np.uint64(MULTIPLIERS[salt + j])
    return mix(out)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], 5))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def deltas(sorted_values: np.ndarray) -> list[np.ndarray]:
    """Sorted unsigned 32-bit values as planes of their differences, which compress."""
    d = np.diff(sorted_values, prepend=np.uint32(0)).astype(np.uint32)
    return [(d & np.uint32(0xFFFF)).astype(np.uint16), (d >> np.uint32(16)).astype(np.uint16)]


def undeltas(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.cumsum(low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16)), dtype=np.uint32)


def pack(docs: DataFrame, columns: list[str], buckets: int, target: int = 4_000_000) -> DataFrame:
    """A table of packs (pack, body) in the shared folder, bucketed by pack; each holds rows of the columns, about `target`
    bytes of the last."""
    spark, name = docs.sparkSession, f"llm_packs_{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            body = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(held, 5))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([body], pa.binary())], ["pack", "body"])

        for b in batches:
            for r in zip(*b.columns):  # a batch of long texts is far larger as Python's
                r = tuple(x.as_py() for x in r)
                held.append(r)
                size += len(r[-1] or "") + 16
                if size >= target:
                    yield row()
                    held, size, n = [], 0, n + 1
        if held:
            yield row()

    made = docs.select(*columns).mapInArrow(lean(run), "pack long, body binary")
    owner().tables.append(name)
    with small_batches(spark):
        made.write.bucketBy(buckets, "pack").option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def rows_of(body: bytes) -> list[tuple]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def to_buckets(packs: DataFrame, answers: DataFrame | None, task: Callable[[int, list[tuple], list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """pack, bucket, blob: what task(pack, rows, answers as (bucket, blob)) sends to buckets."""

    def run(batches):
        for b in batches:
            for row in zip(*(c for c in b.columns)):
                p, body, *got = (c.as_py() for c in row)
                out = list(task(p, rows_of(body), [(g["bucket"], g["blob"]) for g in (got[0] or [])] if got else []))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(out), pa.int64()), pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["pack", "bucket", "blob"])

    return with_answers(packs, answers).mapInArrow(lean(run), "pack long, bucket int, blob binary")


def with_answers(packs: DataFrame, answers: DataFrame | None) -> DataFrame:
    """pack, body and, joined by pack, the array of (bucket, blob) that answers have for it."""
    if answers is None:
        return packs
    return packs.join(answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "blob")).alias("got")), "pack", "left").select("pack", "body", "got")


def in_buckets(sent: DataFrame, n: int, task: Callable[[list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """pack, bucket, blob: what task(everything sent to a bucket as (pack, blob)) answers to packs."""
    return by_bucket(sent, n, lambda bucket, held: ((p, bucket, blob) for p, blob in task(held)), "pack long, bucket int, blob binary", ["pack", "bucket", "blob"])


def by_bucket(sent: DataFrame, n: int, task: Callable[[int, list[tuple[int, bytes]]], Iterable[tuple]], schema: str, names: list[str]) -> DataFrame:
    """The rows of task(bucket, everything sent to it as (pack, blob)), in n tasks; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        bucket, held = None, []

        def rows():
            out = []
            for r in task(bucket, held):
                out.append(r)
                if len(out) == 64:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], arrow)

        for b in batches:
            for p, k, blob in zip(*(c for c in b.columns)):
                if (k := k.as_py()) != bucket:
                    if held:
                        yield from rows()
                    bucket, held = k, []
                held.append((p.as_py(), blob.as_py()))
        if held:
            yield from rows()

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return sent.select("pack", "bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket", "pack").mapInArrow(lean(run), schema)

"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees over shards.

Fingerprints that differ in at most `radius` of 64 bits agree, by the pigeonhole principle, in some choice of `agree`
of `radius + agree` bit blocks. Each choice of blocks and their value names a shard. A shard's BK-tree (children keyed
by integer Hamming distance to the parent) is built in the task that holds it and searched along the edges within the
radius. A shard of more than `shard_rows` fingerprints is split into several trees, and its fingerprints are sent to
each of those trees, so no task's tree exceeds the bound and no link is lost. The fingerprints of all documents have no
size bound, so trees travel to their probes by a shuffle and not by a driver-side broadcast.

A tree's task reports its links as stars (each fingerprint and the least document it is linked with there), never as
pairs; alternating large-star and small-star steps join them to components.

Nulls in the text count as empty; texts without words have fingerprint zero and link like any other. Repeated rows get
the same result each. Texts are read whole, in blocks of bounded size. Rows whose id is null form no links of their own
and are dropped. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import lean, partitions, table, written

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text's shingles, each as often as it occurs: bit set where over half the XXH64 values have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, _BLOCK):
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id (long) and fp (the fingerprint as a signed long) of each document."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(lean(run), "doc_id long, fp long")


class BKTree:
    """Integers under the Hamming distance, each with a payload."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.payload: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int, payload: int) -> None:
        at, new = 0, len(self.keys)
        self.keys.append(key)
        self.payload.append(payload)
        self.children.append({})
        while new:
            d = (self.keys[at] ^ key).bit_count()
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, key: int, radius: int) -> list[int]:
        """The nodes whose keys differ from key in at most radius bits."""
        out: list[int] = []
        todo = [0] if self.keys else []
        keys, children = self.keys, self.children
        while todo:
            at = todo.pop()
            d = (keys[at] ^ key).bit_count()
            if d <= radius:
                out.append(at)
            todo += [c for e, c in children[at].items() if -radius <= e - d <= radius]
        return out


def _links(rows, radius: int):
    """Star links of each shard tree. rows: (key, tree, probe, fp, doc) ordered by (key, tree, probe)."""
    shard, tree, parent = None, BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def ended():
        return [(x, r) for x in parent if (r := root(x)) != x]

    for key, part, probe, fp, doc in rows:
        if (key, part) != shard:
            yield from ended()
            shard, tree, parent = (key, part), BKTree(), {}
        fp &= (1 << 64) - 1
        for node in tree.within(fp, radius):
            parent.setdefault(doc, doc)
            a, b = root(doc), root(parent.setdefault(tree.payload[node], tree.payload[node]))
            parent[max(a, b)] = min(a, b)
        if not probe:
            tree.add(fp, doc)
    yield from ended()


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choices_of(radius: int, count: int, rows: int = 64) -> list[int]:
    """Masks of bit blocks such that fingerprints within the radius agree on one of them; more blocks the larger `count` is,
    so that a shard holds `rows` of them on average at most."""
    agree = 1
    while count > rows << (64 * agree // (radius + agree)):
        agree += 1
    masks = _block_masks(radius + agree)
    return [sum(masks[i] for i in c) for c in combinations(range(radius + agree), agree)]


def links(nodes: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """Star links (a, b), a > b, between the documents of nodes (fp, doc; fp distinct) within the radius."""
    count = nodes.count()
    choices = choices_of(radius, count)
    keys: list[Column] = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(choices)]
    keyed = nodes.select("fp", "doc", F.explode(F.array(*keys)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    trees = F.coalesce(F.ceil(F.col("n") / shard_rows).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("trees")).cast("int")
    dealt = (
        keyed.join(hot, "key", "left").withColumn("trees", trees).withColumn("own", own)
        .select("key", "fp", "doc", "own", F.explode(F.sequence("own", F.col("trees") - 1)).alias("tree"))
        .select("key", "tree", (F.col("tree") != F.col("own")).cast("int").alias("probe"), "fp", "doc")
    )
    n = max(partitions(nodes.sparkSession), ceil(count * len(choices) / 500_000))

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple[int, int]] = []
        for link in _links(rows(), radius):
            out.append(link)
            if len(out) == _BLOCK:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return dealt.repartition(n, "key", "tree").sortWithinPartitions("key", "tree", "probe").mapInArrow(lean(run), "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node with an edge (a, b); alternating star steps until none changes."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = state(e)
    while before[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        if (now := state(e)) == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, shard_rows: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links, the document's own included)."""
    fps = written(fingerprints(docs, text=text, width=width))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    found = components(links(nodes, radius, shard_rows))
    classes = nodes.join(found, nodes["doc"] == found["node"], "left").select(F.col("fp"), F.coalesce("component", "doc").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Substring dedup by fixed-block anchors.

A window of `width` words contains a whole block of k = (width + 1) // 2 words that starts at a multiple of k, wherever
it lies. So the index holds the non-overlapping k-word blocks of every document, and every rolling k-word window
probes it. An anchor found in more than one place is extended to all windows around it; these candidates are compared by
96-bit hashes of all their words, and each learns the least document that holds it. Windows of a lesser document that
overlap or touch join to maximal repeats, which are removed and told as spans.

Anchors and candidates travel between packs and hash buckets (see packs), so a passage in very many documents is one
entry of each pack; no pairs are formed, and anchors only narrow the search: what they let through is judged by all words.

Null and empty texts have no words. Repeated rows, having one id, don't remove each other's words. A row with a null id
keeps its text and removes nothing. Texts are read whole, of any length. Other columns pass through; n_words,
n_removed, kept_sha256 and removed are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from foliant.llm import packs as P
from foliant.llm.common import BATCH_BYTES, lean, partitions, table, written

_NO_ID = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def _places(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each hash, as one sortable number."""
    return ((h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32)) | (h & _LOW)


def _cuts(places: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(places, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


class _Pack:
    """The hashes of a pack's documents. rows: (id, ..., text)."""

    def __init__(self, rows: list[tuple], width: int, buckets: int) -> None:
        self.rows, self.width, self.k, self.buckets = rows, width, (width + 1) // 2, buckets
        hashes = [P.word_hashes((r[-1] or "").encode("utf-8", "surrogatepass").split()) for r in rows]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.uint64)
        del hashes
        self.docs = np.array([_NO_ID if r[0] is None else r[0] for r in rows], np.int64)
        place = (np.arange(len(self.words)) - np.repeat(self.starts[:-1], self.sizes)).astype(np.int32)
        left = np.repeat(self.sizes.astype(np.int32), self.sizes) - place
        self.anchored = left >= self.k  # words at which a whole rolling window starts
        self.wide = left >= width
        n = len(self.words)
        grams = np.zeros(n, np.uint64)
        full = P.window_hashes(np.ascontiguousarray(self.words[:, 0]), self.k)
        grams[: len(full)] = full
        keys = _places(grams[self.anchored], buckets)
        self.probes, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.inverse, self.counts = inverse.astype(np.int32), counts.astype(np.int32)  # numbers of a pack's words
        del keys, grams, full, inverse, counts
        self.indexed = np.zeros(len(self.probes), bool)
        self.indexed[self.inverse[(place[self.anchored] % self.k) == 0]] = True

    def send_probes(self):
        cuts = _cuts(self.probes, self.buckets)
        for b in range(self.buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if hi > lo:
                yield b, P.squeeze(*P.deltas((self.probes[lo:hi] & _LOW).astype(np.uint32)), np.packbits(self.indexed[lo:hi]))

    def take_anchors(self, answers: list[tuple[int, bytes]]) -> None:
        """Marks candidate windows: those around a block that is indexed somewhere and occurs twice or more."""
        found, cuts = self.indexed & (self.counts > 1), _cuts(self.probes, self.buckets)
        for b, blob in answers:
            found[cuts[b] : cuts[b + 1]] |= np.unpackbits(P.unsqueeze(blob)[0], count=int(cuts[b + 1] - cuts[b])).astype(bool)
        hit = np.zeros(len(self.words) + 1, np.int32)
        hit[1:][self.anchored] = found[self.inverse]
        total, n = np.cumsum(hit, dtype=np.int32), len(self.words)
        ends = np.minimum(np.arange(n) + self.width - self.k + 1, n)
        self.at = np.nonzero(self.wide & (total[ends] > total[:n]))[0]
        low, high = (P.window_hashes(np.ascontiguousarray(self.words[:, c]), self.width, s) for c, s in ((0, 0), (1, 64)))
        low, high = low[self.at], _places(high[self.at], self.buckets)
        self.owner = np.repeat(self.docs, self.sizes)[self.at]
        order = np.lexsort((low, high))
        low, high = low[order], high[order]
        new = np.ones(len(order), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.nonzero(new)[0]
        self.low, self.high = low[first], high[first]
        self.least = np.minimum.reduceat(self.owner[order], first) if len(first) else np.zeros(0, np.int64)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def send_windows(self):
        cuts = _cuts(self.high, self.buckets)
        for b in range(self.buckets):
            s = slice(cuts[b], cuts[b + 1])
            if s.stop > s.start:
                yield b, P.squeeze(*P.deltas((self.high[s] & _LOW).astype(np.uint32)), self.low[s], self.least[s])

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Whether each word goes."""
        least, cuts = self.least.copy(), _cuts(self.high, self.buckets)
        for b, blob in answers:
            mask, values = P.unsqueeze(blob)
            at = np.nonzero(np.unpackbits(mask, count=int(cuts[b + 1] - cuts[b])))[0]
            least[cuts[b] + at] = values
        goes = self.at[(least[self.group] < self.owner) & (self.owner != _NO_ID)]
        change = np.zeros(len(self.words) + self.width + 1, np.int64)
        np.add.at(change, goes, 1)
        np.add.at(change, goes + self.width, -1)
        return np.cumsum(change)[: len(self.words)] > 0


def _shared_anchors(held: list[tuple[int, bytes]]):
    """Answers each pack which of its probes are indexed by some pack and sent by two or more."""
    sent = []
    for p, blob in held:
        low, high, mask = P.unsqueeze(blob)
        keys = P.undeltas(low, high)
        sent.append((p, keys, np.unpackbits(mask, count=len(keys)).astype(bool)))
    index = np.unique(np.concatenate([k[m] for _, k, m in sent]))
    if not len(index):
        return
    places, times = [], np.zeros(len(index), np.int64)
    for _, keys, _ in sent:
        at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
        there = index[at] == keys
        times[at[there]] += 1
        places.append((at.astype(np.uint32), there))  # index has 32-bit values
    for (p, _, _), (at, there) in zip(sent, places):
        hit = there & (times[at] > 1)
        if hit.any():
            yield p, P.squeeze(np.packbits(hit))


def _least_documents(held: list[tuple[int, bytes]]):
    """Answers each pack the least document of its windows where that is in another pack."""
    sent = [(p, *P.unsqueeze(blob)) for p, blob in held]
    high = np.concatenate([P.undeltas(a, b) for _, a, b, _, _ in sent])
    low, least = (np.concatenate([s[c] for s in sent]) for c in (3, 4))
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    first = np.nonzero(new)[0]
    best = np.minimum.reduceat(least[order], first)
    overall = np.empty(len(order), np.int64)
    overall[order] = best[np.cumsum(new) - 1]
    at = 0
    for p, *_, own in sent:
        mine = overall[at : at + len(own)]
        at += len(own)
        if (less := mine < own).any():
            yield p, P.squeeze(np.packbits(less), mine[less])


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text: str = "text", bucket_words: int = 3_000_000) -> DataFrame:
    """docs with text less what repeats a lesser document (untouched texts stay as they are), n_words, n_removed, kept_sha256
    and removed, the maximal repeats as spans of words (a to b, b not included)."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text, "n_words", "n_removed", "kept_sha256", "removed")]
    size = docs.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    buckets = max(8, ceil(size / 6 / bucket_words))
    tasks = max(partitions(spark), ceil(size / 24_000_000))
    packed = P.pack(docs.withColumn(id_col, F.col(id_col).cast("long")), [id_col, *others, text], tasks)

    def probes(_, rows, got):
        return _Pack(rows, width, buckets).send_probes()

    def windows(_, rows, got):
        p = _Pack(rows, width, buckets)
        p.take_anchors(got)
        return p.send_windows()

    anchors = written(P.in_buckets(P.to_buckets(packed, None, probes), tasks, _shared_anchors))
    least = P.in_buckets(P.to_buckets(packed, anchors, windows), tasks, _least_documents)
    answers = written(least.withColumn("bucket", -1 - F.col("bucket"))).union(anchors)
    schema = docs.select(id_col, *others, text).withColumn(id_col, F.col(id_col).cast("long")).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    schema = schema.add("removed", ArrayType(StructType().add("a", "integer").add("b", "integer")))

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def judged(rows: list[tuple], got: list[dict]) -> tuple[np.ndarray, list[int]]:
            """Whether each word goes, and where documents start; the pack's arrays are freed before its rows are made."""
            p = _Pack(rows, width, buckets)
            p.take_anchors([(g["bucket"], g["blob"]) for g in got if g["bucket"] >= 0])
            return p.removed([(-1 - g["bucket"], g["blob"]) for g in got if g["bucket"] < 0]), p.starts.tolist()

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for b in batches:
            for body, got in zip(b.column(1), b.column(2)):
                rows = P.rows_of(body.as_py())
                (goes, starts), out, size = judged(rows, got.as_py() or []), [], 0
                for r, a, z in zip(rows, starts, starts[1:]):
                    gone = goes[a:z]
                    words = (r[-1] or "").encode("utf-8", "surrogatepass").split()
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                    body_text = kept.decode("utf-8", "surrogatepass") if gone.any() else r[-1]
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                    spans = [{"a": x, "b": y} for x, y in zip(edges[::2], edges[1::2])]
                    out.append((*r[:-1], body_text, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
                    size += len(kept)
                    if size >= BATCH_BYTES:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    return P.with_answers(packed, answers).mapInArrow(lean(cut), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM d),
g AS (SELECT doc_id, p, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram FROM w QUALIFY p <= n - 12),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

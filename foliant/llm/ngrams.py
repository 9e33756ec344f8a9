"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, held as sorted hash arrays.

p(w | v) = max(c(v w) - D(c), 0) / c(v .) + g(v) p(w), with discounts D for counts 1, 2 and more from the counts of
counts, g(v) what discounting freed; p(w) likewise from the number of words that w follows, interpolated with
1 / (V + 1), so an unknown word has a share and all shares add up to one. Every text starts in a context of its own
and ends with an end token.

Counting sends each task's distinct bigrams to hash buckets, so a bigram of any frequency is one entry for each task. A task
sends to 256 buckets at most; where there are more, relays merge what has come for some bits of the bucket, by tens of MB, and
send it on by eight bits more, so the number of blobs grows with the input and not with its square.
A bucket becomes a file in the shared folder: bigram hashes in order (32 bits each behind a directory of the next
bits), counts beside them; another holds the words' statistics. Workers map the files into memory (where the shared
folder is no local path, they read them one at a time) and look up a batch of texts, sorted by hash.

The order is two: at order three, files and exchange exceed four times the input on texts as varied as the test data's.

Null texts count as empty: an end token alone. Rows with a null id are scored, and learnt from where `train` says so.
Without training rows every probability is 1 / (V + 1) = 1. Texts are read whole. Repeated rows count and are scored
each. Other columns pass through; those named like a measure are replaced.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import packs as P
from foliant.llm import store
from foliant.llm.common import lean, partitions, shared_dir, table, written

_DIGEST = xxhash.xxh3_64_digest
_START, _END = (int.from_bytes(_DIGEST(x), "little") for x in (b" start", b" end"))
_SLOT_BITS = 14  # of a bigram file's directory
#: Bits of a bucket's number by which a sender tells buckets apart, and the bytes that a relay merges at once.
FAN_BITS, _RELAY = 8, 64_000_000


def _hashes(text: str | None) -> np.ndarray:
    """The token hashes of a text, the end included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.frombuffer(b"".join(map(_DIGEST, words)), np.uint64)
    out[-1] = _END
    return out


def _contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[np.cumsum(sizes) - sizes] = _START
    return v


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return P.mix(v * np.uint64(P.MULTIPLIERS[0]) + w * np.uint64(P.MULTIPLIERS[1]))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each distinct one starts in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1]) if len(s) else np.zeros(0, np.int64)


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)] if bits else [0, len(keys)]


def _batches(columns, most: int = 1_000_000):
    """Runs of texts of about `most` tokens: their indices, token hashes and sizes."""
    at, held, n = [], [], 0
    for i, t in enumerate(columns):
        h = _hashes(t.as_py())
        at.append(i)
        held.append(h)
        n += len(h)
        if n >= most:
            yield at, np.concatenate(held), np.array([len(h) for h in held])
            at, held, n = [], [], 0
    if at:
        yield at, np.concatenate(held), np.array([len(h) for h in held])


def _send(kind: int, key: np.ndarray, columns: list[np.ndarray], by: np.ndarray, bits: int):
    """The columns by bucket (top bits of key), ordered by `by` within it, which compresses."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    order = np.lexsort((by, bucket))
    names, first = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield kind, b, P.squeeze(*(c[order[lo:hi]] for c in columns))


def _added_pairs(held: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Keys and columns (v, w, c) of distinct bigrams of some blobs, their counts added, and what they are ordered by."""
    v, w, c = (np.concatenate(x) for x in zip(*map(P.unsqueeze, held)))
    g = _pair(v, w)
    order, first = _groups(g)
    v, w, g, c = v[order][first], w[order][first], g[order][first], np.add.reduceat(c[order].astype(np.int64), first)
    return g, [v, w, c], v


def _added_words(held: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The same of words and their statistics."""
    word, *stats = (np.concatenate(x) for x in zip(*map(P.unsqueeze, held)))
    order, first = _groups(P.mix(word))
    word = word[order][first]
    return P.mix(word), [word, *(np.add.reduceat(s[order].astype(np.int64), first) for s in stats)], word


def _routed(sent: DataFrame, added, bits: int, tasks: int, fan: int) -> DataFrame:
    """sent (pack, bucket, blob), whose buckets are of the first `fan` bits, as it is to come to buckets of all bits."""
    for have in range(fan, bits, fan):
        sent = _relayed(sent, added, min(bits, have + fan), tasks)
    return sent


def _relayed(sent: DataFrame, added, bits: int, tasks: int) -> DataFrame:
    def run(batches):
        bucket, held, size = None, [], 0

        def flush():
            key, columns, by = added(held)
            for kind, b, blob in _send(0, key, columns, by, bits):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["pack", "bucket", "blob"])

        for b in batches:
            for k, blob in zip(b.column(1).to_pylist(), b.column(2)):
                if held and (k != bucket or size >= _RELAY):
                    yield from flush()
                    held, size = [], 0
                bucket = k
                held.append(blob.as_py())
                size += len(held[-1])
        if held:
            yield from flush()

    # A bucket is dealt over several relays, for each merges only a part of it.
    salt = F.pmod(F.xxhash64("blob"), F.lit(max(1, tasks >> FAN_BITS)))
    return sent.select("pack", "bucket", "blob").repartition(tasks, "bucket", salt).sortWithinPartitions("bucket").mapInArrow(lean(run), "pack long, bucket int, blob binary")


def _count(docs: DataFrame, text: str, bits: int) -> DataFrame:
    def run(batches):
        held, sizes, total = [], [], 0

        def flush():
            w, n = np.concatenate(held), np.array(sizes)
            v = _contexts(w, n)
            g = _pair(v, w)
            order, first = _groups(g)
            c = np.diff(np.append(first, len(g))).astype(np.uint32)
            s = order[first]
            for _, b, blob in _send(0, g[s], [v[s], w[s], c], v[s], bits):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["pack", "bucket", "blob"])

        for b in batches:
            for t in b.column(0):
                held.append(_hashes(t.as_py()))
                sizes.append(len(held[-1]))
                total += sizes[-1]
                if total >= 1_500_000:
                    yield from flush()
                    held, sizes, total = [], [], 0
        if held:
            yield from flush()

    return docs.select(text).mapInArrow(lean(run), "pack long, bucket int, blob binary")


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they fit."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """A file of arrays, one after the other, behind their lengths and the bytes of their items; returns its name."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.itemsize for a in arrays)], np.int64).tobytes()
    return store.save(folder, name, [head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])


class Files:
    """The model's files, mapped into memory where the shared folder is a local path."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def arrays(self, name: str, kinds: list[type]) -> list[np.ndarray]:
        raw = store.load(self.folder, name)
        n = int(raw[:8].view(np.int64)[0])
        at, out = 8 + 16 * n, []
        head = raw[8:at].view(np.int64).tolist()
        for size, item, kind in zip(head[:n], head[n:], kinds):
            width = size * item
            out.append(raw[at : at + width].view(kind if np.dtype(kind).itemsize == item else np.uint32))
            at += width + -width % 8
        return out


_PAIR_KINDS = [np.uint32, np.uint32, np.uint8, np.uint32, np.int64]
_WORD_KINDS = [np.uint64] + [np.int64] * 6


def _merge_pairs(bucket: int, held: list[tuple[int, bytes]], folder: str, bits: int, fan: int):
    """Writes a bucket's bigrams; sends its words' statistics on. Rows: pack (0: file, 1: statistics), bucket, blob, name, n1..n4, types."""
    g, (v, w, c), _ = _added_pairs([blob for _, blob in held])
    rest = g << np.uint64(bits)
    slots = np.searchsorted(rest >> np.uint64(64 - _SLOT_BITS), np.arange((1 << _SLOT_BITS) + 1, dtype=np.uint64)).astype(np.uint32)
    keys = ((rest << np.uint64(_SLOT_BITS)) >> np.uint64(32)).astype(np.uint32)
    large = np.nonzero(c >= 255)[0]
    name = _save(folder, f"pairs-{bucket}", [slots, keys, np.minimum(c, 255).astype(np.uint8), large.astype(np.uint32), c[large]])
    yield (0, bucket, None, name, *(int((c == k).sum()) for k in (1, 2, 3, 4)), len(g))
    order, first = _groups(v)
    cv = c[order]
    add = lambda x: np.add.reduceat(x.astype(np.int64), first)
    zero = np.zeros(len(first), np.int64)
    stats = [[v[order][first], zero, zero, add(cv), add(cv == 1), add(cv == 2), add(cv > 2)]]
    order, first = _groups(w)
    zero = np.zeros(len(first), np.int64)
    stats.append([w[order][first], np.add.reduceat(c[order], first), np.diff(np.append(first, len(order))), zero, zero, zero, zero])
    joined = [np.concatenate(x) for x in zip(*stats)]
    joined[2:] = map(_narrow, joined[2:])
    for _, b, blob in _send(1, P.mix(joined[0]), joined, joined[0], min(bits, fan)):
        yield (1, b, blob, None, 0, 0, 0, 0, 0)


def _merge_words(bucket: int, held: list[tuple[int, bytes]], folder: str):
    """Writes a bucket's words. Rows: bucket, name, n1..n4 of the words followed, more (words with 3 or more), words, tokens."""
    keys, (_, *stats), _ = _added_words([blob for _, blob in held])
    name = _save(folder, f"words-{bucket}", [keys, stats[0], *map(_narrow, stats[1:])])
    known, follows = stats[0] > 0, stats[1]
    yield (bucket, name, *(int((follows[known] == k).sum()) for k in (1, 2, 3, 4)), int((follows[known] > 2).sum()), int(known.sum()), int(stats[0].sum()))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 1, 2, 3 and more; where counts of counts are missing, an absolute discount."""
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def fit(docs: DataFrame, text: str = "text", fan: int = FAN_BITS) -> dict:
    """The model of the texts: file names by bucket and a few totals; its size is a few bytes a bucket."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    bits, folder = max(3, ceil(log2(max(1, size / 6 / 2_000_000)))), shared_dir(spark)
    tasks = max(partitions(spark), ceil(size / 24_000_000))
    schema = "pack long, bucket int, blob binary, name string, n1 long, n2 long, n3 long, n4 long, types long"
    names = [f.split()[0] for f in schema.split(", ")]
    sent = _routed(_count(docs, text, min(bits, fan)), _added_pairs, bits, tasks, fan)
    merged = written(P.by_bucket(sent, tasks, lambda b, held: _merge_pairs(b, held, folder, bits, fan), schema, names))
    pairs = merged.where("pack = 0").drop("blob")
    word_schema = "bucket int, name string, n1 long, n2 long, n3 long, n4 long, more long, words long, tokens long"
    words = written(P.by_bucket(_routed(merged.where("pack = 1"), _added_words, bits, tasks, fan), tasks, lambda b, held: _merge_words(b, held, folder), word_schema, [f.split()[0] for f in word_schema.split(", ")]))
    total = lambda df, *cs: [x or 0 for x in df.agg(*(F.sum(c) for c in cs)).first()]
    *n, types = total(pairs, "n1", "n2", "n3", "n4", "types")
    *m, more, v, tokens = total(words, "n1", "n2", "n3", "n4", "more", "words", "tokens")
    d2 = _discounts(*m)
    return {
        "folder": folder, "bits": bits, "pairs": {r[0]: r[1] for r in pairs.select("bucket", "name").collect()}, "words": {r[0]: r[1] for r in words.select("bucket", "name").collect()},
        "d": _discounts(*n), "d_low": d2, "types": types, "vocabulary": v, "tokens": tokens,
        "free_low": (d2[0] * m[0] + d2[1] * m[1] + d2[2] * more) / types if types else 1.0,
    }


class Scorer:
    """log10 probabilities of token sequences under a model."""

    def __init__(self, model: dict) -> None:
        self.m, self.files = model, Files(model["folder"])

    def _word_stats(self, words: np.ndarray) -> np.ndarray:
        """The six statistics of distinct words, zeros where unknown."""
        keys, out = P.mix(words), np.zeros((6, len(words)), np.int64)
        order = np.argsort(keys)
        keys, cuts = keys[order], _cut(keys[order], self.m["bits"])
        for b, name in self.m["words"].items():
            lo, hi = cuts[b], cuts[b + 1]
            if hi > lo:
                known, *stats = self.files.arrays(name, _WORD_KINDS)
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                hit = known[at] == keys[lo:hi]
                for row, s in zip(out, stats):
                    row[order[lo:hi][hit]] = s[at[hit]]
        return out

    def _pair_counts(self, g: np.ndarray) -> np.ndarray:
        """How often each bigram was counted."""
        bits, out = self.m["bits"], np.zeros(len(g), np.int64)
        order = np.argsort(g)
        g = g[order]
        cuts = _cut(g, bits)
        for b, name in self.m["pairs"].items():
            lo, hi = cuts[b], cuts[b + 1]
            if hi == lo:
                continue
            slots, keys, small, large, counts = self.files.arrays(name, _PAIR_KINDS)
            rest = g[lo:hi] << np.uint64(bits)
            slot = (rest >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            key = ((rest << np.uint64(_SLOT_BITS)) >> np.uint64(32)).astype(np.uint32)
            left, right = slots[slot].astype(np.int64), slots[slot + 1].astype(np.int64)
            end = right.copy()
            while (open_ := left < right).any():  # all binary searches at once
                mid = (left + right) >> 1
                less = open_ & (keys[np.minimum(mid, len(keys) - 1)] < key)
                left = np.where(less, mid + 1, left)
                right = np.where(open_ & ~less, mid, right)
            at = np.minimum(left, len(keys) - 1)
            hit = (left < end) & (keys[at] == key)
            c = np.where(hit, small[at].astype(np.int64), 0)
            over = np.nonzero(c == 255)[0]
            c[over] = counts[np.searchsorted(large, at[over])] if len(over) else 0
            out[order[lo:hi]] = c
        return out

    def __call__(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its log10 probability, that of the smoothed unigram base, and how many tokens are known."""
        m, v = self.m, _contexts(tokens, sizes)
        words, at = np.unique(np.concatenate([tokens, [np.uint64(_START)]]), return_inverse=True)
        count, follows, after, n1, n2, n3 = self._word_stats(words)
        d, low = np.array([0.0, *m["d"]]), np.array([0.0, *m["d_low"]])
        types, unseen = max(1, m["types"]), 1 / (m["vocabulary"] + 1)
        p_low = np.maximum(follows - low[np.minimum(follows, 3)], 0) * (follows > 0) / types + m["free_low"] * unseen
        free = np.where(after > 0, (m["d"][0] * n1 + m["d"][1] * n2 + m["d"][2] * n3) / np.maximum(after, 1), 1.0)
        starts = np.cumsum(sizes) - sizes
        w_at = at[: len(tokens)]
        v_at = np.empty_like(w_at)
        v_at[1:] = w_at[:-1]
        v_at[starts] = at[-1]
        c = self._pair_counts(_pair(v, tokens))
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(after[v_at], 1) + free[v_at] * p_low[w_at]
        base = np.log10((count + 1) / (m["tokens"] + m["vocabulary"] + 1))[w_at]
        add = lambda x: np.add.reduceat(x, starts)
        return add(np.log10(p)), add(base), add((count > 0)[w_at].astype(np.int64))


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two file names a bucket of two million bigrams
    new = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    cols = [c for c in docs.columns if c not in new]
    schema = docs.select(*cols).schema
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            for at, tokens, sizes in _batches(b.column(cols.index(text))):
                total, base, known = scorer(tokens, sizes)
                out = [pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(at), shared.value["tokens"], np.int64)), pa.array(base), pa.array(total), pa.array(10 ** (-total / sizes))]
                yield pa.RecordBatch.from_arrays([*b.slice(at[0], len(at)).columns, *out], [*cols, *new])

    return docs.select(*cols).mapInArrow(lean(run), schema)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

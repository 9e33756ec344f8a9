"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (hashed into a table of embeddings) and itself, so an unseen misspelling
shares vectors with the words it resembles. A passage is the average of its words' vectors and goes into a softmax of
two classes. A document scores as its most toxic passage, every window of `window` words being one (short ones: neighbours dilute); so a slur counts
the same in a short and in a very long text. Training alternates: the model picks each training document's worst
passage, then embeddings and softmax learn together from those passages (and random ones of clean documents).

The model is fitted on at most `max_docs` labelled documents of either class, chosen by a hash of the id (training is
bounded by that parameter) with `max_chars` characters together, texts of more than a quarter of that last, but one in any case; all documents are scored over whole texts. Nulls count as empty texts, which get the
softmax's score of an empty bag. Rows with a null id or label don't train; conflicting labels of one id train as they
stand; of rows that repeat an id one trains. With training labels of one class only, every score is that class's value (0 without any label). Other columns are not read; repeated rows get the same score each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import lean, table


@dataclass
class Model:
    """Every word's contribution is linear in the averages, so scoring needs one number for each n-gram slot."""

    slots: np.ndarray  # logit of each slot's vector
    bias: float
    bits: int
    window: int
    lengths: tuple[int, int] = (3, 5)
    constant: float | None = None


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _bags(words: list[str], bits: int, lengths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all words' n-grams, and the word (its place) that each belongs to."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start, end, of = np.cumsum(lens) - lens, np.cumsum(lens), np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(points)) - start[of]
    power = np.cumprod(np.full(int(lens.max()), _MULTIPLIERS[0]), dtype=np.uint64)
    hashes, owners = [np.add.reduceat(points * power[place], start)], [np.arange(len(words))]
    for k in range(lengths[0], lengths[1] + 1):
        n = len(points) - k + 1
        if n <= 0:
            break
        own = of[:n]
        fits = (np.arange(k, k + n) <= end[own]) & (k < lens[own])
        h = sum(points[j : j + n] * _MULTIPLIERS[j % 5] for j in range(k)) + np.uint64(k)
        hashes.append(h[fits])
        owners.append(own[fits])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


_EDGE = ".,;:!?\"'()[]{}|*#"


def words_of(text: str | None) -> list[str]:
    """Lower-case words; punctuation at a word's ends is cut, as long as something is left."""
    return [w.strip(_EDGE) or w for w in (text or "").lower().split()]


def _passage_logits(values: np.ndarray, window: int) -> np.ndarray:
    """The average of each window's word values; of the whole text where it is shorter."""
    if len(values) <= window:
        return np.array([values.mean()]) if len(values) else np.zeros(1)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[window:] - total[:-window]) / window


class Scorer:
    """Scores texts; keeps the values of the words it has seen, up to a bound."""

    def __init__(self, model: Model, keep: int = 300_000) -> None:
        self.model, self.keep, self.values = model, keep, {}

    def _learn(self, words: list[str]) -> dict[str, float]:
        m = self.model
        slots, of = _bags([w.strip(_EDGE) or w for w in words], m.bits, m.lengths)
        found = np.bincount(of, m.slots[slots]) / np.bincount(of)
        if len(self.values) + len(words) > self.keep:
            self.values.clear()
        self.values.update(new := dict(zip(words, found.tolist())))
        return new

    def __call__(self, text: str | None) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        ws = (text or "").lower().split()
        vs = list(map(self.values.get, ws))
        if None in vs:
            new = self._learn(list({w for w, v in zip(ws, vs) if v is None}))
            vs = [new[w] if v is None else v for w, v in zip(ws, vs)]
        z = _passage_logits(np.array(vs, np.float64), m.window).max() + m.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[str | None], labels: list[int], dim: int = 8, bits: int = 18, window: int = 2, rounds: int = 8, epochs: int = 2, least: int = 200, rate: float = 0.4, seed: int = 7) -> Model:
    """Embeddings and softmax, learned together, in `least` steps a round at least. Deterministic for given rows in a given order."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), 0.0, 0, window, constant=float(y[0]) if len(y) else 0.0)
    lengths, rng, vocabulary = (3, 5), np.random.default_rng(seed), {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int64) for t in texts]
    if not vocabulary:
        return Model(np.zeros(1), 0.0, 0, window, constant=float(y.mean()))
    known, parts = list(vocabulary), []
    for lo in range(0, len(known), 20_000):  # a word's n-grams take far more room while they are found than after
        slots, of = _bags(known[lo : lo + 20_000], bits, lengths)
        parts.append((slots.astype(np.int32)[np.argsort(of, kind="stable")], np.bincount(of)))
    flat, sizes = (np.concatenate(x) for x in zip(*parts))
    first = np.concatenate([[0], np.cumsum(sizes)])
    del parts, known, slots, of
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(1 << bits, 1e-4, np.float32), np.full(soft.shape, 1e-4, np.float32), np.full(2, 1e-4, np.float32)

    def values() -> np.ndarray:
        slot = emb @ (soft[:, 1] - soft[:, 0])
        return np.add.reduceat(slot[flat], first[:-1]) / sizes

    def telling() -> np.ndarray:
        """How unevenly the documents of both classes hold each word's most telling n-gram: where the first passages lie."""
        held, n = np.zeros((2, 1 << bits)), np.bincount(y, minlength=2)
        for d, label in zip(docs, y):
            if len(d):
                held[label][np.unique(np.concatenate([flat[first[x] : first[x + 1]] for x in np.unique(d)]))] += 1
        share, mean = held / n[:, None], held.sum(0) / n.sum()
        z = (share[1] - share[0]) / np.sqrt(mean * (1 - mean) * (1 / n).sum() + 1e-6)
        return np.maximum.reduceat(z[flat], first[:-1])

    for turn in range(rounds):
        v = values() if turn else telling()
        spans = []
        for d, label in zip(docs, y):
            if not len(d):
                continue
            last = max(1, len(d) - window + 1)
            at = {int(_passage_logits(v[d], window).argmax())}
            at |= {int(rng.integers(0, last))} if not label else set()
            spans += [(d[a : a + window], label) for a in at]
        for _ in range(max(epochs, -(-least * 64 // max(1, len(spans))))):
            order = rng.permutation(len(spans))
            for lo in range(0, len(order), 64):
                batch = [spans[i] for i in order[lo : lo + 64]]
                n = np.array([len(d) for d, _ in batch])
                w = np.concatenate([d for d, _ in batch])
                row = np.repeat(np.arange(len(batch)), n)
                slot = np.concatenate([flat[first[x] : first[x + 1]] for x in w])
                srow = np.repeat(row, sizes[w])
                share = np.repeat(1 / (n[row] * sizes[w]), sizes[w]).astype(np.float32)
                bag = np.zeros((len(batch), dim), np.float32)
                for k in range(dim):
                    bag[:, k] = np.bincount(srow, emb[slot, k] * share, len(batch))
                z = bag @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), [label for _, label in batch]] -= 1
                p /= len(batch)
                d_bag, d_soft, d_bias = p @ soft.T, bag.T @ p, p.sum(0)
                g_soft += d_soft**2
                soft -= rate * d_soft / np.sqrt(g_soft)
                g_bias += d_bias**2
                bias -= rate * d_bias / np.sqrt(g_bias)
                used, inverse = np.unique(slot, return_inverse=True)
                step = np.stack([np.bincount(inverse, d_bag[srow, k] * share, len(used)) for k in range(dim)], 1).astype(np.float32)
                g_emb[used] += (step**2).mean(1)
                emb[used] -= rate * step / np.sqrt(g_emb[used])[:, None]
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits, window, lengths)


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int, keep: Column | None = None, max_chars: int = 50_000_000) -> DataFrame:
    """At most max_docs labelled documents of either class, by a hash of the id, and as many of them as have max_chars
    characters together; of an id's rows, the least text. Texts of more than a quarter of max_chars come last, so that none
    keeps others out, and a class with nothing else trains on its first one, whatever its length."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    marks = marks if keep is None else marks.where(keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marks.where(F.col("toxic") == c).orderBy(*order).limit(max_docs) for c in (0, 1)]
    some = F.broadcast(some[0].union(some[1]).distinct())  # at most 2 * max_docs rows
    rows = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chars = F.coalesce(F.length("text"), F.lit(0))
    turn = Window.partitionBy("toxic").orderBy(4 * chars > max_chars, *order)  # max_docs rows
    rows = rows.withColumns({"_chars": F.sum(chars).over(turn.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(turn)})
    return rows.where((F.col("_chars") <= max_chars) | (F.col("_place") == 1)).drop("_chars", "_place")


def fit_on(rows: DataFrame, **kwargs) -> Model:
    pdf = rows.toPandas().sort_values(["doc_id", "toxic", "text"], kind="stable")
    return fit(pdf["text"].tolist(), pdf["toxic"].tolist(), **kwargs)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold); columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2^bits numbers, whatever the input
    cols = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*cols).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        scorer = Scorer(Model(**shared.value))
        for b in batches:
            s = pa.array([scorer(t.as_py()) for t in b.column(cols.index(text))], pa.float64())
            p = pa.array(np.asarray(s) >= threshold).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, s, p], schema.names)

    return docs.select(*cols).mapInArrow(lean(run), schema)


#: Training documents of either class, at most.
MAX_DOCS = 3000


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def train(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: Column | None = None, max_docs: int = MAX_DOCS) -> Model:
    return fit_on(training_rows(docs, table(spark, sf_dir, "labels"), max_docs, keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(spark, docs, sf_dir, crc_mod("doc_id", 5) != 0)
    held = docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return score(held, model).select("doc_id", "held_out", "score", "predicted")

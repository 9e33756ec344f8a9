"""Mixing sources to target weights by the cube method.

Each source's target is its share of the mix, at most `cap` times what it holds (the excess goes to the others by
weight until none is above). A document of a source with ratio r = target / source size is taken floor(r) times and
once more with probability r - floor(r). The cube method draws those extra copies: a flight phase moves the fractional
probabilities of three documents at a time through the null space of two constraints (the number of documents and
their total size) until at most two of them stay fractional. Flights run first within blocks of at most about `block` documents of
one source, then over what the blocks left; only a small landing problem, a dozen documents a source, is rounded, to
the outcome nearest to the source's target. A source of any share of the rows is split over many blocks.

A null text has size 0; null sources are a source of their own, last in order. Rows with the same id, source and size
are one unit of the draw, of their number and size together. An empty table gives an empty result. Totals are
collected per source (one small row for each source, MAX_SOURCES at most; more is an error), nothing else is. Other
columns pass through, whatever their names; those named like the result's are replaced.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import n_words, table, written

_EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """The target of each source; weights repeat over the sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > cap * sizes[s] * total] if total else []
        if not over:
            return {s: out.get(s, left * weight[s] / total if total else 0.0) for s in order}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return {s: out[s] for s in order}


def flight(p: list[float], n: list[int], x: list[int], rng: random.Random) -> list[float]:
    """Moves the probabilities p of units (n rows and size x each) until at most two are fractional.

    Keeps sum(p * n) and sum(p * x): each step follows the null vector of those two constraints on three open units.
    """
    p, active, todo = list(p), [], iter(range(len(p)))
    while True:
        while len(active) < 3 and (k := next(todo, None)) is not None:
            if 0 < p[k] < 1:
                active.append(k)
        if len(active) < 2:
            return p
        a, b = active[0], active[1]
        u = []
        if len(active) == 3:
            c = active[2]
            u = [(a, n[b] * x[c] - n[c] * x[b]), (b, n[c] * x[a] - n[a] * x[c]), (c, n[a] * x[b] - n[b] * x[a])]
        if not any(v for _, v in u):  # three alike, or two left
            if n[a] * x[b] != n[b] * x[a]:
                return p
            u = [(a, n[b] or 1), (b, -n[a] or -1)]
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in u if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in u if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in u:
            q = p[k] + step * v
            p[k] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q
        active = [k for k in active if 0 < p[k] < 1]


def landing(p: list[float], n: list[int], x: list[int]) -> list[float]:
    """Rounds the last fractional units (a dozen at most) to the outcome whose size is nearest to what is due, then its rows."""
    rest, out = [k for k, v in enumerate(p) if 0 < v < 1], list(p)
    taken = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
    size, rows = (abs(taken @ np.array([v[k] for k in rest], float) - sum(p[k] * v[k] for k in rest)) for v in (x, n))
    best = np.lexsort((rows, size))[0]
    for k, v in zip(rest, taken[best].tolist()):
        out[k] = float(v)
    return out


#: Units that wait for the next level, or the landing, besides the two that a flight leaves; a block must be larger.
_WAIT = 10


def cube_sample(units: DataFrame, block: int = 2000, seed: int = 11) -> DataFrame:
    """units (_group, _p, _n, size, and an id _key) with _p moved to 0 or 1, balanced within each _group.

    A block leaves a dozen open units, so each level has about block / 12 times fewer; the last one lands.
    """
    schema, done, level, block = units.schema, [], 0, max(block, 4 * _WAIT)

    def run(last: bool):
        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_order", kind="stable").reset_index(drop=True)
            p, n, x = (pdf[c].tolist() for c in ("_p", "_n", "size"))
            rng, fly = random.Random(f"{seed} {level} {pdf['_group'].iloc[0]} {pdf['_order'].iloc[0]}"), max(0, len(p) - _WAIT)
            p = flight(p[:fly], n[:fly], x[:fly], rng) + p[fly:]
            return pdf.assign(_p=landing(p, n, x) if last else p)[schema.names]

        return settle

    while True:
        counts = units.groupBy("_group").agg(F.count("*").alias("_rows"))  # a row for each source
        last = (counts.agg(F.max("_rows")).first()[0] or 0) <= block
        dealt = units.withColumn("_order", F.xxhash64(F.lit(seed + level), "_key"))
        if last:
            done.append(dealt.groupBy("_group").applyInPandas(run(True), schema))
            break
        dealt = dealt.join(counts, "_group").withColumn("_block", F.pmod(F.xxhash64("_order"), F.ceil(F.col("_rows") / block).cast("long")))
        moved = written(dealt.groupBy("_group", "_block").applyInPandas(run(False), schema))
        done.append(moved.where("_p IN (0, 1)"))
        units, level = moved.where("_p NOT IN (0, 1)"), level + 1
    return reduce(DataFrame.union, done)


#: Columns that mix() adds.
RESULT = ("size", "source_size", "target", "copies", "taken")
#: Sources whose totals may come to the driver at once.
MAX_SOURCES = 1_000_000


def _planned(totals: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """A row (source, group, source_size, target, whole, p) for each source of totals (source, source_size)."""
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix their groups first")
    sizes = {r[0]: r[1] for r in rows}
    goal, out = targets(sizes, weights, share, cap), []
    for i, s in enumerate(goal):
        ratio = goal[s] / sizes[s] if sizes[s] else 0.0
        whole = int(ratio + _EPS)
        frac = ratio - whole
        out.append((s, i, sizes[s], goal[s], whole, frac if _EPS < frac < 1 - _EPS else 0.0))
    # As an Arrow table: rows of Python's would go through an RDD, whose workers executors start and keep beside the others.
    kinds = {"source": pa.string(), "group": pa.int32(), "source_size": pa.int64(), "target": pa.float64(), "whole": pa.int32(), "p": pa.float64()}
    columns = list(zip(*out)) or [()] * len(kinds)
    return totals.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, size: Column | None = None, block: int = 2000, seed: int = 11) -> DataFrame:
    """docs (doc_id, source) with size, source_size, target, copies (how often the mix takes the row) and taken (copies * size).

    Sizes are computed once, into a table of ids; texts are read again only for the result, by a join on the id, the source
    and a hash of the text (or the size given)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in RESULT]) if size is None else docs
    tag = F.xxhash64("text") if size is None else size
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT])
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), tag.cast("long").alias("tag"), (n_words(F.col("text")) if size is None else size).cast("long").alias("size"))
    kinds = written(rows.groupBy("id", "source", "tag").agg(F.count("*").alias("n"), F.first("size").alias("size")))
    totals = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = written(_planned(totals, weights, share, cap))
    # A row for each source: Spark broadcasts it as long as it is small, else it joins by a shuffle.
    units = kinds.alias("k").join(plan.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source"))).select("k.*", "group", "source_size", "target", "whole", "p")
    units = written(units)
    open_ = units.where("p > 0").select(F.col("group").alias("_group"), F.col("p").alias("_p"), (F.col("size") * F.col("n")).alias("size"), F.col("n").alias("_n"), F.struct("id", "tag").alias("_key"))
    drawn = written(cube_sample(open_, block, seed).where("_p = 1").select(F.col("_group").alias("g"), F.col("_key.id").alias("i"), F.col("_key.tag").alias("t")))
    taken = units.join(drawn, F.col("id").eqNullSafe(F.col("i")) & F.col("tag").eqNullSafe(F.col("t")) & (F.col("group") == F.col("g")), "left")
    taken = taken.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("tag").alias("t"), "size", "source_size", "target", (F.col("whole") + F.col("g").isNotNull().cast("int")).alias("copies"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & F.col("tag").eqNullSafe(F.col("t"))
    found = rows.select("row", "id", "source", "tag").join(taken, same)
    return found.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Production weights, by place of the source.
WEIGHTS = [3.0, 1.0, 2.0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("words")))
    return mix(sized, WEIGHTS, size=F.col("words")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))

"""Approximate nearest neighbours by inner product: adaptive dimension scan within probed lists.

Vectors get one more dimension, sqrt(M^2 - |x|^2) (M: the largest norm), under which the largest inner product is the
least Euclidean distance, and are turned by a random rotation. An inverted file deals them to lists (centroids fitted
on at most `sample` vectors; every vector is indexed). Within a probed list the rotated vectors are scanned in column
blocks: after d of D dimensions a candidate whose partial squared distance exceeds (d / D) (1 + eps / sqrt(d))^2 times
the query's current bound is abandoned, for by the hypothesis test its full distance exceeds the bound. A query's
nearest list is scanned first and yields the bound for its others. What survives is scored exactly, in double
precision on the original vectors.

How many lists to probe is calibrated on vectors of the sample that the centroids were not fitted on, for a recall of
`recall` against brute force there; a list has ten vectors of the sample at least. `exact` probes all lists and abandons
nothing early. Equal vectors are indexed once, with their k + 1 smallest ids, and searched once; that loses nothing, as
ties go to smaller ids. Distances that may differ by rounding alone are all kept until the exact score decides.
A list of any share of the vectors is split over tasks of at most about `rows` vectors and `rows` queries.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows without id. Of rows that repeat an id, the least vector counts. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, written


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


@dataclass
class Index:
    """What every task needs; its size is bounded by dimensions and lists, not by rows."""

    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the added dimension (0 for queries)."""
        x = x.astype(np.float64)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, extra]) @ self.rotation

    def nearest(self, lifted: np.ndarray, k: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * lifted @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :k]


def _nearest_centroid(y: np.ndarray, c: np.ndarray, block: int = 2048) -> np.ndarray:
    """The nearest centroid of each row, in blocks of rows so that no matrix of all rows by all centroids is held."""
    own = (c**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(own - 2 * y[a : a + block] @ c.T, axis=1) for a in range(0, len(y), block))])


def fit(x: np.ndarray, norm: float, lists: int, k: int, recall: float, seed: int = 3) -> Index:
    """Centroids by k-means over nine tenths of the sample x; probes so that queries drawn from the rest find `recall` of
    their k nearest in the whole sample."""
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.normal(size=(x.shape[1] + 1, x.shape[1] + 1)))
    index = Index(norm, rotation, np.zeros((0, 0)), 1)
    y = index.lift(x)
    mixed = rng.permutation(len(x))
    held, used = mixed[: len(x) // 10], mixed[len(x) // 10 :]
    c = y[rng.choice(used, min(lists, len(used)), replace=False)].astype(np.float64)
    for _ in range(6):
        near = _nearest_centroid(y[used], c)
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, y[used])
        c[n > 0] = total[n > 0] / n[n > 0, None]
    index.centroids = c
    near, some = _nearest_centroid(y, c), (held if len(held) >= 20 else mixed)[:200]
    scores = x[some].astype(np.float64) @ x.T.astype(np.float64)
    scores[np.arange(len(some)), some] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    order = index.nearest(index.lift(x[some], query=True), len(c))
    place = np.argsort(order, axis=1)
    ranks = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    index.probes = int(ranks[min(len(ranks) - 1, ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1
    return index


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, step: int = 16, eps: float = 2.1, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates and queries (their places) and squared distances of what no test abandons: for each query the k nearest
    and all that are within `slack` of the k-th, for distances so close may be equal but for rounding."""
    dims = x.shape[1]
    blocks = [(a, min(a + step, dims)) for a in range(0, dims, step)]
    a, b = blocks[0]
    part = (x[:, a:b] ** 2).sum(1)[:, None] + (q[:, a:b] ** 2).sum(1)[None, :] - 2 * x[:, a:b] @ q[:, a:b].T
    slack = np.broadcast_to(np.asarray(slack, float), (len(q),))
    i, j, d = None, None, None
    for n, (a, b) in enumerate(blocks):
        if n:
            diff = x[i, a:b] - q[j, a:b]
            d = d + np.einsum("ij,ij->i", diff, diff)
        limit = np.full(len(q), np.inf) if b < dims and np.isinf(eps) else bound * (b / dims) * (1 + (eps / np.sqrt(b) if b < dims else 1e-6)) ** 2 + slack + 1e-12
        if n == 0:
            i, j = np.nonzero(part <= limit[None, :])
            d = part[i, j]
        else:
            stays = d <= limit[j]
            i, j, d = i[stays], j[stays], d[stays]
    order = np.lexsort((d, j))
    i, j, d = i[order], j[order], d[order]
    first, last = np.searchsorted(j, np.arange(len(q))), np.searchsorted(j, np.arange(len(q)), "right")
    kth = np.full(len(q), np.inf)
    many = last - first >= k
    kth[many] = d[first[many] + k - 1]
    kept = d <= kth[j] + slack[j]
    return i[kept], j[kept], d[kept]


def _unique_id(v: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v)))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, recall: float = 0.98, rows: int = 4096, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, nearest first, ties to the smaller vec_id. With exact, all
    lists are probed and nothing is abandoned before its whole distance is known."""
    spark, result = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("query"))
    raw = raw.where("id IS NOT NULL AND v IS NOT NULL").where(fine).groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
    raw = written(raw.withColumn("uid", _unique_id(F.col("v"))))
    size = raw.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if size is None:
        return spark.createDataFrame([], result)
    raw = raw.where(F.size("v") == size["n"])
    # Equal vectors meet in two steps, the first over salts, so that a vector of very many rows is no task's load.
    salted = raw.groupBy("uid", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(F.first("v").alias("v"), F.max("query").alias("query"), F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    distinct = written(salted.groupBy("uid").agg(F.first("v").alias("v"), F.max("query").alias("query"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")))
    n, norm2 = distinct.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()
    # A list has ten vectors of the sample at least, so that it is a cell of the data and not one vector's surroundings.
    lists = max(1, min(sample // 10, round(n**0.5 / 2)))
    drawn = distinct.select("uid", "v").orderBy(F.xxhash64("uid"), "uid").limit(min(sample, n)).toPandas()
    index = fit(np.array(drawn["v"].tolist()), norm2**0.5, min(lists, len(drawn)), k, recall)
    index.probes = len(index.centroids) if exact else index.probes
    shared = spark.sparkContext.broadcast(vars(index))
    eps = float("inf") if exact else 2.1

    def deal(batches):
        index = Index(**shared.value)
        for b in batches:
            y = index.lift(_matrix(b.column(1)))
            near = index.nearest(y, 1)[:, 0].astype(np.int32) if len(y) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(list(y), pa.list_(pa.float64()))], ["uid", "v", "ids", "list", "y"])

    placed = written(distinct.select("uid", "v", "ids").mapInArrow(deal, "uid string, v array<double>, ids array<long>, list int, y array<double>"))

    def probe(batches):
        index = Index(**shared.value)
        for b in batches:
            x = _matrix(b.column(1))
            for a in range(0, len(x), 512):
                y = index.lift(x[a : a + 512], query=True)
                near = index.nearest(y, index.probes)
                at = np.repeat(np.arange(a, a + len(y)), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(y)))], ["uid", "list", "turn"])

    queries = distinct.where("query").select("uid", "v")
    probes = written(queries.mapInArrow(probe, "uid string, list int, turn int"))
    counts = {r[0]: r[1] for r in placed.groupBy("list").agg(F.count("*")).collect()}  # a row for each list

    def run(first: bool, bounds: DataFrame | None) -> DataFrame:
        turn = probes.where(F.col("turn") == 0 if first else F.col("turn") > 0)
        asked = {r[0]: r[1] for r in turn.groupBy("list").agg(F.count("*")).collect()}
        plan = [(c, ceil(m / rows), ceil(asked[c] / rows)) for c, m in counts.items() if c in asked]
        split = F.broadcast(spark.createDataFrame(plan, "list int, parts int, qparts int"))  # a row for each list
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        held = placed.join(split, "list").select("uid", "v", "ids", "list", "y", F.pmod(F.xxhash64("uid"), "parts").cast("int").alias("part"), each("qparts").alias("qpart"))
        turn = turn.join(split, "list").select("uid", "list", F.pmod(F.xxhash64("uid", F.lit(1)), "qparts").cast("int").alias("qpart"), each("parts").alias("part"))
        turn = turn.join(queries.withColumnRenamed("uid", "u"), F.col("uid") == F.col("u")).drop("u")
        turn = turn.withColumn("bound", F.lit(float("inf"))) if bounds is None else turn.join(bounds, "uid", "left").fillna({"bound": float("inf")})

        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if len(left) and len(right):
                index, x, y = Index(**shared.value), _matrix(left.column("v")), _matrix(left.column("y"))
                xq, bound = _matrix(right.column("v")), right.column("bound").to_numpy()
                least = pa.compute.list_element(left.column("ids"), 0).to_numpy()
                for a in range(0, len(xq), 256):
                    some = xq[a : a + 256]
                    slack = 1e-11 * (index.norm**2 + (some * some).sum(1))  # far above what rounding does to a distance
                    i, j, d = scan(y, index.lift(some, query=True), bound[a : a + 256], k + 1, eps=eps, slack=slack)
                    score = np.einsum("ij,ij->i", x[i], some[j])
                    order = np.lexsort((least[i], -score, j))  # equal scores: by the least id
                    i, j, d, score = i[order], j[order], d[order], score[order]
                    best = np.arange(len(j)) - np.searchsorted(j, j) <= k
                    out.append((i[best], a + j[best], d[best], score[best]))
            i, j, d, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0),) * 2
            return pa.table({"uid": right.column("uid").take(pa.array(j)), "ids": left.column("ids").take(pa.array(i)), "d": pa.array(d.astype(float)), "score": pa.array(score)})

        keys = ["list", "part", "qpart"]
        return written(held.groupBy(*keys).cogroup(turn.groupBy(*keys)).applyInArrow(task, "uid string, ids array<long>, d double, score double"))

    near = run(True, None)
    # The k-th least distance in the nearest list bounds what the other lists can add; equal vectors count each.
    ranked = near.groupBy("uid").agg(F.slice(F.array_sort(F.collect_list("d")), k + 1, 1).alias("kth"))  # k + 1 rows of a part
    bounds = ranked.select("uid", F.get("kth", F.lit(0)).alias("bound")).where("bound IS NOT NULL")
    found = near.union(run(False, bounds)) if shared.value["probes"] > 1 else near
    hits = found.select("uid", F.explode("ids").alias("vec_id"), "score")
    best = hits.groupBy("uid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))
    asked = raw.where("query").select(F.col("id").alias("query_id"), F.col("uid").alias("u"))
    answers = asked.join(best, F.col("u") == F.col("uid"))
    own = F.slice(F.filter("best", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)

"""Near copies: SimHash candidates of BK-trees, kept where the exact Jaccard similarity of the texts is 0.8 or more.

A text has a set of five-word shingles (64-bit hashes), by which it is judged, and `FAMILIES` 64-bit SimHash fingerprints,
by which it finds others. A fingerprint is made of a sample of `SAMPLE` shingles: those that come first in as many
random orders, the same for all texts. Two sets of similarity s have equal samples, and so equal fingerprints, with
probability s^4 in each family, wherever their texts differ: scattered, in one run, or by what was appended. Of 16 families
none agrees with probability (1 - s^4)^16, which is 0.0002 at 0.8 and less above. A SimHash of whole texts would do for scattered
differences only. Fingerprints meet in shards of agreeing bit blocks (see simhash) and there in BK-trees.

Pairs are found in two rounds. First each set is paired with the `NEAREST` found nearest, or with all within the
radius if they are no more; of these each set's best is compared, which joins most of a group. Then, where sets had
more than that within the radius, all pairs that lie in different components are found, subtrees of one component being
passed over; they are compared with what the first round left. Where a shard has very many such pairs (a group whose members
are almost similar), its sets are sent there instead and compared in place, so what is written and shuffled grows with
the rows of the shards and not with their pairs. No candidate is skipped, and every link is judged on whole sets, by the
upper 32 bits of their hashes.

Equal sets are one node, so copies cost nothing; texts without words are copies of each other. Rows whose id is null are
dropped. Null texts count as empty. Texts are read whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import packs as P
from foliant.llm.bktree import Forest
from foliant.llm.common import lean, partitions, removed, written
from foliant.llm.simhash import choices_of, components

SEED = 42
WIDTH = 5
#: Fingerprints: how many, of how many sampled shingles each, and the radius within which they meet.
FAMILIES, SAMPLE, RADIUS = 16, 4, 1
NEAREST = 2
#: Pairs across components for each row of a shard, above which the shard's sets are compared where they are.
DENSE = 1
_BLOCK = 1 << 12
#: A random order for each sampled shingle.
_ORDERS = P.mix(np.arange(1, FAMILIES * SAMPLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The XXH64 values of a text's distinct shingles, ascending; a text of fewer words is one shingle."""
    return _shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), width)


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.int64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends, hashed = ends[min(width, len(words)) - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n).view(np.int64))


def fingerprints(found: np.ndarray) -> np.ndarray:
    """The SimHash of each family's sample of a set of shingles: a bit is set where over half of the sample has it. Zeros
    without shingles."""
    if not len(found):
        return np.zeros(FAMILIES, np.uint64)
    h, first = found.view(np.uint64), np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _BLOCK):
        first = np.minimum(first, P.mix(h[at : at + _BLOCK, None] ^ _ORDERS[None, :]).min(0))
    bits = np.unpackbits(P.mix(first).view(np.uint8).reshape(FAMILIES, SAMPLE, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(1) > SAMPLE, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), node (a hash of the set), n, set and fps of each document."""

    def run(batches):
        for b in batches:
            found, fps = [], []
            for t in b.column(2):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                found.append(_shingles(words, WIDTH))
                fps.append(fingerprints(found[-1]))
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found), np.uint64, len(found)).view(np.int64)
            fps = np.concatenate([*fps, np.zeros(0, np.uint64)]).view(np.int64)
            packed = pa.array([(s >> 32).astype(np.uint32).tobytes() for s in found], pa.binary())
            del found
            cols = [b.column(0), b.column(1), pa.array(nodes), pa.array(sizes), packed, pa.FixedSizeListArray.from_arrays(pa.array(fps), FAMILIES).cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "node", "n", "set", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(lean(run), "doc_id long, key long, node long, n int, set binary, fps array<long>")


def dealt(nodes: DataFrame, count: int, shard_rows: int) -> tuple[DataFrame, list[int], int]:
    """Rows (key, tree, probe, choice, fp, node, n, part) of the shards, the bit masks of the choices, and how many tasks
    they are for. A shard of more than shard_rows rows is several trees, each probed by the rows of those before it."""
    masks = choices_of(RADIUS, count, 256)
    rows = nodes.select("node", "n", F.posexplode("fps").alias("family", "fp"))
    keys = [F.struct(F.lit(i).alias("choice"), F.xxhash64(F.col("family"), F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))).alias("key")) for i, m in enumerate(masks)]
    rows = rows.select("node", "n", "fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.choice", "fp", "node", "n")
    hot = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > shard_rows)
    trees = F.coalesce(F.ceil(F.col("rows") / shard_rows).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("trees")).cast("int")
    rows = (
        rows.join(hot, "key", "left").withColumn("trees", trees).withColumn("own", own)
        .select("key", "choice", "fp", "node", "n", "own", F.explode(F.sequence("own", F.col("trees") - 1)).alias("tree"))
        .select("key", "tree", (F.col("tree") != F.col("own")).alias("probe"), "choice", "fp", "node", "n", F.col("node").alias("part"))
    )
    return rows, masks, max(partitions(nodes.sparkSession), ceil(count * FAMILIES * len(masks) / 500_000))


_ROW = "key long, tree int, probe boolean, choice int, fp long, node long, n int, part long"
_FOUND = f"{_ROW}, other long, d int, full boolean"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


class _Shards:
    """The forest of a task's shards; equal fingerprints of a tree are one item."""

    def __init__(self, batches) -> None:
        held = [[np.asarray(c) for c in b.columns] for b in batches]
        cols = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, t) for t in (np.int64, np.int32, bool, np.int32, np.int64, np.int64, np.int32, np.int64)]
        order = np.lexsort((cols[5], cols[4], cols[2], cols[1], cols[0]))  # probes last in their tree
        self.order, self.cols = order, [c[order] for c in cols]
        key, tree, self.probe, self.choice, fp, self.node, self.n, self.part = self.cols
        self.fp = fp.view(np.uint64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])
        self.shard = np.cumsum(new) - 1
        own = np.flatnonzero(~self.probe)
        first = np.ones(len(own), bool)
        first[1:] = (self.shard[own][1:] != self.shard[own][:-1]) | (self.fp[own][1:] != self.fp[own][:-1])
        self.start = own[first]  # an item's rows are next to each other
        self.end = np.append(np.flatnonzero(first)[1:], len(own)) - np.flatnonzero(first) + self.start if len(own) else self.start
        # A tree without rows of its own has nothing to find; its probes get no tree.
        has, tree_of = np.unique(self.shard[self.start], return_inverse=True)
        place = np.searchsorted(has, self.shard)
        self.asked = np.flatnonzero((place < len(has)) & (has[np.minimum(place, len(has) - 1)] == self.shard)) if len(has) else np.zeros(0, np.int64)
        self.tree = place[self.asked]
        self.forest = Forest(tree_of, self.fp[self.start])
        self.crossed, self.used = np.zeros(int(self.shard[-1]) + 1 if len(key) else 0, np.int64), np.zeros(len(key), bool)
        self.size = np.bincount(self.shard, minlength=len(self.crossed))

    @property
    def sparse(self) -> np.ndarray:
        """Whether a shard has few pairs across components, as far as it is known."""
        return self.crossed <= DENSE * self.size

    def across(self, masks: np.ndarray):
        """Yields pairs of rows (x, y, d) within the radius that lie in different components, each pair once."""
        if not len(self.start):
            return
        part = np.unique(self.part, return_inverse=True)[1]  # small numbers, so that -1 can say "mixed"
        rows = np.concatenate([np.arange(a, b) for a, b in zip(self.start, self.end)])
        runs = np.concatenate([[0], np.cumsum(self.end - self.start)[:-1]])
        low, high = (f.reduceat(part[rows], runs) for f in (np.minimum, np.maximum))
        closed = self.forest.uniform(np.where(low == high, low, -1))
        for q, item, d in self.forest.within(self.tree, self.fp[self.asked], RADIUS, part[self.asked], closed):
            x, y, d = self.met(self.asked[q], item, d, masks)
            other = (part[x] != part[y]) & (self.probe[x] | (self.node[x] > self.node[y]))
            yield x[other], y[other], d[other]

    def met(self, x: np.ndarray, item: np.ndarray, d: np.ndarray, masks: np.ndarray, most: int | None = None):
        """Pairs of rows (x, y, d) of what was found: at most `most` rows of an item, none of the own set or of a size that
        rules similarity out, and only in the shard whose choice of blocks is the first in which the two agree."""
        n = self.end[item] - self.start[item]
        n = n if most is None else np.minimum(n, most + 1)
        ends = np.cumsum(n)
        y = np.repeat(self.start[item] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
        x, d = np.repeat(x, n), np.repeat(d, n)
        a, b = self.n[x].astype(np.int64), self.n[y].astype(np.int64)
        good = (self.node[x] != self.node[y]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
        x, y, d = x[good], y[good], d[good]
        diff, first = self.fp[x] ^ self.fp[y], np.ones(len(x), bool)
        for i, m in enumerate(masks[:-1]):
            first &= ((diff & m) != 0) | (self.choice[x] <= i)
        return x[first], y[first], d[first]


def _rows(shards: _Shards, x: np.ndarray, y: np.ndarray | None = None, d: np.ndarray | None = None, full: np.ndarray | None = None):
    """Batches of _FOUND: the rows x, and the sets of y that they are paired with."""
    for a in range(0, len(x), 1 << 16):
        s = slice(a, a + (1 << 16))
        n = len(x[s])
        more = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())] if y is None else [pa.array(shards.node[y[s]]), pa.array(d[s].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[x[s]]) for c in shards.cols), *more, pa.array(np.zeros(n, bool) if full is None else full[s])], _NAMES)


def nearest(rows: DataFrame, masks: list[int], n: int) -> DataFrame:
    """_FOUND: the pairs of the first round; and, without other, all rows of the shards that may hold more. Of such a full
    shard, where all pairs are looked for later, only each row's nearest is told."""
    bits = np.array(masks, np.uint64)

    def run(batches):
        s, held = _Shards(batches), []
        count, open_, more = np.zeros(len(s.node), np.int64), s.asked, np.zeros(len(s.node), bool)
        tree = np.zeros(len(s.node), np.int64)
        tree[s.asked] = s.tree
        for radius in (1, RADIUS):  # most of a group is found close by
            for q, item, d in s.forest.within(tree[open_], s.fp[open_], radius):
                # Items come in any order: the nearest first, so many of each, and of these so many of all.
                order = np.lexsort((item, d, q))
                more[open_[q[(s.end - s.start)[item] > NEAREST + 1]]] = True  # met() leaves rows of such an item out
                x, y, d = s.met(open_[q[order]], item[order], d[order], bits, NEAREST)
                start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(start, len(x)))
                place = np.arange(len(x)) - np.repeat(start, sizes)
                count[x[start]] = sizes
                keep = (place < NEAREST) & ((radius == RADIUS) | (count[x] >= NEAREST))
                held.append((x[keep], y[keep], d[keep], place[keep]))
                more[x[start]] |= sizes > NEAREST
            if radius < RADIUS:
                more[open_[count[open_] >= NEAREST]] = True
            open_ = open_[count[open_] < NEAREST]
        full = np.zeros(len(s.crossed), bool)
        full[s.shard[more]] = True
        for x, y, d, place in held:
            tell = (place == 0) | ~full[s.shard[x]]
            x = x[tell]
            yield from _rows(s, x, y[tell], d[tell], full[s.shard[x]])
        yield from _rows(s, np.flatnonzero(full[s.shard]))

    return rows.repartition(n, "key", "tree").mapInArrow(lean(run), _FOUND)


def across(rows: DataFrame, masks: list[int], n: int) -> DataFrame:
    """_FOUND: the pairs of a shard's rows within the radius that lie in different components (part). Of a shard with more
    than `DENSE` such pairs a row, the rows concerned instead, without other."""
    bits = np.array(masks, np.uint64)

    def run(batches):
        s, held = _Shards(batches), []
        for x, y, d in s.across(bits):
            held.append((x, y, d))
            s.crossed += np.bincount(s.shard[x], minlength=len(s.crossed))
            s.used[x] = s.used[y] = True
            held = [tuple(c[s.sparse[s.shard[h[0]]]] for c in h) for h in held]
        for h in held:
            yield from _rows(s, *h)
        yield from _rows(s, np.flatnonzero(s.used & ~s.sparse[s.shard]))

    return rows.repartition(n, "key", "tree").mapInArrow(lean(run), _FOUND)


def linked(rows: DataFrame, masks: list[int], n: int) -> DataFrame:
    """Links (a, b), a > b, between the rows (and set) of dense shards: pairs within the radius, in different components, of
    similarity 0.8 or more, as far as they join components. A task holds a tree's sets and some thousand probes."""
    bits = np.array(masks, np.uint64)

    def run(batches):
        for batch in _by_tree(batches):
            s = _Shards([batch.select(_NAMES[:8])])
            sets = [np.unique(np.frombuffer(v.as_buffer(), np.uint32)) for v in batch.column("set").take(pa.array(s.order))]
            ids, sizes = np.unique(np.concatenate(sets), return_inverse=True)[1], np.array([len(x) for x in sets])
            starts, flag = np.cumsum(sizes) - sizes, np.zeros(len(ids) + 1, bool)
            parts = np.unique(s.part, return_inverse=True)[1]
            out: list[tuple[int, int]] = []
            for x, y, _ in s.across(bits):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                for i, ys in zip(x[np.concatenate([[True], x[1:] != x[:-1]])].tolist(), np.split(y, np.flatnonzero(x[1:] != x[:-1]) + 1)):
                    ys = ys[parts[ys] != parts[i]]
                    if not len(ys):
                        continue
                    mine = ids[starts[i] : starts[i] + sizes[i]]
                    flag[mine] = True
                    own = np.repeat(starts[ys] - np.cumsum(sizes[ys]) + sizes[ys], sizes[ys]) + np.arange(sizes[ys].sum())
                    shared = np.add.reduceat(flag[ids[own]], np.cumsum(sizes[ys]) - sizes[ys], dtype=np.int64)
                    flag[mine] = False
                    for j in ys[9 * shared >= 4 * (sizes[i] + sizes[ys])].tolist():
                        if parts[j] != parts[i]:
                            out.append((int(s.node[i]), int(s.node[j])))
                            parts[parts == parts[j]] = parts[i]
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in out], pa.int64()), pa.array([min(p) for p in out], pa.int64())], ["a", "b"])

    return rows.repartition(n, "key", "tree").sortWithinPartitions("key", "tree", "probe").mapInArrow(lean(run), "a long, b long")


def _by_tree(batches, most: int = 4096):
    """The rows of each tree, with all its own and at most so many probes at once; rows come ordered by key, tree, probe."""
    own, rest = None, []

    def label(t: pa.Table, i: int) -> tuple:
        return t["key"][i].as_py(), t["tree"][i].as_py()

    def flush():
        nonlocal rest
        if rest:
            t = pa.concat_tables(rest)
            yield (pa.concat_tables([own, t]) if own is not None else t).combine_chunks()
            rest = []

    at = None
    for b in batches:
        t = pa.Table.from_batches([b])
        key, tree = np.asarray(b.column("key")), np.asarray(b.column("tree"))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (tree[1:] != tree[:-1])) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if label(t, lo) != at:
                yield from flush()
                at, own = label(t, lo), None
            rest.append(t.slice(lo, hi - lo))
            if sum(len(x) for x in rest) > 2 * most:
                held = pa.concat_tables(rest)
                probe = np.asarray(held["probe"].combine_chunks())
                if probe[-1]:  # all of the tree's own rows have come
                    yield from flush()
                    own = held.filter(pa.array(~probe)) if own is None else own
    yield from flush()


def _places(node) -> tuple:
    """Word and bit of a hash in a filter of 65,536 words."""
    ones = F.array(*(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    return F.pmod(node, F.lit(1 << 16)), F.element_at(ones, (F.pmod(F.shiftright(node, 16), F.lit(64)) + 1).cast("int"))


def filtered(rows: DataFrame, column: str, some: DataFrame) -> DataFrame:
    """rows with _may: whether the column's hash may be one of some's. The filter is broadcast: 65,536 rows at most."""
    word, bit = _places(F.col(f"`{column}`"))
    bits = some.select(F.col(some.columns[0]).alias(column)).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = rows.join(F.broadcast(bits), word == F.col("_word"), "left")
    return out.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def similar(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have similarity 0.8 or more."""
    used = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = filtered(found.select("node", "set"), "node", used).where("_may").drop("_may")
    own = own.join(used, "node", "left_semi").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.unique(np.frombuffer(v.as_buffer(), np.uint32)) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 9 * shared >= 4 * (len(x) + len(y))
            kept = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    a, b = (own.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set").mapInArrow(lean(run), "a long, b long")


def near_copies(docs: DataFrame, shard_rows: int = 4096) -> DataFrame:
    """doc_id, key, node and component (the same for all that links of similarity 0.8 or more join) of each document."""
    found = written(sets(docs))
    nodes = found.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fps").alias("fps"))
    nodes = written(nodes)
    rows, masks, n = dealt(nodes, nodes.count(), shard_rows)
    first = written(nearest(rows, masks, n))
    pairs = first.where("other IS NOT NULL").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"), "d", "full")
    pairs = written(pairs.groupBy("a", "b").agg(F.min("d").alias("d"), F.every("full").alias("full")))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("to"), "d").union(pairs.select("b", "a", "d"))
    best = ends.groupBy("node").agg(F.min(F.struct("d", "to")).alias("m")).select(F.greatest("node", "m.to").alias("a"), F.least("node", "m.to").alias("b"))
    best = written(best.distinct())
    near = written(similar(best, found))
    part = written(components(near))

    def parted(df: DataFrame, column: str, name: str) -> DataFrame:
        own = part.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
        return df.join(own, df[column] == own["_node"], "left").withColumn(name, F.coalesce("_part", column)).drop("_node", "_part")

    left = parted(parted(pairs.where("NOT full").select("a", "b"), "a", "pa"), "b", "pb").where("pa <> pb").select("a", "b")
    names = [f.split()[0] for f in _ROW.split(", ")]
    open_ = parted(first.where("other IS NULL").select(names).drop("part"), "node", "part")
    more = written(across(open_, masks, n))
    left = left.union(more.where("other IS NOT NULL").select(F.greatest("node", "other"), F.least("node", "other"))).distinct()
    left = written(left.join(best, ["a", "b"], "left_anti"))
    dense = written(more.where("other IS NULL").select(names))
    own = filtered(found.select(F.col("node").alias("_node"), "set"), "_node", dense.select("node")).where("_may").drop("_may")
    held = dense.join(own.dropDuplicates(["_node"]), F.col("node") == F.col("_node")).drop("_node")
    part = components(near.union(similar(left, found)).union(linked(held, masks, n)))
    out = written(found.select("doc_id", "key", "node").join(part, "node", "left").withColumn("component", F.coalesce("component", "node")))
    for used in (found, nodes, first, pairs, best, more, left, dense):
        removed(used)
    return out

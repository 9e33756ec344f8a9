"""The operators against brute force, exact round trips and held-out accuracy, and on nulls, empty, long and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import bktree, chat, common, mixing, neighbours, ngrams, packing, quality, queries, repeats, shingles, simhash, store, tokens, toxicity

SF = "/root/testdata/sf0.001"
SHORT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
SCHEMA = "doc_id long, text string, source string, lang string, size string, fp int, score string, bucket string"
ROWS = [
    (1, None, "a", None, "x", 1, None, "b"), (2, "", "a", "en", None, None, "s", None), (3, " \n\t ", None, "en", "x", 1, "s", "b"), (4, SHORT, "b", "en", "x", 1, "s", "b"),
    (5, SHORT, "b", None, "x", 1, "s", "b"), (5, SHORT, "b", None, "x", 1, "s", "b"), (None, SHORT, "c", "en", "x", 1, "s", "b"), (7, LONG, "c", "en", "x", 1, "s", "b"),
    (8, LONG[:1000] + " end", "c", "en", "x", 1, "s", "b"), (9, "É ß 日本 \x1f x<|im_end|>", "é", "en", "x", 1, "s", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())


# Quality rules


def test_quality_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = c.sql(quality.SQL).df().sort_values("doc_id").reset_index(drop=True)
    found = quality.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found.equals(sql[found.columns])
    assert not any(re.search("Python|Pandas|Arrow", str(x)) for x in [quality.query(spark, SF)._jdf.queryExecution().executedPlan()])


def test_quality_of_odd_rows(odd, none):
    got = quality.judge(odd).orderBy("doc_id").collect()
    assert len(got) == len(ROWS) and quality.judge(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].kept, by[3].n_words, by[7].n_words) == (0, False, 0, 60_000)
    assert by[9].word_chars == 16 and by[9].n_symbols == 4


def test_quality_keeps_labelled_documents(spark):
    m = quality.judge(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")).join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("quality", "kept", "n_words").toPandas()
    assert m[(m.quality == 1) & (m.n_words >= 10)].kept.mean() > 0.98 and not m[m.quality == 0].kept.any()


# Chat


def test_chat_round_trip(spark):
    random.seed(3)
    parts = ["<", "|", "<|im_end|>", "<|im_start|>", "\n", "\\n", "assistant", " x" * 300, "é", ""]
    rows = [(c, t, random.choice(["system", "user", "assistant", None, "a\n<|"]), random.choice([None, "".join(random.choices(parts, k=6))])) for c in range(30) for t in range(random.choice([1, 2, 9, 60]))]
    rows += [(99, None, "user", "first"), (99, 0, "assistant", "second"), (99, 0, "assistant", "second"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(common.written(chat.format_chats(df, budget=400))).collect()}
    held: dict = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        held.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == held.keys()
    for c, turns in held.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(said))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_windows_fit_the_budget(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind")] + [(1, t, "assistant" if t % 2 == 0 else "user", "x" * 100) for t in range(1, 40)], "conv_id long, turn long, role string, text string")
    wins = chat.format_chats(df, budget=200, history=2).orderBy("window").collect()
    assert len(wins) > 3
    for w in wins:
        turns = chat.parsed(w.text)
        assert turns[0][0] == "system" and sum(chat.n_tokens(r, t) for r, t, _, _ in turns) <= 200
        assert all(w.text[s.a : s.b] == "x" * 100 for s in w.loss)
    assert any(len(chat.parsed(w.text)) - 1 > w.n_new for w in wins[1:])
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# SimHash


def plain_fingerprint(t):
    w = words(t.lower() if t and t.isascii() else t)
    w = [x.lower() for x in words(t)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    ids, part = sorted(fps), {i: i for i in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_simhash_matches_brute_force(spark, docs, shard_rows):
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = simhash.near_duplicates(docs, shard_rows=shard_rows).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == components(fps, 4)


def test_links_of_random_fingerprints_are_all_found(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {}
    for i in range(400):
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.setdefault(x, i)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in fps.items()], "fp long, doc long")
    for radius, rows in ((4, 4096), (4, 8), (7, 64)):
        got = {r.node: r.component for r in simhash.components(simhash.links(nodes, radius, rows)).collect()}
        assert {i: got.get(i, i) for i in fps.values()} == components({i: x for x, i in fps.items()}, radius)


def test_simhash_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) - 1 and simhash.near_duplicates(none).count() == 0
    assert {r.doc_id: (r.fp, r.component_id) for r in got}[3] == (0, 1)
    assert {r.component_id for r in got if r.doc_id == 5} == {4}


def test_bk_tree():
    rng = random.Random(2)
    tree, keys = simhash.BKTree(), [rng.getrandbits(12) for _ in range(200)]
    for i, k in enumerate(keys):
        tree.add(k, i)
    for q in keys[:40]:
        assert sorted(tree.payload[n] for n in tree.within(q, 2)) == [i for i, k in enumerate(keys) if (k ^ q).bit_count() <= 2]


# Token files


def test_codes_are_directly_addressable():
    v = np.concatenate([np.random.default_rng(1).integers(0, 50_257, 3000), [0, 1, 255, 256, 65_535, 2**31]]).astype(np.uint32)
    r = tokens.Reader(tokens.pack(v, [3, 9], [3000, 6]))
    assert [r[i] for i in range(len(v))] == v.tolist()
    for a, b in ((0, len(v)), (0, 0), (511, 513), (512, 1024), (2999, 3006)):
        assert r.tokens(a, b).tolist() == v[a:b].tolist()
    assert tokens.Reader(tokens.pack(np.zeros(0, np.uint32), [], [])).n == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_matches_the_library(tokenizer):
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=50)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "ab", "é", "日本", "don't", "12a", ".", "!?", "x<|endoftext|>", "　", "\x1c", "ﬁ", "'s", "\r\n", "A.B", ",", "́"]
    for t in ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]:
        assert np.frombuffer(e(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_columns_encode_like_the_library(tokenizer):
    import public_tokenizers

    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "ab", "é", "日本", "don't", "12a", ".", "!?", ",;", "x<|endoftext|>", "　", "\x1c", "ﬁ", "'s", "\r\n", "A.B", "\x00", "́"]
    for keep in (0, 40, 5000):
        e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=keep)
        for _ in range(60):
            texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 30))]
            n, ids = e.column(pa.array(texts, pa.string()))
            want = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_a_token_is_read_from_disk_by_ranges(spark, docs, tokenizer):
    import public_tokenizers

    files = tokens.write(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=20_000).orderBy("part", "shard").collect()
    ids = [i for r in docs.orderBy("doc_id").collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]]
    at = 0
    for f in files:
        reads = []
        ranged = store.ranges(f.folder, f.name)
        reader = tokens.FileReader(lambda a, n: reads.append(n) or ranged(a, n))  # noqa: B023
        reads.clear()
        for i in (0, f.n_tokens // 2, f.n_tokens - 1):
            assert reader[i] == ids[at + i]
        assert sum(reads) < 3 * 200  # a chunk, a block of bits and a rank for each level, whatever the file's size
        at += f.n_tokens
    assert at == len(ids) and len(files) > 3


def test_token_files_round_trip(spark, docs, odd, none, tokenizer):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect() if r.doc_id is not None))
        got = sorted(tuple(r) for r in tokens.read(tokens.write(df, path, shard_tokens=5000)).collect())
        at, want = 0, []
        for i, t in rows:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == sorted(want)
    assert tokens.read(tokens.write(none, path)).count() == 0


# Substring dedup


def plain_repeats(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - width + 1):
            g = tuple(w[a : a + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark, docs, odd, none):
    rng = random.Random(4)
    made = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60)))) for i in range(120)]
    for df, width in ((docs, 13), (spark.createDataFrame(made, "doc_id long, text string").repartition(5), 5), (odd.where("doc_id IS NOT NULL"), 13)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        found = repeats.remove_repeats(df, width, bucket_words=200).collect()
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
        assert sorted(got) == plain_repeats(rows, width)
        for r in found:  # maximal spans: at least a window each, apart from each other
            assert sum(x.b - x.a for x in r.removed) == r.n_removed and all(x.b - x.a >= width for x in r.removed)
            assert all(x.b < y.a for x, y in zip(r.removed, r.removed[1:]))
    assert repeats.remove_repeats(none).count() == 0
    free = repeats.remove_repeats(odd).where("doc_id IS NULL").first()
    assert free.text == SHORT and free.n_removed == 0 and free.bucket == "b"


# Language model


def plain_model(texts):
    uni, bi = Counter(), Counter()
    for t in texts:
        w = [*(x.lower() for x in words(t)), b" end"]
        uni.update(w)
        bi.update(zip([b" start", *w[:-1]], w))
    low = Counter(w for _, w in bi)
    d, dl = (ngrams._discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in (bi, low))
    after, free = Counter(), Counter()
    for (v, _), c in bi.items():
        after[v] += c
        free[v] += d[min(c, 3) - 1]
    rest = sum(dl[min(c, 3) - 1] for c in low.values()) / max(1, len(bi)) if bi else 1.0

    def p(v, w):
        lower = (max(low[w] - dl[min(low[w], 3) - 1], 0) / len(bi) if low[w] else 0) + rest / (len(uni) + 1)
        if not after[v]:
            return lower
        c = bi[v, w]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / after[v] + free[v] / after[v] * lower

    return uni, p


def test_model_matches_a_plain_one(spark, docs, odd, none):
    for df in (docs, odd):
        train = df.where("doc_id % 3 <> 0")
        uni, p = plain_model([r.text for r in train.collect()])
        assert abs(sum(p(b" start", w) for w in uni) + p(b" start", b"un seen") - 1) < 1e-9
        n, v = sum(uni.values()), len(uni)
        for r in ngrams.score(df, ngrams.fit(train)).collect():
            w = [*(x.lower() for x in words(r.text)), b" end"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in uni for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
            assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip([b" start", *w[:-1]], w)), rel_tol=1e-9)
    blank = ngrams.score(odd, ngrams.fit(none)).collect()
    assert {(r.score, r.base_score, r.n_known) for r in blank} == {(0.0, 0.0, 0)}
    assert ngrams.score(none, ngrams.fit(docs)).count() == 0


# Packing


def check_bins(rows, units, capacity, per_source):
    sizes, seen = Counter(), Counter()
    for r in rows:
        sizes[r.bin_id] += r.n_tokens
        seen[r.doc_id, r.copy] += r.n_tokens
    assert max(sizes.values(), default=0) <= capacity
    assert sum(seen.values()) == sum(u.n_tokens for u in units)
    whole = {r.bin_id for r in rows if r.n_tokens == capacity}
    assert max(Counter((r.bin_id, r.source) for r in rows if r.bin_id not in whole).values(), default=0) <= per_source
    cluster = {u.doc_id: u.cluster for u in units}
    pairs = Counter((r.bin_id, cluster[r.doc_id]) for r in rows if cluster[r.doc_id] is not None and r.bin_id not in whole)
    assert max(pairs.values(), default=0) <= 1


@pytest.mark.parametrize("group", [8192, 50])
def test_bins_are_full_and_without_conflicts(docs, group):
    units = packing.units_of(docs)
    rows = packing.pack(units, 512, 2, group).collect()
    check_bins(rows, units.collect(), 512, 2)


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(6)
    n = 300
    sizes, sources, clusters = [rng.randint(1, 60) for _ in range(n)], [rng.randrange(4) for _ in range(n)], [rng.choice([-1, 0, 1, 2]) for _ in range(n)]
    got, bins = packing.best_fit(sizes, sources, clusters, 100, 2), []
    for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
        fit = [b for b in range(len(bins)) if bins[b][0] >= sizes[i] and (clusters[i] < 0 or clusters[i] not in bins[b][2]) and bins[b][1][sources[i]] < 2]
        b = min(fit, key=lambda b: (bins[b][0], b), default=len(bins))
        if b == len(bins):
            bins.append([100, Counter(), set()])
        bins[b][0] -= sizes[i]
        bins[b][1][sources[i]] += 1
        bins[b][2] |= {clusters[i]} - {-1}
        assert got[i] == b


def test_packing_of_odd_rows(odd, none):
    units = packing.units_of(odd)
    rows = packing.pack(units, 2048, 4).collect()
    check_bins(rows, units.collect(), 2048, 4)
    assert len({r.bin_id for r in rows if r.doc_id in (4, 5) or r.doc_id is None}) == 4
    assert packing.pack(packing.units_of(none)).count() == 0


# Mixing


def test_targets_share_the_excess():
    t = mixing.targets({"a": 10, "b": 100, "c": 100, None: 40}, [3, 1, 2])
    assert t["a"] == 20 and abs(sum(t.values()) - 375) < 1e-9 and all(t[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 100), ("c", 100), (None, 40)))
    assert mixing.targets({}, [1]) == {} and mixing.targets({"a": 0}, [1]) == {"a": 0.0}


def test_flight_keeps_both_totals():
    rng = random.Random(8)
    n, x = [1] * 500, [rng.randint(1, 900) for _ in range(500)]
    p = mixing.flight([0.37] * 500, n, x, rng)
    assert sum(0 < v < 1 for v in p) <= 2
    assert abs(sum(p) - 185) < 1e-6 and abs(sum(a * b for a, b in zip(p, x)) - 0.37 * sum(x)) < 1e-4


def test_mix_comes_near_its_targets(docs, odd, none):
    rows = mixing.mix(common.table(docs.sparkSession, "/root/testdata/sf0.01", "documents"), mixing.WEIGHTS, block=20).collect()
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target + 2
        assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in mine)
    again = mixing.mix(common.table(docs.sparkSession, "/root/testdata/sf0.01", "documents").repartition(7), mixing.WEIGHTS, block=20).collect()
    assert {r.doc_id: r.copies for r in rows} == {r.doc_id: r.copies for r in again}
    assert mixing.mix(odd, mixing.WEIGHTS).count() == len(ROWS) and mixing.mix(none, mixing.WEIGHTS).count() == 0


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").select("held_out", "predicted", "toxic").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.01


def test_toxicity_of_odd_rows(spark, odd, none):
    model = toxicity.fit(["you utter fool", "what a fool you are", "a fine day", None, "good and kind words here"] * 20, [1, 1, 0, 0, 0] * 20)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, model).count() == 0
    scorer = toxicity.Scorer(model)
    assert scorer("what a fooool") > scorer("what a floor") > 0 and scorer("you fool") > 0.5 > scorer("a kind day")
    assert toxicity.Scorer(toxicity.fit([], []))("x") == 0.0 and toxicity.Scorer(toxicity.fit(["a"], [1]))(None) == 1.0


# Neighbours


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:1000] = x[700]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [1.0]), (None, rows[0][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, rows=100).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == set(range(0, 1500, 20))
    recall = []
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id], rtol=1e-12)
        recall.append(len(set(best) & set(g.vec_id)) / 20)
    assert np.mean(recall) >= 0.9
    assert got[got.query_id == 720].vec_id.tolist() == list(range(700, 720)) or got[got.query_id == 720].score.min() > x[700] @ x[700] - 1e-9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(df.where("vec_id IN (0, 1, 20)"), F.col("vec_id") % 20 == 0).count() == 4


def test_scan_abandons_without_losing_the_nearest():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(800, 64)), rng.normal(size=(20, 64))
    d = ((x[:, None, :] - q[None]) ** 2).sum(2)
    bound = np.sort(d, axis=0)[9]
    i, j, got = neighbours.scan(x, q, bound, 10)
    assert np.allclose(got, d[i, j])
    assert np.mean([len(set(np.argsort(d[:, k])[:10]) & set(i[j == k])) / 10 for k in range(20)]) > 0.95


def test_distinct_vectors_of_equal_scores_come_by_id(spark):
    """More distinct vectors of one inner product than are asked for: the least ids, whatever rounding makes of distances."""
    rng = np.random.default_rng(12)
    base = np.array([1.0, 2, 3, 5, 7, 9, 11, 13])
    seen, rows = set(), []
    while len(rows) < 300:
        v = tuple(rng.permutation(base))
        if v not in seen:
            seen.add(v)
            rows.append((len(rows) + 1, [float(c) for c in v]))
    rows.append((0, [1.0] * 8))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for kw in ({}, {"rows": 20}, {"exact": True}):
        got = neighbours.search(df, F.col("vec_id") == 0, k=5, **kw).orderBy("rank").collect()
        assert {r.score for r in got} == {float(base.sum())}
        if kw.get("exact"):
            assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(400, 12)), 1) + 0.05
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, exact=True).toPandas().sort_values(["query_id", "rank"])
    for q, g in got.groupby("query_id"):
        s = np.einsum("ij,j->i", x, x[q])
        s[q] = -np.inf
        assert np.allclose(g.score, np.sort(s)[::-1][:10], rtol=1e-12) and (np.diff(g.score) <= 0).all()


# The registered queries


@pytest.fixture(scope="module")
def small_texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def test_chat_query(spark):
    held: dict = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(common.table(spark, SF, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        held.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.QUERIES["op2_chat_windows"](spark, SF).collect()}
    assert got.keys() == held.keys()
    for c, turns in held.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars >= sum(len(chat.formatted(*t)) for t in turns)


def test_large_system_turns_are_not_repeated(spark):
    rows = [(1, 0, "system", "s" * 100_000)] + [(1, t, "assistant" if t % 2 else "user", "x" * 100) for t in range(1, 51)]
    wins = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert sum(len(w.text) for w in wins) < 120_000 and chat.parsed(wins[0].text)[0][0] == "system"
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert (got.n_turns, got.loss_chars) == (51, 2500)


def test_simhash_query(spark, small_texts):
    fps = {i: plain_fingerprint(t) for i, t in small_texts.items()}
    part = components(fps, 4)
    got = queries.QUERIES["op3_simhash_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", part[i]) for i, f in fps.items())


def test_token_query(spark, small_texts, tokenizer):
    at, want = 0, []
    for i, t in sorted(small_texts.items()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op4_token_files"](spark, SF).collect()) == want


def test_repeats_query(spark, small_texts):
    got = queries.QUERIES["op5_substring_dedup"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == plain_repeats(list(small_texts.items()), 13)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(c.sql(queries.ORACLE_SQL["op5_substring_dedup"]).fetchall()) == sorted(tuple(r) for r in got)


def test_model_query(spark, small_texts):
    uni, p = plain_model([t for i, t in small_texts.items() if crc(i) % 7 != 2])
    n, v = sum(uni.values()), len(uni)
    got = queries.QUERIES["op6_lm_scoring"](spark, SF).collect()
    assert len(got) == len(small_texts)
    for r in got:
        w = [*(x.lower() for x in words(small_texts[r.doc_id])), b" end"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(w), sum(x in uni for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def test_packing_query(spark, docs, tokenizer):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    units = packing.token_units(docs, path)
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in units.collect()} == {i: len(x) for i, x in want.items()}
    rows = queries.QUERIES["op7_best_fit_packing"](spark, SF).collect()
    check_bins(rows, units.collect(), 2048, 4)
    fill = Counter()
    for r in rows:
        fill[r.bin_id] += r.n_tokens
    assert sum(fill.values()) / (2048 * len(fill)) > 0.95
    got = packing.sequences(packing.pack(units), docs, path).collect()
    assert {r.bin_id: len(r.ids) for r in got} == fill
    spread = {}
    for r in got:
        assert [(x.a, x.b) for x in r.documents][0][0] == 0 and all(x.b == y.a for x, y in zip(r.documents, r.documents[1:]))
        for x in r.documents:
            spread.setdefault(x.doc_id, []).append(r.ids[x.a : x.b])
    assert {i: sum(map(len, x)) for i, x in spread.items()} == {i: len(x) for i, x in want.items()}
    assert all(sorted(t for piece in x for t in piece) == sorted(want[i]) for i, x in spread.items())


def test_token_packing_of_odd_rows(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    units = packing.token_units(odd, path)
    check_bins(packing.pack(units, 2048, 4).collect(), units.collect(), 2048, 4)
    got = packing.sequences(packing.pack(units), odd, path).collect()
    assert sum(len(r.ids) for r in got) == sum(r.n_tokens for r in units.collect()) and packing.sequences(packing.pack(packing.token_units(none, path)), none, path).count() == 0


def test_mixing_query(spark, docs, small_texts):
    sizes = {i: len(words(t)) for i, t in small_texts.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    held = Counter()
    for i, n in sizes.items():
        held[source[i]] += n
    goal = mixing.targets(dict(held), [3.0, 1.0, 2.0])
    got = queries.QUERIES["op8_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(sizes)
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size, r.taken % max(1, r.size), r.taken <= 2 * r.size) == (sizes[r.doc_id], held[source[r.doc_id]], 0, True)
        assert math.isclose(r.target, goal[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= max(sizes[i] for i in sizes if source[i] == s) for s, t in goal.items())


def test_neighbours_query(spark):
    rows = {r.vec_id: r.embedding for r in common.table(spark, SF, "embeddings").collect()}
    ids = np.array([i for i, v in rows.items() if v is not None and all(e is not None and math.isfinite(e) for e in v) and any(v)])
    x = np.array([rows[i] for i in ids.tolist()], np.float64)
    got = queries.QUERIES["op10_neighbours"](spark, SF).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == {i for i in ids.tolist() if i % 20 == 0}
    recall = []
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        others = ids != q
        best = ids[others][np.lexsort((ids[others], -s[others]))[:20]]
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)] if (np.diff(ids) > 0).all() else g.score, rtol=1e-12)
        recall.append(len(set(best) & set(g.vec_id)) / 20)
    assert np.mean(recall) >= 0.9


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(50)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 10).count() == 20
    assert toxicity.training_rows(docs, labels, 1000).count() == 50
    assert toxicity.training_rows(docs, labels, 1000, max_chars=50).groupBy("toxic").count().where("count <= 5").count() == 2


def test_columns_of_any_name_pass_the_mix_and_the_stages(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{text} {i}", "en", "a", 9, *["own"] * 18) for i in range(6)]
    names = ["_source", "_whole", "_p", "_id", "_size", "_n", "_key", "_group", "size", "source_size", "target", "copies", "taken", "score", "predicted", "n_words", "n_removed", "kept_sha256"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    mixed = mixing.mix(docs, mixing.WEIGHTS)
    assert mixed.count() == 6 and {r._source for r in mixed.collect()} == {"own"} and set(mixing.RESULT) <= set(mixed.columns)
    for stage in (P.drop_near_copies, P.cut_passages, P.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r[n] == "own" for r in out.collect() for n in names)


# Pipeline


def test_queries_are_registered():
    names = list(queries.QUERIES)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.01"
    docs = common.table(spark, d, "documents")
    labels = {r.doc_id: r.toxic for r in common.table(spark, d, "labels").collect()}
    held = [docs]
    for _, stage in P.STAGES:
        held.append(common.written(stage(spark, held[-1], d)))
    texts = [{r.doc_id: r.text for r in x.collect()} for x in held[:4]]
    assert all(x.columns == docs.columns for x in held[:-1])
    gone = set(texts[0]) - set(texts[1])
    assert sum(labels.get(i, 0) for i in gone) > 0.85 * sum(labels.values()) and sum(labels.get(i) == 0 for i in gone) <= 0.01 * len(labels)
    alone = jaccard_least(texts[1])
    lost, spared = alone - set(texts[2]), set(texts[2]) - alone
    assert not lost and len(spared) <= 0.05 * (len(texts[1]) - len(alone))
    want = {i: h for i, n, r, h in plain_repeats(sorted(texts[2].items()), P.PASSAGE) if not r or r < n}
    assert {i: hashlib.sha256(b" ".join(words(t))).hexdigest() for i, t in texts[3].items()} == want
    size = lambda t: len(words(t))
    totals, taken = Counter(), Counter()
    for r in held[3].collect():
        totals[r.source] += size(r.text)
    for r in held[4].collect():
        taken[r.source] += size(r.text)
    for s, t in mixing.targets(dict(totals), mixing.WEIGHTS).items():
        assert abs(taken[s] - t) <= 0.02 * t + 5
    assert Counter(r.doc_id for r in held[4].select("doc_id").collect()).most_common(1)[0][1] <= 2
    units = packing.token_units(held[4], P.TOKENIZER)
    check_bins(held[5].collect(), units.collect(), 2048, 4)


def five_word_sets(texts):
    held = {}
    for i, t in texts.items():
        w = [x.lower() for x in words(t)]
        held[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return held


def jaccard_least(texts):
    """The ids that are the least of their component under the similarity of all pairs, by brute force."""
    held = five_word_sets(texts)
    ids, least = sorted(held), {i: i for i in held}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i for i in ids if root(i) == i}


def test_near_dedup_against_all_pairs(spark):
    """Nothing but near copies goes; candidates come from fingerprints, so a copy may stay."""
    import corpus_pipeline as P

    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    alone, kept = jaccard_least(texts), {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()}
    assert alone <= kept and len(kept - alone) <= 0.02 * (len(texts) - len(alone))


def test_bk_forest_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    for bits, radius in ((12, 2), (64, 5), (64, 26)):
        keys = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) >> np.uint64(63 - bits if bits < 63 else 0)
        both = np.unique(np.stack([rng.integers(0, 20, 1500).astype(np.uint64), keys], 1), axis=0)
        trees, keys = np.unique(both[:, 0], return_inverse=True)[1], both[:, 1]
        order = np.argsort(trees, kind="stable")
        trees, keys, part = trees[order], keys[order], rng.integers(0, 3, len(keys))
        forest = bktree.Forest(trees, keys)
        near = (np.bitwise_count(keys[:, None] ^ keys[None]) <= radius) & (trees[:, None] == trees[None])
        got = [(q, i) for x in forest.within(trees, keys, radius) for q, i in zip(x[0].tolist(), x[1].tolist())]
        assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(near))))
        apart = {(q, i) for x in forest.within(trees, keys, radius, part, forest.uniform(part)) for q, i in zip(x[0].tolist(), x[1].tolist()) if part[q] != part[i]}
        assert apart == {(q, i) for q, i in got if part[q] != part[i]}


@pytest.mark.parametrize("dense", [0, 10**9])
def test_near_copies_of_a_group_almost_alike(spark, monkeypatch, dense):
    """A large group whose members are near their base but not each other: the same classes by pairs and in dense shards."""
    monkeypatch.setattr(shingles, "DENSE", dense)
    rng = random.Random(7)
    base, texts = [f"w{i}" for i in range(300)], {}
    for i in range(120):
        out = list(base)
        for k in rng.sample(range(300), rng.choice([2, 5, 9])):
            out[k] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(out)
    texts[200] = " ".join(base)
    got = shingles.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), shard_rows=50)
    classes = Counter(r.component for r in got.collect())
    assert len(classes) == len(jaccard_least(texts)) > 1


def test_near_dedup_of_one_text_varied(spark):
    import corpus_pipeline as P

    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join("x" if k == i * 9 else w for k, w in enumerate(base))) for i in range(1, 11)]  # similarity 86 / 106 or more
    rows += [(20 + i, " ".join("y" if k % 25 == i else w for k, w in enumerate(base))) for i in range(1, 4)]  # texts are near, sets are not
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == [1, 21, 22, 23]
    sets = five_word_sets(dict(rows))
    assert {r.node for r in shingles.sets(docs).collect()} == {xxhash.xxh64_intdigest(shingles.shingles(t).tobytes(), 42) - (1 << 64 if xxhash.xxh64_intdigest(shingles.shingles(t).tobytes(), 42) >> 63 else 0) for _, t in rows}
    assert all(len(shingles.shingles(t)) == len(sets[i]) for i, t in rows)


def test_near_dedup_of_repeated_ids(spark):
    import corpus_pipeline as P

    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, one, "s"), (1, two, "s"), (1, one, "r"), (2, two, "s"), (None, one, "s"), (None, one, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert sorted(map(tuple, P.drop_near_copies(spark, docs, "").collect()), key=str) == sorted([(1, one, "r"), (1, two, "s"), (None, one, "s"), (None, one, "s")], key=str)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, t, "en", s, len(t or "")) for i, t, s, *_ in ROWS]
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert (P.run(spark, str(tmp_path / name)).count() > 0) == bool(some)

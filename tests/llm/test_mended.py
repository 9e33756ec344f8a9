"""Near copies however their edits lie, odd column names in the pipeline, and bounds that drop nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import chat, common, ngrams, packing, quality, shingles, toxicity

VARIED = ("scattered", "replaced run", "appended", "prepended", "removed run")


def varied(words, kind, rng, share):
    """A copy of the words with about that share of them changed."""
    n = len(words)
    m = max(1, int(n * share))
    new = [f"new{rng.randrange(10**6)}" for _ in range(m)]
    at = rng.randrange(0, n - m)
    if kind == "scattered":
        out = list(words)
        for k in rng.sample(range(n), max(1, m // 6)):
            out[k] = f"new{rng.randrange(10**6)}"
        return out
    return {"replaced run": words[:at] + new[: m // 2] + words[at + m // 2 :], "appended": words + new, "prepended": new + words, "removed run": words[:at] + words[at + m :]}[kind]


def similarity(x, y):
    a, b = (set(shingles.shingles(" ".join(w)).tolist()) for w in (x, y))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def pairs(spark):
    """Texts of 40 to 3000 words with copies of similarity 0.8 or more, many just above it."""
    rng, out = random.Random(9), []
    texts = [r.text.split() for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect() if r.text]
    texts = [t for t in texts if 40 <= len(t) <= 3000]
    for kind in VARIED:
        made = 0
        while made < 60:
            base = rng.sample(texts, 1)[0]
            base = [w if rng.random() < 0.6 else f"own{rng.randrange(10**7)}" for w in base]  # no text is near another pair's
            copy = varied(base, kind, rng, rng.uniform(0.08, 0.24))
            if 0.8 <= similarity(base, copy) < 0.9:
                out.append((kind, base, copy))
                made += 1
    return out


def test_fingerprints_meet_however_edits_lie(pairs):
    for kind in VARIED:
        met = [(np.bitwise_count(shingles.fingerprints(shingles.shingles(" ".join(a))) ^ shingles.fingerprints(shingles.shingles(" ".join(b)))) <= shingles.RADIUS).any() for k, a, b in pairs if k == kind]
        assert np.mean(met) >= 0.98, kind
    assert not shingles.fingerprints(np.zeros(0, np.int64)).any()


def test_stage_drops_copies_however_edits_lie(spark, pairs):
    rows = [(2 * i + j, " ".join(t)) for i, (_, a, b) in enumerate(pairs) for j, t in enumerate((a, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in P.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    for kind in VARIED:
        mine = [2 * i + 1 for i, (k, *_) in enumerate(pairs) if k == kind]
        assert sum(i in kept for i in mine) <= 0.05 * len(mine), kind


def test_pipeline_takes_columns_of_any_name_and_kind(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i % 9, f"{text} {i % 5}" if i % 2 else f"other {i} {text[: 40 + i]}", "en", f"s{i % 2}", 9, "own", {"k": i}, "tick") for i in range(20)] + [(None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, m map<string,int>, `x``y z` string"
    docs = spark.createDataFrame(rows, schema)
    (tmp_path / "labels.parquet").mkdir()
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = common.written(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r["a.b"] in ("own", None) and r["x`y z"] in ("tick", None) and (r["m"] is None or "k" in r["m"])
    assert set(P.STAGES[-1][1](spark, docs, "").columns) >= {"bin_id", "doc_id", "ids"}


def test_last_stage_gives_the_tokens(spark):
    from tokenizers import Tokenizer

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    tokenizer = Tokenizer.from_file(P.TOKENIZER)
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = P.pack_bins(spark, docs, "").orderBy("doc_id", "piece").collect()
    got, fill = {}, {}
    for r in pieces:
        assert len(r.ids) == r.n_tokens
        got.setdefault(r.doc_id, []).extend(r.ids)
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert got == want and max(fill.values()) <= 2048 and sum(fill.values()) / (2048 * len(fill)) > 0.95
    assert packing.placed(packing.pack(packing.token_units(docs.limit(0), P.TOKENIZER)), docs.limit(0), P.TOKENIZER).count() == 0


@pytest.mark.parametrize("share", [None, 0.5])
def test_long_system_turns_stay_or_go_as_asked(spark, share):
    long = "rule " * 200
    rows = [(1, 0, "system", long)] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t}") for t in range(1, 30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat.format_chats(df, budget=200, history=2, system_share=share).orderBy("window").collect()
    first = [chat.parsed(w.text)[0][0] for w in wins]
    assert (set(first) == {"system"}) == (share is None) and first[0] == "system"
    back = chat.read_back(chat.format_chats(df, budget=200, history=2, system_share=share)).first()
    said = "".join(x for _, _, r, x in rows if r == "assistant")
    assert (back.n_turns, back.loss_chars) == (30, len(said))


def test_rules_leave_columns_of_their_own_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", "too")], "doc_id long, text string, _words string, _lines string")
    got = quality.judge(docs).first()
    assert (got._words, got._lines, got.n_words) == ("mine", "too", 3)


def test_a_long_text_empties_no_class(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(10)] + [(i, "y" * 10) for i in range(10, 20)] + [(i, "z" * (9000 if i % 3 else 10)) for i in range(20, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(10 <= i < 20)) for i in range(40)], "doc_id long, toxic int")
    kept = {c: sorted(len(r.text) for r in toxicity.training_rows(docs, labels, 100, max_chars=500).where(F.col("toxic") == c).collect()) for c in (0, 1)}
    assert kept == {0: [10] * 7, 1: [10] * 10}
    alone = toxicity.training_rows(docs.where("doc_id < 20"), labels, 100, max_chars=500)
    assert {r.toxic: r["count"] for r in alone.groupBy("toxic").count().collect()} == {0: 1, 1: 10}


def test_runs_own_what_they_write(spark):
    """Two operators at once: the sweep of one leaves the other's tables, and no table stays in the catalog."""
    import threading

    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    tables, ready, swept, out = {t.name for t in spark.catalog.listTables()}, threading.Event(), threading.Event(), {}

    def other():
        with common.scope() as mine:
            held = common.written(docs.limit(7))
            ready.set()
            swept.wait(60)
            out["rows"], out["folders"] = held.count(), len(mine.folders)
            mine.sweep(spark)

    thread = threading.Thread(target=other)
    with common.scope() as mine:
        thread.start()
        ready.wait(60)
        from foliant.llm import repeats

        result = common.written(repeats.remove_repeats(docs))
        assert len(mine.tables) == 1 and len(mine.folders) > 2
        mine.sweep(spark, keep=result)
        swept.set()
        thread.join()
        assert result.count() == docs.count() and len(mine.folders) == 1
        mine.sweep(spark)
    assert out == {"rows": 7, "folders": 1} and {t.name for t in spark.catalog.listTables()} == tables and not mine.folders


@pytest.mark.parametrize("relay", [1, 64_000_000])
def test_relays_change_no_count(spark, monkeypatch, relay):
    """The model by one level of buckets, and by as many levels as buckets have bits."""
    monkeypatch.setattr(ngrams, "_RELAY", relay)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").repartition(5)
    one, many = ngrams.fit(docs), ngrams.fit(docs, fan=1)
    kept = ("bits", "d", "d_low", "types", "vocabulary", "tokens", "free_low")
    assert one["bits"] >= 3 and {k: one[k] for k in kept} == {k: many[k] for k in kept} and one["pairs"].keys() == many["pairs"].keys()
    a, b = (sorted(map(tuple, ngrams.score(docs, m).drop("text").collect())) for m in (one, many))
    assert a == b


def test_senders_tell_few_buckets_apart(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("text").repartition(4)
    sent = ngrams._count(docs, "text", 2)
    assert sent.where("bucket >= 4").count() == 0
    fine = ngrams._routed(sent, ngrams._added_pairs, 6, 4, 2)
    assert fine.select("bucket").distinct().count() == 64 and fine.count() <= 4 * 64


def test_counts_beyond_32_bits_are_kept():
    big, small = np.array([1, 1 << 40]), np.array([1, 2])
    assert ngrams._narrow(big).dtype == np.int64 and ngrams._narrow(small).dtype == np.uint32

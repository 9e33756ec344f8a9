"""Streams with state: silent jobs, log tails, a catalog kept up to date, progress of one's own runs."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import facets as FA
from foliant.sources.adapters import catalog
from foliant.streaming import callbacks, logs, progress, state, watch

SF = "/root/testdata/sf0.001"
BEATS = "job long, stage string, at timestamp, seq long, threshold_sec long"
TOLD = "job long, stage string, at timestamp, threshold_sec long, event string, told_at timestamp"
NOON = datetime(2025, 1, 1, 12, tzinfo=timezone.utc)


def at(sec):
    return NOON + timedelta(seconds=sec)


class Beats:
    """A stream of beats, a file a round, that stops and starts again with each."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.round = spark, folder, options, 0
        self.out = f"{folder}/out"

    def send(self, *rows):
        self.spark.createDataFrame(list(rows), BEATS).coalesce(1).write.parquet(f"{self.folder}/in/r={self.round}")
        self.round += 1
        stream = self.spark.readStream.schema(BEATS).parquet(f"{self.folder}/in/r=*")
        state.maintain(watch.alerts(stream, **self.options), self.out, f"{self.folder}/checkpoint", "append").awaitTermination()
        return sorted((r.job, r.event, r.told_at.replace(tzinfo=timezone.utc)) for r in state.history(self.spark, self.out, TOLD).collect())


def test_silence_raises_one_row_without_further_input(spark, tmp_path):
    b = Beats(spark, str(tmp_path), late="10 seconds")
    assert b.send((1, "translation", at(0), 0, 60), (2, "translation", at(0), 0, 600), (3, "complete", at(0), 0, 60)) == []
    assert b.send((2, "translation", at(70), 1, 600)) == []  # the watermark is at 60: not longer than the threshold yet
    assert b.send((2, "korean_pdf", at(71), 2, 600)) == [(1, "silent", at(61))]  # at 61, though job 1 sent nothing, after two restarts
    assert b.send((2, "korean_pdf", at(300), 3, 600)) == [(1, "silent", at(61))]  # once only
    assert b.send((1, "korean_pdf", at(310), 1, 60)) == [(1, "resumed", at(310)), (1, "silent", at(61))]
    last = b.send((2, "complete", at(400), 4, 600))
    assert last == [(1, "resumed", at(310)), (1, "silent", at(61)), (1, "silent", at(371))]
    now = watch.suspected(state.history(spark, b.out, TOLD)).collect()
    assert [(r.job, r.stage) for r in now] == [(1, "korean_pdf")]


def test_alerts_end_as_the_batch_rule(spark, tmp_path):
    random.seed(5)
    rows = [(j, random.choice(["translation", "korean_pdf", "complete"]), at(random.randrange(5000)), i, 60 * (j % 7 + 1)) for i in range(600) for j in [random.randrange(60)]]
    rows.sort(key=lambda r: r[2])
    b = Beats(spark, str(tmp_path), late="0 seconds")
    for a in range(0, 600, 200):
        b.send(*rows[a : a + 200])
    got = {r.job for r in watch.suspected(state.history(spark, b.out, TOLD)).collect()}
    beats = spark.createDataFrame(rows, BEATS)
    thresholds = beats.select("job", "threshold_sec").distinct()
    want = {r.job for r in progress.hung(beats, thresholds, str(rows[-1][2].replace(tzinfo=None)), "complete").where("hung_suspected").collect()}
    assert got == want and 10 < len(want) < 60


def test_silence_by_the_processing_clock(spark, tmp_path):
    now = datetime.now(timezone.utc)
    spark.createDataFrame([(1, "translation", now, 0, 1), (2, "complete", now, 0, 1), (None, "x", now, 0, 1), (3, "x", None, 0, 1), (4, "x", now, None, None)], BEATS).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    q = state.maintain(watch.alerts(spark.readStream.schema(BEATS).parquet(f"{tmp_path}/in"), clock="processing"), out, f"{tmp_path}/c", "append", processingTime="1 second")
    try:
        for _ in range(60):
            found = [(r.job, r.event) for r in state.history(spark, out, TOLD).collect()]
            if found:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert found == [(1, "silent")]  # nothing came after the first batch


def test_tails_keep_the_last_lines(spark, tmp_path):
    random.seed(6)
    lines = [(random.choice("abc"), i // 3, i % 3, f"line {i}") for i in range(900)] + [(None, 1, 1, "x"), ("a", 2, 2, None), ("d", 1, 1, ""), ("d", None, None, "first")]
    random.shuffle(lines)
    schema, out, c = "job string, at long, seq long, line string", f"{tmp_path}/out", f"{tmp_path}/c"
    for r, part in enumerate((lines[:400], lines[400:])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in/r={r}")
        logs.drain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/r=*"), out, c, most=100).awaitTermination()
    want = {j: [x for *_, x in sorted((a or 0, s or 0, x) for k, a, s, x in lines if k == j and x is not None)][-100:] for j in "abcd"}
    got = lambda: {r.job: r.tail for r in logs.shown(spark, out).collect()}
    assert got() == want and len(want["a"]) == 100
    # The sink is told of the last batch once more, as after a failure between its end and the checkpoint.
    last = max(r.batch for r in state.history(spark, out, "job string, tail array<string>").select("batch").distinct().collect())
    rows = state.history(spark, out, "job string, tail array<string>")
    again = spark.createDataFrame(rows.where(F.col("batch") == last).drop("batch").collect(), "job string, tail array<string>")
    before = state.history(spark, out, "job string, tail array<string>").count()
    state.by_batch(out)(again, last)
    assert got() == want and state.history(spark, out, "job string, tail array<string>").count() == before


def test_refresh_equals_recomputation(spark, tmp_path):
    """After inserts, updates and deletes, with only changed values in what a round writes."""
    c = C.published(catalog(spark, SF)).select("id", *FA.COLUMNS)
    rows = c.collect()
    top = max(r.publication_year or 0 for r in rows)
    versions = [c, c.where(F.coalesce(F.col("publication_year") < top, F.lit(True))), c.where("id % 7 = 3").withColumn("language", F.when(F.col("id") % 2 == 0, "Latin")), c.limit(0), c.where("id < 20")]
    old, changes, out, check = None, f"{tmp_path}/changes", f"{tmp_path}/out", f"{tmp_path}/check"
    for n, new in enumerate(versions):
        FA.signed(old, new).write.mode("append").parquet(changes)
        FA.refresh(spark.readStream.schema(spark.read.parquet(changes).schema).parquet(changes), out, check).awaitTermination()
        found = FA.current(spark, out)
        full = new.select("*")
        for view, plain in ((FA.overview, C.overview), (FA.language_options, C.language_options), (FA.era_sections, C.era_sections)):
            assert sorted(map(str, view(found).collect())) == sorted(map(str, plain(full).collect())), (n, view)
        old = new
    written = {b: n for b, n in state.history(spark, out, FA._SCHEMA).groupBy("batch").count().collect()}
    assert len(written) == 5 and written[1] < written[0] / 4  # the second round touched a few values


def test_signed_changes(spark):
    cols = "id long, author_display string, century_label string, language string, rights_assessment string, publication_year int"
    old = spark.createDataFrame([(1, "a", None, "l", None, 1700), (2, "b", None, "l", None, None), (3, "c", None, None, None, 1)], cols)
    new = spark.createDataFrame([(1, "a", None, "l", None, 1700), (2, "b", None, "m", None, None), (4, "d", None, None, None, 2)], cols)
    got = sorted((r.sign, r.author_display, r.language) for r in FA.signed(old, new).collect())
    assert got == [(-1, "b", "l"), (-1, "c", None), (1, "b", "m"), (1, "d", None)]
    assert FA.signed(None, new).where("sign = 1").count() == 3 and FA.signed(new, new).count() == 0


def test_page_takes_one_scan(spark):
    docs = C.published(catalog(spark, SF))
    tables = []

    def held(df):
        tables.append(df)
        return df

    page = FA.page(docs, held)
    plan = tables[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and len(tables) == 1  # documents and labels, which make the catalog
    assert page["overview"].collect() == C.overview(docs).collect() and page["languages"].collect() == C.language_options(docs).collect()
    assert sorted(page["eras"].collect()) == sorted(C.era_sections(docs).collect())
    years = {(r.era, r.year_label, r.documents) for r in C.era_year_buckets(docs).collect()}
    assert {tuple(r) for r in page["years"].collect()} == years


def test_runs_beat(spark, tmp_path):
    run = callbacks.Run(spark, "job", str(tmp_path / "run"), threshold_sec=30)
    evens = run.stage("evens", spark.range(100).where("id % 2 = 0"))
    assert evens.count() == 50
    with pytest.raises(Exception):
        run.stage("fails", spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    beats = run.beats()
    assert [(r.stage, r.rows) for r in beats.collect()] == [("evens", 50)]
    late = str((datetime.now(timezone.utc) + timedelta(seconds=60)).replace(tzinfo=None))
    hung = lambda: [r.hung_suspected for r in progress.hung(run.beats(), run.beats().select("job", "threshold_sec").distinct(), late).collect()]
    assert hung() == [True]
    run.finish()
    assert hung() == [False] and [(r.job, r.stage, r.beats) for r in progress.latest_state(run.beats()).collect()] == [("job", "complete", 2)]
    out = str(tmp_path / "told")
    state.maintain(watch.alerts(run.stream()), out, str(tmp_path / "c"), "append").awaitTermination()
    assert watch.suspected(state.history(spark, out, TOLD.replace("job long", "job string"))).count() == 0


def test_streams_beat(spark, tmp_path):
    heard = callbacks.StreamProgress(threshold_sec=5)
    spark.streams.addListener(heard)
    try:
        spark.range(10).write.parquet(f"{tmp_path}/in")
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.queryName("copy").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
        for _ in range(50):
            beats = [r for r in heard.beats(spark).collect() if r.job == "copy"]
            if beats and beats[-1].stage == "complete":
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(heard)
    assert beats[0].stage == "started" and beats[-1].stage == "complete" and sum(r.rows or 0 for r in beats) == 10
    assert progress.latest_state(heard.beats(spark)).where("job = 'copy' AND stage = 'complete'").count() == 1

"""What operators leave behind in executors and workers is bounded: small batches go to Python, no workers beside the tasks'."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import common, mixing, packs, repeats

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_small_while_operators_write(spark):
    before = spark.conf.get(_BATCH, None)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    found = common.written(docs.mapInArrow(sizes, "n long, bytes long")).agg(F.sum("n"), F.max("bytes")).first()
    assert found[0] == 3000 and found[1] < 2 * common.BATCH_BYTES
    assert spark.conf.get(_BATCH, None) == before
    assert sum(len(packs.rows_of(r.body)) for r in packs.pack(docs, ["doc_id", "text"], 2).collect()) == 3000
    with common.small_batches(spark), common.small_batches(spark):
        pass
    assert spark.conf.get(_BATCH, None) == before


def test_a_smaller_setting_of_the_session_stays(spark):
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, 1000)
    try:
        with common.small_batches(spark):
            assert spark.conf.get(_BATCH) == "1000"
        assert spark.conf.get(_BATCH) == "1000"
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def test_the_mix_is_planned_without_workers_of_another_kind(spark):
    totals = spark.createDataFrame([("a", 10), (None, 0), ("b", 30)], "source string, source_size long")
    plan = mixing._planned(totals, [3.0, 1.0, 2.0], 1.5, 2.0)
    assert "Python" not in plan._jdf.queryExecution().toRdd().toDebugString()
    assert plan.dtypes == [("source", "string"), ("group", "int"), ("source_size", "bigint"), ("target", "double"), ("whole", "int"), ("p", "double")]
    assert {r.source: r.source_size for r in plan.collect()} == {"a": 10, None: 0, "b": 30}
    assert mixing._planned(totals.limit(0), [1.0], 1.5, 2.0).count() == 0


def test_stages_bound_the_batches_of_what_is_written_later(spark):
    before = spark.conf.get(_BATCH, None)
    spark.conf.unset(_BATCH)
    try:
        docs = spark.createDataFrame([(i, f"plain text {i}", "en", "a", 12) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.cut_passages(spark, docs, "")
        assert int(spark.conf.get(_BATCH)) == common.BATCH_BYTES
        assert kept.count() == 3
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def test_a_pack_of_long_documents_is_cut_in_several_batches(spark):
    own = " ".join(f"own{i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, f"{own} last{i}", i) for i in range(12)], "doc_id long, text string, more long")
    found = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.more, r.n_words) for r in found] == [(i, i, 60_001) for i in range(12)]
    # the last window of each text ends in a word of its own, so every later text keeps that word alone
    assert [r.n_removed for r in found] == [0] + [60_000] * 11
    assert [r.text for r in found] == [f"{own} last0"] + [f"last{i}" for i in range(1, 12)]

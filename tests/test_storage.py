"""Folder source, file sink, constraints, the search index and exact medians."""

import json
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import integrity, trigrams
from foliant.operators import operations as O
from foliant.operators.layout import layout_profile
from foliant.operators.medians import medians
from foliant.sources import artifacts, files, folders, schema
from foliant.sources.adapters import catalog


def put(root, path, content=b"", size=None):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_bytes(content)
    if size:
        os.truncate(f, size)


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "outputs"
    for i in range(10):
        put(at, f"out-{i}/n_quality_report.json", json.dumps({"paper_name": f"P{i}", "total_pages": 2, "transcription": {"failed_pages": [4]}}).encode())
        put(at, f"out-{i}/z_quality_report.json", b"", size=1 << 40)  # not the first of its kind
        put(at, f"out-{i}/n_Korean.log", b"Overfull \\hbox\nnoise \xff")
        put(at, f"out-{i}/n_digitalized.pdf", size=1 << 40)  # a terabyte that nobody reads
        put(at, f"out-{i}/images/page_001.png", size=1 << 40)
        put(at, f"out-{i}/images/x_quality_report.json", b"{}")
    put(at, "out-3/n_pipeline_state.json", b"\xff\xfe")
    put(at, "loose_quality_report.json", b"{}")
    put(at, "_staging-1/a/n_quality_report.json", b"{}")
    return at


def test_folders_read_reports_and_logs_alone(spark, root):
    found = folders.read(spark, str(root), foldersPerTask=3)
    assert found.rdd.getNumPartitions() == 4
    rows = {(r.folder, r.path): r for r in found.collect()}
    assert len(rows) == 61 and {f for f, _ in rows} == {f"out-{i}" for i in range(10)}
    assert {p for (f, p), r in rows.items() if r.content is not None} == {"n_quality_report.json", "n_Korean.log"}
    assert rows["out-1", "n_digitalized.pdf"].size == 1 << 40 and rows["out-1", "images/x_quality_report.json"].kind == "other"
    assert rows["out-3", "n_pipeline_state.json"].content is None and rows["out-1", "n_Korean.log"].content.endswith("noise \ufffd")
    s = {r.folder: r for r in O.summary(found, "2025-01-01 00:00:00").collect()}
    assert len(s) == 10 and (s["out-7"].title, s["out-7"].failed_pages, s["out-7"].compile_warning_count, s["out-7"].digitalized_compiled) == ("P7", [4], 1, True)
    assert folders.read(spark, str(root / "absent")).count() == 0
    assert folders.read(spark, f"file:{root}", contents=False).where("content IS NOT NULL").count() == 0


def test_folder_filters_reach_the_source(spark, root):
    some = folders.read(spark, str(root), foldersPerTask=1).where("folder IN ('out-2', 'out-5') AND kind = 'quality'")
    assert some.rdd.getNumPartitions() == 2  # other folders have no task
    assert sorted((r.folder, r.path) for r in some.collect()) == [(f"out-{i}", f"{n}_quality_report.json") for i in (2, 5) for n in "nz"]
    assert "PushedFilters" in some._jdf.queryExecution().executedPlan().toString() or some.count() == 4
    assert folders.read(spark, str(root)).where("kind IN ('log', 'pdf') AND kind = 'log'").count() == 10
    assert folders.read(spark, str(root)).where("kind = 'log' AND path LIKE 'n%' AND size > 1000").count() == 0


REPORT = '{"b": 1, "a": "é", "list": [1, {"x": null}], "empty": []}'


def test_one_file_a_report(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/r{i}.json", REPORT) for i in range(20)], "path string, content string").repartition(4)
    files.write(rows, str(tmp_path))
    there = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert there == sorted(f"d{i % 3}/r{i}.json" for i in range(20))  # nothing else, no staging either
    assert (tmp_path / "d1/r1.json").read_bytes() == '{\n  "b": 1,\n  "a": "é",\n  "list": [\n    1,\n    {\n      "x": null\n    }\n  ],\n  "empty": []\n}'.encode()
    files.write(spark.createDataFrame([("d1/r1.json", bytearray(b"\x00raw"))], "path string, content binary"), f"file:{tmp_path}")
    assert (tmp_path / "d1/r1.json").read_bytes() == b"\x00raw" and len(there) == len([p for p in tmp_path.rglob("*") if p.is_file()])


@pytest.mark.parametrize("bad", [("../x.json", "{}"), ("/x.json", "{}"), (None, "{}"), ("x.json", None), ("x.json", "no json"), ("same.json", "{}")])
def test_a_failed_job_leaves_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([("same.json", "{}"), *((f"ok{i}.json", "{}") for i in range(50)), bad], "path string, content string").coalesce(1)
    with pytest.raises(Exception):
        files.write(rows, str(tmp_path))
    assert not list(tmp_path.rglob("*"))


def test_a_retried_task_leaves_one_file(tmp_path):
    """Two attempts of a task have written, Spark commits one."""
    sink = files._Writer(str(tmp_path), 2)
    rows = [{"path": "d/r.json", "content": "{}"}, {"path": "s.json", "content": "[1]"}]
    lost, kept = sink.write(iter(rows[:1])), sink.write(iter(rows))
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith("_staging")]  # before the commit there is nothing
    sink.commit([kept, None])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["d/r.json", "s.json"] and lost.folder != kept.folder
    gone = files._Writer(str(tmp_path), 2)
    gone.write(iter([{"path": "t.json", "content": "{}"}]))
    gone.abort([])
    assert not (tmp_path / "t.json").exists() and not [p for p in tmp_path.iterdir() if p.name.startswith("_staging")]


def test_modes_and_columns_of_the_sink(spark, tmp_path):
    spark.dataSource.register(files.FileSink)
    rows = spark.createDataFrame([("a", 1)], "path string, content int")
    with pytest.raises(Exception, match="string or binary"):
        rows.write.format("one_file_a_row").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", "{}")], "path string, content string").write.format("one_file_a_row").mode("overwrite").save(str(tmp_path))


def test_audit(spark):
    t = {n: schema.empty(spark, n) for n in schema.TABLES}
    assert integrity.audit(t).count() == 0
    t["documents"] = spark.createDataFrame([(1, "a", "t"), (2, "a", None), (3, None, "u"), (3, "c", "v")], "id long, slug string, title string")
    t["authors"] = spark.createDataFrame([(7, "A", "a")], "id long, display_name string, sort_name string")
    t["document_authors"] = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (9, 7, 1), (9, 8, 1), (None, 7, 1)], "document_id long, author_id long, ordinal int")
    t["document_pages"] = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 1)], "id long, document_id long, page_number int")
    got = sorted((r.rule, r.key or [], r.rows) for r in integrity.audit(t).collect())
    assert got == sorted([
        ("documents: unique id", ["3"], 2), ("documents: unique slug", ["a"], 2), ("documents: slug is missing", [], 1), ("documents: title is missing", [], 1),
        ("document_authors: unique document_id, author_id", ["1", "7"], 2), ("document_authors: document_id is missing", [], 1), ("document_authors: document_id refers to documents", ["9"], 2),
        ("document_authors: author_id refers to authors", ["8"], 1), ("document_pages: unique document_id, page_number", ["1", "1"], 2)])
    plan = integrity.audit({"document_authors": t["document_authors"], "documents": t["documents"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_deletes_cascade(spark):
    t = {
        "documents": spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, slug string"), "authors": spark.createDataFrame([(7, "x"), (8, "y")], "id long, sort_name string"),
        "document_authors": spark.createDataFrame([(1, 7, 1), (2, 7, 1), (2, 8, 2), (None, 8, 1)], "document_id long, author_id long, ordinal int"),
        "document_pages": spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "id long, document_id long, page_number int"),
    }
    rows = lambda d: {n: sorted(map(tuple, df.collect()), key=str) for n, df in d.items()}
    left = rows(integrity.delete(t, "documents", F.col("slug") == "a"))
    assert left == {"documents": [(2, "b"), (None, "c")], "authors": [(7, "x"), (8, "y")], "document_authors": sorted([(2, 7, 1), (2, 8, 2), (None, 8, 1)], key=str), "document_pages": [(2, 2, 1)]}
    left = rows(integrity.delete(t, "authors", F.col("id") == 8))
    assert left["document_authors"] == [(1, 7, 1), (2, 7, 1)] and left["documents"] == sorted(map(tuple, t["documents"].collect()), key=str)
    assert rows(integrity.delete(t, "documents", F.lit(None).cast("boolean"))) == rows(t)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = C.published(catalog(spark, "/root/testdata/sf0.01")).withColumn("title", F.when(F.col("id") == 3, "a\nb É日本").otherwise(F.col("title")))
    path = str(tmp_path_factory.mktemp("index") / "i")
    trigrams.build(docs, path, block=64, buckets=8)
    return docs.persist(), path


@pytest.mark.parametrize("query", ["author  th century", "", "   ", "a", "th 1", "journal 3", "10.1000/1", "doc zzz", "zzzz", "É日本", "a\tb", "src7 english 17", "src0 src1", "%_", "author author"])
def test_index_finds_what_search_finds(spark, index, query):
    docs, path = index
    want = sorted(r.id for r in C.search(docs, query).select("id").collect())
    for few in (1, 2, 9):
        assert sorted(r.id for r in trigrams.search(spark, path, query, few).collect()) == want


def test_index_reads_few_blocks(spark, index):
    docs, path = index
    all_blocks = spark.read.parquet(f"{path}/grams").count()
    some = trigrams.chosen(spark, path, "10.1000/12 journal")
    assert trigrams.chosen(spark, path, "doc zzzz") is None and trigrams.chosen(spark, path, "ab c") == []
    assert 0 < sum(n for _, _, n in some) < all_blocks / 50
    found = trigrams.search(spark, path, "10.1000/12 journal")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan
    assert max(len(r.places) for r in spark.read.parquet(f"{path}/grams").collect()) <= 2 * 64
    named = trigrams.candidates(spark, path, some).count()
    assert found.count() <= named < docs.count() / 10


def test_index_of_nothing(spark, index, tmp_path):
    trigrams.build(index[0].limit(0), str(tmp_path / "i"))
    assert all(trigrams.search(spark, str(tmp_path / "i"), q).count() == 0 for q in ("", "author", "a"))


@pytest.mark.parametrize("many", [0, 40, 10**6])
def test_medians_are_exact(spark, many):
    random.seed(7)
    groups = {"hot": [random.choice([1.5, 2.5, 2.5, 1e300, -1e300, random.random()]) for _ in range(5000)], "even": [1.0, 2.0, 4.0, 8.0], "ties": [3.0] * 999, "two": [0.1, 0.2] * 60, None: [float(i) for i in range(101)], "none": [None] * 50}
    rows = [(k, v, None if v is None else -v, i) for k, vs in groups.items() for i, v in enumerate(vs)] + [("even", float("nan"), None, 0), ("even", None, 1.0, 0)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double, y double, i int").repartition(5)
    got = {r.k: (r.x, r.y) for r in medians(df, "k", ["x", "y"], many=many, accuracy=1000).collect()}
    mid = lambda vs: 0.5 * sorted(vs)[(len(vs) - 1) // 2] + 0.5 * sorted(vs)[len(vs) // 2]
    want = {k: (None, None) if k == "none" else (mid(vs), mid([-v for v in vs] + ([1.0] if k == "even" else []))) for k, vs in groups.items()}
    assert got == want and want["hot"][0] == statistics.median(groups["hot"])


def test_medians_of_an_empty_table(spark):
    assert medians(spark.createDataFrame([], "k string, x double"), "k", ["x"]).count() == 0


def test_profile_by_either_way(spark):
    pages = spark.range(2000).selectExpr("id % 3 AS doc", "300.0 + id % 97 AS width", "500.0 + id % 89 AS height", *(f"CASE WHEN id % 4 <> 0 THEN (id % {m}) / 100.0 END AS {s}" for m, s in ((23, "left"), (19, "right"), (17, "top"), (13, "bottom"))))
    assert sorted(layout_profile(pages, "doc").collect()) == sorted(layout_profile(pages, "doc", many=10).collect())


def test_scan_and_source_agree(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"out-{i}/n_quality_report.json", b'{"paper_name": "x"}')
        put(tmp_path, f"out-{i}/sub/page_001.png", b"png")
    a = artifacts.scan(spark, str(tmp_path)).selectExpr("folder", "path", "size")
    assert sorted(a.collect()) == sorted(folders.read(spark, str(tmp_path)).select("folder", "path", "size").collect())

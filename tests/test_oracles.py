"""Every query against its DuckDB SQL on the smallest tables."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import publish as P
from foliant.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(json.dumps([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    sql = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(sql.columns)
    assert lines(found.columns, found.collect()) == lines(sql.columns, sql.fetchall())


def test_last_asset_is_of_the_last_page(spark, tmp_path):
    last = {1: 998, 2: 999, 3: 1000, 4: 1001, 5: 10001}  # 999 is not held
    spark.createDataFrame([(k, "\n".join(f"line {i}" for i in range(n))) for k, n in last.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.queries()["key_assets"](spark, str(tmp_path))
    rows, sql = found.collect(), c.sql(registry.oracle_sql()["key_assets"])
    assert {(r.document_id, r.storage_path) for r in rows if r.asset_type == "page_tex"} == {(k, f"doc/page_{998 if n == 999 else n}.tex") for k, n in last.items()}
    assert len(rows) == 15 and lines(found.columns, rows) == lines(sql.columns, sql.fetchall())


def test_assets_of_a_bundle_keep_three_digits_and_the_order_of_paths(spark):
    files = spark.createDataFrame([(1, p, p) for p in ("page_998.tex", "page_1000.tex", "images/page_998.png", "images/page_1000.png")], "document_id long, relative_path string, storage_path string")
    kinds = lambda long: files.withColumn("asset_type", X.asset_type(F.col("relative_path"), F.lit("n"), long))
    assert {r.relative_path for r in kinds(False).where("asset_type = 'artifact'").collect()} == {"page_1000.tex"} and kinds(True).where("asset_type = 'artifact'").count() == 0
    assert {r.storage_path for r in P.key_assets(kinds(False)).collect()} == {"page_998.tex", "images/page_998.png"}


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_ranking_holds_every_folder_in_order(spark, duck):
    found = [tuple(r) for r in registry.queries()["ops_ranked"](spark, SF).collect()]
    assert len(found) > 100 and found == duck.sql(registry.oracle_sql()["ops_ranked"]).fetchall()


def test_blocks_hold_whole_texts(spark, duck):
    most = duck.sql("SELECT max(length(trim(text))) FROM documents WHERE doc_id % 5 = 0").fetchall()[0][0]
    assert max(len(r.block or "") for r in registry.queries()["extract_block"](spark, SF).collect()) >= most > 1000


def test_tail_holds_200_lines(spark, duck):
    most = duck.sql("SELECT max(least(len(string_split(text, chr(10))), 200)) FROM documents").fetchall()[0][0]
    assert max(r.tail.count("\n") + 1 for r in registry.queries()["log_tail"](spark, SF).collect()) == most > 3

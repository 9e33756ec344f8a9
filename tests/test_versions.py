"""Versions of tables that change together, and catalog orders by locale."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import snapshot
from foliant.operators.order import numbered


def test_tables_change_together(spark, tmp_path):
    root = f"file:{tmp_path}/archive"
    assert snapshot.read(spark, root) == {} and snapshot.versions(spark, root) == []
    one = {"a": spark.range(3), "b": spark.range(2).toDF("x")}
    assert snapshot.publish(one, root) == 1
    held = snapshot.read(spark, root)
    assert sorted(held) == ["a", "b"] and held["a"].count() == 3
    # The next version is made from the one it follows.
    assert snapshot.publish({"a": held["a"].unionByName(spark.range(10, 12)), "b": held["b"].where("x = 1")}, root) == 2
    now = snapshot.read(spark, root)
    assert (now["a"].count(), now["b"].count()) == (5, 1) and held["a"].count() == 3 and snapshot.read(spark, root, 1)["b"].count() == 2
    with pytest.raises(ValueError):
        snapshot.read(spark, root, 7)


def test_a_publisher_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "archive")
    snapshot.publish({"a": spark.range(3), "b": spark.range(3)}, root)
    with pytest.raises(Exception):
        snapshot.publish({"a": spark.range(9), "b": spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))}, root)
    assert snapshot.versions(spark, root) == [1] and snapshot.read(spark, root)["a"].count() == 3
    assert snapshot.publish({"a": spark.range(4), "b": spark.range(4)}, root) == 2


def test_of_two_publishers_one_wins(spark, tmp_path):
    root = str(tmp_path / "archive")
    snapshot.publish({"a": spark.range(1)}, root)
    assert snapshot.publish({"a": spark.range(2)}, root, base=1) == 2
    before = sorted(p.name for p in (tmp_path / "archive").iterdir())
    with pytest.raises(FileExistsError):
        snapshot.publish({"a": spark.range(3)}, root, base=1)
    assert sorted(p.name for p in (tmp_path / "archive").iterdir()) == before and snapshot.read(spark, root)["a"].count() == 2


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "archive")
    for n in range(1, 5):
        snapshot.publish({"a": spark.range(n)}, root)
    assert snapshot.expire(spark, root, keep=2) == [1, 2] and snapshot.versions(spark, root) == [3, 4]
    assert snapshot.read(spark, root, 3)["a"].count() == 3 and snapshot.expire(spark, root, keep=0) == [3] and snapshot.read(spark, root)["a"].count() == 4
    assert snapshot.publish({"a": spark.range(9)}, root) == 5


#: How a reader of a Latin script expects names: marks and case decide only between equal letters.
NAMES = ["", " ", "_x", "-", "10", "9", "a", "A", "á", "ab", "Ab", "äb", "abc", "B", "Côte", "coté", "Cote z", "É", "zebra", "Zoë", "Ω", "я", "日本"]


@pytest.mark.parametrize("sort", C.SORTS)
def test_sorts_follow_the_locale(spark, sort):
    rows = [(i, n, n, 1900, "2024-01-01", 5) for i, n in enumerate(NAMES)]
    docs = spark.createDataFrame(rows, "id long, title string, author_display string, publication_year int, published_at string, page_count int").repartition(5)
    got = [r.title for r in C.sort_documents(docs, sort).collect()]
    place = {n: i for i, n in enumerate(got)}
    for a, b in [("a", "A"), ("A", "á"), ("á", "ab"), ("ab", "Ab"), ("Ab", "äb"), ("äb", "abc"), ("abc", "B"), ("B", "Côte"), ("É", "zebra"), ("zebra", "Zoë"), ("Zoë", "Ω"), ("Ω", "я"), ("я", "日本"), ("10", "9"), ("9", "a"), ("", " "), ("-", "10")]:
        assert place[a] < place[b], (a, b)
    pos = {r.id: r.pos for r in C.positions(docs, sort, "UNICODE").collect()}
    assert [NAMES[i] for i in sorted(pos, key=pos.get)] == got and sorted(pos.values()) == list(range(1, len(NAMES) + 1))
    assert [r.title for r in C.sort_documents(docs, sort, None).collect()] == sorted(NAMES, key=lambda n: n.encode())


def test_numbers_start_after_a_column(spark):
    df = spark.range(100).selectExpr("id", "100 - id AS v", "1000 AS most").repartition(7)
    got = {r.id: r.n for r in numbered(df, [F.col("v")], "n", F.col("most")).collect()}
    assert got == {i: 1000 + 100 - i for i in range(100)}

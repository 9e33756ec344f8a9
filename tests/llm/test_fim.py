"""Fill-in-middle against its SQL and a plain version with a regular expression."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from foliant.llm import fim

SF = "/root/testdata/sf0.01"


def units(t):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)


def texts(n=300):
    random.seed(12)
    parts = ["a", "é", "日本", "😀", " ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "<", "<P", ">", "S>", "word", "x" * 70]
    return ["", " ", "a", " \n "] + ["".join(random.choices(parts, k=random.choice([1, 3, 40]))) for _ in range(n)]


def test_masks_and_ranks():
    for t in texts():
        raw, us = t.encode(), units(t)
        assert "".join(us) == t
        ends = fim.unit_ends(raw)
        assert ends.bit_count() == len(us)
        at = [len("".join(us[: i + 1]).encode()) - 1 for i in range(len(us))]
        assert [fim.select(ends, r) for r in range(1, len(us) + 1)] == at
        assert fim.mask(raw, fim._FIRST).bit_count() == len(t)


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(fim.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = fim.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    assert got.astype(object).where(got.notna(), None).equals(want.astype(object).where(want.notna(), None))
    assert set(got.form) == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    long = "wörd \n" * 300_000
    rows = [(i, t) for i, t in enumerate(texts())] + [(1000, None), (1001, "has <P> mark"), (1002, long), (1002, long), (1003, long), (1004, long), (None, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit("x"))
    made = fim.transform(docs, rate=100)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        wanted = {t or "" for d, t in rows if d == r.doc_id}
        assert {r.back} == wanted
        us = units(r.back)
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        a, b = sorted(int(h[i : i + 8], 16) % (len(us) + 1) for i in (0, 8))
        p, m, s = ("".join(x) for x in (us[:a], us[a:b], us[b:]))
        plain = not r.back or any(k in r.back for k in fim.MARKS)
        form = "plain" if plain else "spm" if int(h[24:32], 16) % 100 < 80 else "psm"
        out = {"plain": r.back, "spm": f"<S>{s}<P>{p}<M>{m}", "psm": f"<P>{p}<S>{s}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == (len(us), form, out, *((None, None) if plain else (len(p), len(m))))
    assert fim.transform(docs.limit(0)).count() == 0
    marks = ("[[p]]", "\\E", "$^")
    other = fim.transform(docs, marks=marks, rate=100).where("form <> 'plain'")
    assert other.where(fim.restore(F.col("output"), F.col("form"), marks) == "").count() == 0 and other.count() > 100

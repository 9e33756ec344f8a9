"""Work that grows with its input, not with the square of a document's pages, and is done only where it is wanted."""

import time

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import publish as P
from foliant.operators import runs as N
from foliant.plans import bundle as PB
from foliant.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def document(spark, pages):
    body = "\n\\newpage\n".join(f"page {i} " + "word " * 40 for i in range(pages))
    return spark.createDataFrame([(1, "\\documentclass{x}\n\\begin{document}\n" + body + "\n\\end{document}")], "doc_id long, tex string")


def seconds(df):
    start = time.monotonic()
    rows = df.collect()
    return time.monotonic() - start, rows


def test_bundled_documents_read_no_page_texts(spark):
    made = PB.bundles(spark, SF)
    assert "newpage" not in plan(made["documents"])
    assert plan(made["pages"]).count("newpage") == 4  # split once and made readable once, for each of two texts


def test_a_document_is_split_in_one_pass(spark):
    PAGES = 6000
    docs = document(spark, PAGES)
    split = docs.select(X.split_pages(F.col("tex")).alias("p"))
    took, rows = seconds(split.select(F.size("p").alias("n"), F.element_at("p", -1).alias("last")))
    assert rows[0].n == PAGES and rows[0].last == f"\\documentclass{{x}}\n\\begin{{document}}\npage {PAGES - 1} " + ("word " * 40).strip() + "\n\\end{document}"
    merged, back = seconds(docs.select(X.merge_pages(X.split_pages(F.col("tex"))).alias("m")))
    assert back[0].m.count("\\newpage") == PAGES - 1
    chunked, chunks = seconds(N.translation_chunks(docs, "doc_id", F.col("tex"), 4).select("chunk", "pages"))
    assert len(chunks) == PAGES // 4 and sum(c.pages for c in chunks) == PAGES
    assert max(took, merged, chunked) < 15  # each of them took minutes when a page's turn read the whole document


def test_texts_are_paired_in_one_pass(spark):
    n = 4000
    docs = spark.createDataFrame([(list(range(1, n + 1)), [f"line {i}" for i in range(n)])], "numbers array<int>, lines array<string>")
    texts = F.transform("lines", lambda x: F.concat(x, F.sha2(x, 512)))
    took, got = seconds(docs.select(F.explode(P.page_texts(F.col("numbers"), texts, F.slice(texts, 1, 5))).alias("p")).select("p.*"))
    assert len(got) == n and got[4].korean_text == got[4].digitalized_text and got[5].korean_text == "" and got[n - 1].digitalized_text.startswith(f"line {n - 1}")
    assert took < 8  # the lists are made once, not for each number


def test_tables_make_only_what_they_are_made_from(spark, monkeypatch):
    kept = []
    real = PB.held
    monkeypatch.setattr(PB, "held", lambda df, name: kept.append(name) or real(df, name))
    out = PB.published(spark, SF)
    assert set(kept) == {"outputs", "documents", "authors"}  # no page's text is made for authors, links, assets or snapshots
    for name in ("authors", "document_authors", "document_assets", "document_metadata_snapshots", "documents"):
        assert "newpage" not in plan(out[name])
    assert out["document_pages"].count() > 0


def test_a_new_folder_is_one_move(tmp_path, monkeypatch):
    moves = []

    class Counted:
        def __init__(self, at):
            self.at = at

        def __getattr__(self, name):
            return getattr(self.at, name)

        def move(self, a, b):
            moves.append((a, b))
            self.at.move(a, b)

    real = files.store
    monkeypatch.setattr(files, "store", lambda path: (Counted(real(path)[0]), real(path)[1]))
    files_of = lambda v, *folders: [{"path": f"{f}/sub/r{i}", "content": v} for f in folders for i in range(20)]
    (tmp_path / "old").mkdir()
    (tmp_path / "old/kept").write_bytes(b"k")
    w = files._Writer(str(tmp_path), 2)
    staged = [w.write(iter(files_of(b"1", "a", "b", "old"))), w.write(iter(files_of(b"2", "c") + [{"path": "loose", "content": b"x"}])), None]
    w.commit(staged)
    assert len(moves) == 3 + 20 + 1  # new folders as one, the others' files and the loose one by one
    assert {p.name for p in tmp_path.iterdir()} == {"a", "b", "c", "old", "loose"} and len(list(tmp_path.rglob("r*"))) == 80 and (tmp_path / "old/kept").read_bytes() == b"k"


def test_two_tasks_share_a_folder(tmp_path):
    w = files._Writer(str(tmp_path), 2)
    w.commit([w.write(iter([{"path": f"a/s{t}/r", "content": b"1"}, {"path": f"a/x{t}", "content": b"1"}])) for t in range(8)])
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 16 and [p.name for p in tmp_path.iterdir()] == ["a"]

"""Functions and rules on small values whose results are known."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.functions import repair as L
from foliant.functions import rules as R
from foliant.functions import text as X
from foliant.functions import udfs as U
from foliant.operators import bundle as B
from foliant.operators import catalog as C
from foliant.operators import publish as P
from foliant.operators import runs as N
from foliant.operators.layout import margins
from foliant.operators.order import numbered
from foliant.sources import artifacts as A


def value(spark, c):
    return spark.range(1).select(c().alias("x")).first()[0]


def test_page_ranges(spark):
    at = lambda s, n: value(spark, lambda: X.parse_page_range(F.lit(s), F.lit(n)))
    assert at("1-3,5", 5) == [0, 1, 2, 4]
    assert at("4,2,7", 4) == [3, 1]


def test_page_numbers_keep_first_seen_order(spark):
    pages = F.array(*map(F.lit, ("3", "2", "2", "0", "-1", "x")))
    assert value(spark, lambda: X.coerce_pages(pages, ordered=False)) == [3, 2]
    assert value(spark, lambda: X.coerce_pages(pages)) == [2, 3]


@pytest.mark.parametrize("text,year", [("Published in 1750", 1750), ("1499", None), (" 2100 ", 2100), ("none", None), ("12345", None)])
def test_years(spark, text, year):
    assert value(spark, lambda: X.coerce_year(F.lit(text))) == year


def test_slugs(spark):
    slug = lambda t: value(spark, lambda: X.slug_of_folded(U.ascii_fold(F.lit(t)), F.lit(t)))
    assert slug("  Recherches sur la courbe ") == "recherches-sur-la-courbe"
    assert slug("Première partie: Loix générales du mouvement") == "premiere-partie-loix-generales-du-mouvement"
    assert slug("한글").startswith("document-")
    assert slug("  ") == "untitled-document"


@pytest.mark.parametrize("year,label", [(1750, "18th century"), (1, "1st century"), (1101, "12th century"), (2001, "21st century"), (0, None), (None, None)])
def test_centuries(spark, year, label):
    assert value(spark, lambda: X.century_label(F.lit(year).cast("int"))) == label


def assess(spark, author, year, death, sources=(None, None, None)):
    src = {f: F.lit(s).cast("string") for f, s in zip(R.RIGHTS_FIELDS, sources)}
    return value(spark, lambda: R.assess_rights(F.lit(author).cast("string"), F.lit(year).cast("int"), F.lit(death).cast("int"), src, 2025))


def test_rights_rules(spark):
    r = assess(spark, "A", 1750, None, (None, "ai_high", None))
    assert (r["assessment"], r["basis"], r["needs_manual_review"]) == ("likely_public_domain_us", "publication_year", True)
    r = assess(spark, "A", None, 1935, ("user", None, "user"))
    assert (r["assessment"], r["needs_manual_review"], r["warnings"]) == ("likely_public_domain_life_plus_70", False, [])
    r = assess(spark, None, 2999, 2998)
    assert r["assessment"] == "unknown" and len(r["warnings"]) == 2 and r["needs_manual_review"]
    assert assess(spark, None, None, None)["reason"] == "Insufficient metadata."


def test_hung_threshold(spark):
    assert value(spark, lambda: R.hung_threshold(F.lit(180), F.lit(2), F.lit(120))) == 600
    assert value(spark, lambda: R.hung_threshold(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(-5))) == 360
    assert value(spark, lambda: R.hung(F.lit("translation"), F.lit(900), F.lit(600)))
    assert not value(spark, lambda: R.hung(F.lit("complete"), F.lit(900), F.lit(600)))
    assert not value(spark, lambda: R.hung(F.lit("translation"), F.lit(None).cast("int"), F.lit(600)))


def test_only_real_booleans_count(spark):
    flag = lambda j: value(spark, lambda: R.pdf_compiled(F.parse_json(F.lit(j)), F.lit(False), F.lit(False)))
    assert flag("true") is True
    assert flag('"true"') is False


@pytest.mark.parametrize("params,ids", [({}, [1, 2, 3]), ({"language": "ENGLISH", "year_from": "1700", "rights": "public_domain"}, [1, 3]), ({"q": "opt ne"}, [3]), ({"rights": "other"}, []), ({"year_to": "1e3"}, [])])
def test_browse(spark, params, ids):
    rows = [Row(1, "Zeeman", "P. Zeeman", 1918, "English", 18, "likely_public_domain_us"), Row(2, "Kepler", None, 1610, "Latin", 64, None), Row(3, "Opticks", "Newton", 1704, "English", 240, "likely_public_domain_us")]
    df = spark.createDataFrame(rows, "id long, title string, author_display string, publication_year int, language string, page_count int, rights_assessment string")
    df = df.selectExpr("*", *(f"cast(null as string) {c}" for c in ("journal_or_book", "century_label", "volume", "issue", "page_range", "doi")))
    assert [r.id for r in C.browse(df, **params).orderBy("id").collect()] == ids
    assert [r.id for r in C.sort_documents(df, "pages_desc").collect()] == [3, 2, 1]


@pytest.mark.parametrize("text,year", [("1e3", 1000), ("12.0", 12), ("0x10", 16), ("-3", None), ("1.5", None), ("", None), ("x", None)])
def test_year_parameters(text, year):
    assert C.year_param(text) == year


def test_json_is_found_in_prose(spark):
    assert value(spark, lambda: U.extract_json(F.lit('see {x} then {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert value(spark, lambda: U.extract_json(F.lit("nothing"))) is None


def test_json_objects_nest_and_fail(spark):
    cases = {'{"a": {"b"': None, '{bad {"k": [1, {"z": "}"}]} {"l": 2}': '{"k": [1, {"z": "}"}]}', "```json\n{}\n```": "{}", "": None, '[{"é": null}]': '{"é": null}'}
    for text, want in cases.items():
        assert value(spark, lambda t=text: U.extract_json(F.lit(t))) == want
    assert value(spark, lambda: U.extract_json(F.lit(None).cast("string"))) is None


def repair(spark, source, log):
    return value(spark, lambda: L.repair_graphics(F.lit(source), F.lit(log)))


def test_graphics_repair(spark):
    source = "a\n\\includegraphics[width=3cm]{figs/a.png}\n% \\begin{tikzpicture}\n% \\draw;\n% \\end{tikzpicture}\n\\includegraphics{b.png}\n"
    fixed = repair(spark, source, "! File `a.png' not found. File `b.png' not found")
    assert "Restored TikZ fallback for missing graphic: a.png\n\\begin{tikzpicture}" in fixed
    assert "{0.8\\linewidth}" in fixed and "b.png}" not in fixed
    assert repair(spark, source, "fine") is None and repair(spark, source, None) is None and repair(spark, "", "File `a.png' not found") is None


def test_graphics_repair_line_by_line(spark):
    box = "\\fbox{\\parbox[c][8em][c]{%s}{\\centering\\footnotesize Source diagram unavailable}}\n"
    log = "File `x/a.png' not found\nfile 'B.EPS' NOT found"
    cases = [
        ("  \\includegraphics{x/a.png} % why", "  % Missing source graphic: a.png\n  " + box % "0.8\\linewidth"),
        ("\\includegraphics[scale=2, width = .5\\textwidth ,x]{c\\B.EPS}\nz", "% Missing source graphic: B.EPS\n" + box % ".5\\textwidth" + "z"),
        ("\\includegraphics{a.png}\n", None),  # the log misses x/a.png
        ("\\includegraphics{x/a.png} text\n% \\includegraphics{x/a.png}\n", None),
        ("\\includegraphics{x/a.png}\n\n% note\n  % \\begin{tikzpicture}\n%\n  %  \\draw;\nloose\n%\\end{tikzpicture} %\nend", "% Restored TikZ fallback for missing graphic: a.png\n  \\begin{tikzpicture}\n   \\draw;\nloose\n\\end{tikzpicture} %\nend"),
        ("\\includegraphics{x/a.png}\ntext\n% \\begin{tikzpicture}\n% \\end{tikzpicture}\n", "% Missing source graphic: a.png\n" + box % "0.8\\linewidth" + "text\n% \\begin{tikzpicture}\n% \\end{tikzpicture}\n"),
    ]
    for source, want in cases:
        assert repair(spark, source, log) == want, source


def test_compile_fix_takes_the_first_repair(spark):
    doc = lambda head, body: f"\\documentclass{{article}}\n{head}\\begin{{document}}\n{body}\n\\end{{document}}"
    fix = lambda source, log, compiler="pdflatex": value(spark, lambda: L.compile_fix(F.lit(source), F.lit(log), compiler))
    wrapped = doc("", "\\begin{wrapfigure}{r}{0.4\\textwidth}\n    \\includegraphics[width=0.3\\textwidth]{diagram.png}\n    % \\begin{tikzpicture}[scale=1.2]\n    %   \\draw (0,0) -- (1,1);\n    % \\end{tikzpicture}\n\\end{wrapfigure}")
    got = fix(wrapped, "LaTeX Warning: File `diagram.png' not found on input line 4.\n")
    assert "\\usepackage{tikz}" in got and "    \\begin{tikzpicture}[scale=1.2]\n      \\draw" in got and "\\includegraphics" not in got
    assert "\\parbox[c][8em][c]{0.25\\textwidth}" in fix(doc("", "\\includegraphics[width=0.25\\textwidth]{missing.png}"), "File `missing.png' not found on input line 3.")
    assert "\\usepackage{amssymb}" in fix(doc("", "$\\mathbb R$"), "missing $ inserted")
    assert fix(doc("", "a \\cdot b $\\cdot$"), "! Missing $ inserted.") == doc("", "a $\\cdot$ b $\\cdot$")
    micro = "\\usepackage{x,microtype}\n"
    assert fix(doc(micro, "a"), "pdfTeX error (font expansion)") == doc("\\usepackage{x,microtype}\n\\microtypesetup{expansion=false}\n", "a")
    assert fix(doc("\\RequirePackage{microtype}\n", "a"), "Font Expansion") == doc("\\RequirePackage{microtype}\n\\microtypesetup{expansion=false}\n", "a")
    assert fix(doc(micro, "a"), "font expansion", "xelatex") is None and fix(doc("", "a"), "font expansion") is None
    lost = "fontspec error: the font cannot be found"
    assert fix(doc("\\setmainfont{Batang}\n\\setmainfont{B}\n", "a"), lost, "xelatex") == doc("\\setmainfont{Malgun Gothic}\n\\setmainfont{B}\n", "a")
    assert fix(doc("\\usepackage{kotex}\n", "a"), lost, "xelatex") == doc("\\usepackage{kotex}\n\\setmainfont{Malgun Gothic}\n", "a")
    assert fix(doc("", "a"), lost, "xelatex") is None and fix(doc("", "a"), None) is None


def test_prepare_latex_by_compiler(spark):
    doc = lambda body, head="": f"\\documentclass{{article}}\n{head}\\begin{{document}}\n{body}\n\\end{{document}}\n"
    prepare = lambda source, compiler="pdflatex": value(spark, lambda: X.prepare_latex(F.lit(source), compiler))
    s = "compo\u017f\u00e9"
    declared = "\\usepackage{textcomp}\n\\DeclareTextSymbol{\\textlongs}{TS1}{116}\n\\DeclareTextSymbolDefault{\\textlongs}{TS1}\n\\DeclareUnicodeCharacter{017F}{\\textlongs}\n"
    assert prepare(doc(s)) == doc(s, declared).rstrip("\n") and prepare(doc(s, declared)) == doc(s, declared).rstrip("\n")
    assert prepare(doc(s, declared), "xelatex") == doc(s, declared.rsplit("\\Declare", 1)[0]).rstrip("\n")
    assert "\\providecommand{\\longequal}{=}" in prepare(doc("$a \\longequal b$"), "xelatex")
    assert prepare(doc("$\\longequal$", "\\newcommand{\\longequal}{=}\n")).count("longequal") == 2
    got = prepare(doc("$a \\coloneqq b, c \\eqqcolon d$"))
    assert "{\\coloneqq}{\\mathrel{:=}}\n\\providecommand{\\eqqcolon}{\\mathrel{=:}}\n\\providecommand{\\Coloneqq}{\\mathrel{::=}}\n\\providecommand{\\Eqqcolon}{\\mathrel{=::}}\n\\begin{document}" in got
    for body, package in (("\\begin{align*}x\\end{align*}", "amsmath"), ("\\tag 1", "amsmath"), ("$\\varnothing$", "amssymb"), ("$\\mathscr{L}$", "mathrsfs"), ("\\begin{tikzpicture}", "tikz"), ("\\begin{wraptable}", "wrapfig"), ("\\scalebox{2}{x}", "graphicx")):
        assert f"\\usepackage{{{package}}}\n\\begin{{document}}" in prepare(doc(body), "xelatex")
        assert prepare(doc(body, f"\\usepackage[a]{{b,{package}}}\n")).count("usepackage") == 1
    assert "amsmath" not in prepare(doc("\\textbf{x} \\begin{pmatrix}"))


def test_latex_pages_round_trip(spark):
    doc = "\\documentclass{a}\n\\begin{document}\none\n\n\\newpage\n\ntwo\n\\end{document}"
    pages = value(spark, lambda: X.split_pages(F.lit(doc)))
    assert len(pages) == 2 and pages[1].endswith("\ntwo\n\\end{document}")
    merged = value(spark, lambda: X.merge_pages(X.split_pages(F.lit(doc))))
    assert value(spark, lambda: X.split_pages(F.lit(merged))) == pages
    assert value(spark, lambda: X.merge_pages(F.array(F.lit("x")))) == "x"


def test_prepare_latex(spark):
    got = value(spark, lambda: X.prepare_latex(F.lit("```latex\n\\documentclass{a}\n\\begin{document}\n\\footnote[†]{x} 3\\cdot5 \\mathbb R\n```")))
    assert "\\footnote[2]{x}" in got and "3$\\cdot$5" in got and "\\usepackage{amssymb}\n\\begin{document}" in got and got.rstrip().endswith("\\end{document}")


def test_queue_skips_second_of_a_slug(spark):
    rows = [("b_dir", "n", "same", 7), ("a_dir", "n", "same", 7), ("c_dir", None, "other", 7), ("d_dir", "n", "late", 8)]
    df = spark.createDataFrame(rows, "folder string, name string, slug string, priority_rank int")
    got = {r.folder: r.status for r in P.queue(df).collect()}
    assert got == {"a_dir": "queued", "b_dir": "skipped_duplicate_slug", "c_dir": "skipped_unresolved_name", "d_dir": "queued"}
    assert set(r.folder for r in P.queue(df, 1).collect()) == {"a_dir"}


def test_scan_takes_folders_of_the_root_alone(spark, tmp_path):
    for path in ("out/a/x.json", "out/x/out/b.json", "out+1/c/y.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("{}")
    found = lambda root: sorted((r.folder, r.path) for r in A.scan(spark, str(tmp_path / root)).collect())
    assert found("out") == [("a", "x.json"), ("x", "out/b.json")] and found("out/x/out") == []
    assert found("out+1") == [("c", "y.json")] and found("none") == []


def test_override_files(spark):
    values = lambda json: spark.range(1).select(*(c.alias(f) for f, c in B.override_values(F.lit(json)).items())).first().asDict()
    held = {k: v for k, v in values('{"overrides": {"title": " T ", "publication_year": "c. 1704", "doi": " ", "x": 1}, "title": "outer"}').items() if v is not None}
    assert held == {"title": "T", "publication_year": 1704}
    assert {k: v for k, v in values('{"title": "bare", "overrides": 3}').items() if v is not None} == {"title": "bare"}
    for bad in ("[]", "no", "", None):
        assert set(values(bad).values()) == {None}
    named = spark.range(1).select(*(c.alias(f) for f, c in B.override_of_arguments({"author": F.lit(" A "), "death_year": F.lit("99")}).items())).first()
    assert (named.author, named.death_year, named.title) == ("A", None, None)


def test_upsert_merges_by_column(spark):
    now = spark.createDataFrame([(1, "a", "x", "kept"), (2, "b", "y", "kept")], "id long, slug string, title string, made string")
    new = spark.createDataFrame([("b", "first", 1), ("b", "last", 2), ("c", "new", 3)], "slug string, title string, n int")
    got = sorted(tuple(r) for r in P.upsert(now, new, "slug", "n").collect() if r.id)
    assert got == [(1, "a", "x", "kept"), (2, "b", "last", "kept")]
    assert [tuple(r) for r in P.upsert(now, new, "slug", "n").where("id IS NULL").collect()] == [(None, "c", "new", None)]
    assert P.upsert(now, new.limit(0), "slug").count() == 2


def test_numbers_follow_the_order(spark):
    rows = [(i, (i * 7919) % 500 if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    got = {r.id: r.n for r in numbered(df, [F.col("v").isNull(), F.col("v"), F.col("id")], "n").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {r[0]: n for n, r in enumerate(want, 1)} and numbered(df.limit(0), [F.col("id")], "n").count() == 0


def test_translation_groups(spark):
    pages = lambda n: value(spark, lambda: N.page_groups(F.array(*[F.lit(str(i)) for i in range(n)]), 4))
    assert pages(4) == [["0", "1", "2", "3"]] and pages(5) == [["0", "1", "2", "3"], ["4"]] and pages(9)[2] == ["8"]


def test_margins_of_a_page(spark):
    page = np.full((200, 100), 255, np.uint8)
    page[20:150, 10:80] = 0
    page[0, :3] = 0  # a speck is no ink
    blank = np.full((10, 10), 215, np.uint8)
    rows = [(1, page.tobytes(), 100, 200), (2, blank.tobytes(), 10, 10), (3, None, 1, 1), (4, b"x", 5, 5)]
    df = spark.createDataFrame([(i, bytearray(p) if p is not None else None, w, h) for i, p, w, h in rows], "id int, pixels binary, w int, h int")
    got = {r.id: tuple(r.m) for r in df.select("id", margins("pixels", "w", "h").alias("m")).collect()}
    assert got[1] == pytest.approx((0.10, 0.20, 0.10, 0.25)) and all(m is None or m != m for i in (2, 3, 4) for m in got[i])


def test_pages_are_reduced_before_they_are_measured(spark):
    from foliant.operators.layout import THUMBNAIL, reduced

    page = np.full((4000, 2400), 255, np.uint8)
    page[400:3000, 240:2040] = 0
    small = reduced(page)
    assert small.shape == (800, 480) and (small[81:599, 49:407] == 0).all() and (small[:79] == 255).all()
    wide = np.arange(7 * 5000, dtype=np.int64).reshape(7, 5000) % 251
    assert reduced(wide.astype(np.uint8)).shape == (1, 600) and reduced(page[:10, :10]).shape == (10, 10) and reduced(page[:, :1]).shape == (800, 1)
    assert all(a <= b for a, b in zip(reversed(small.shape), THUMBNAIL))
    df = spark.createDataFrame([(bytearray(page.tobytes()), 2400, 4000)], "pixels binary, w int, h int")
    assert tuple(df.select(margins("pixels", "w", "h").alias("m")).first().m) == pytest.approx((0.10, 0.15, 0.10, 0.25), abs=0.003)


def test_parameters_of_a_request():
    assert [C.first_param(v) for v in (None, "", "x", [], ["a", "b"], ("c",))] == ["", "", "x", "", "a", "c"]
    assert [C.sort_param(v) for v in (None, "", "title", "TITLE", "pages_desc", "newest")] == ["recent", "recent", "title", "recent", "pages_desc", "recent"]


def test_conflict_policy():
    assert P.conflict_policy(" SKIP ") == "skip" and P.conflict_policy(None) == "overwrite"
    with pytest.raises(ValueError):
        P.conflict_policy("merge")


def test_folder_scan(spark, tmp_path):
    from foliant.operators import operations as O

    root = tmp_path / "outputs"
    (root / "one" / "images").mkdir(parents=True)
    (root / "one" / "n_quality_report.json").write_text('{"paper_name": "P", "total_pages": 2, "transcription": {"failed_pages": [4]}}')
    (root / "one" / "page_001.tex").write_text("x")
    (root / "one" / "images" / "page_001.png").write_bytes(b"png")
    (root / "one" / "n_Korean.log").write_text("Overfull \\hbox\nnoise")
    found = A.scan(spark, str(root))
    assert {r.path for r in found.collect()} == {"n_quality_report.json", "page_001.tex", "images/page_001.png", "n_Korean.log"}
    assert A.page_numbers(found).first()["pages"] == [1]
    assert {r.asset_type for r in A.publishable(found, F.lit("n")).collect()} == {"quality_report", "page_tex", "page_image"}
    s = O.summary(A.texts(found), "2025-01-01 00:00:00").first()
    assert (s.folder, s.title, s.failed_pages, s.compile_warning_count, s.next_action) == ("one", "P", [4], 1, "Retry failed pages")
    assert A.scan(spark, str(tmp_path / "absent")).count() == 0
    assert A.last_updated(found).first()["updated_at"]


def test_entry_works_without_llm():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"browse_catalog", "ops_summary"} <= names and set(entry.oracle_sql()) <= names


def test_the_rest_stands_without_llm(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "foliant"), tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and not [k for k in q if k.startswith('op') and k[2].isdigit()] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_tables_can_be_made(spark, tmp_path):
    from foliant.sources import schema

    for name in schema.TABLES:
        df = schema.empty(spark, name)
        assert df.count() == 0 and set(schema.KEYS[name]) <= set(df.columns)
    schema.write_table(schema.empty(spark, "authors"), str(tmp_path / "authors"))
    assert spark.read.parquet(str(tmp_path / "authors")).columns == schema.empty(spark, "authors").columns


def test_rights_context_and_log_tail(spark):
    got = value(spark, lambda: R.rights_context(F.lit(None).cast("string"), F.lit(1900), F.lit(None).cast("int"), R.assess_rights(F.lit(None).cast("string"), F.lit(1900), F.lit(None).cast("int"), {f: F.lit(None).cast("string") for f in R.RIGHTS_FIELDS}, 2025)))
    assert got.startswith("RIGHTS CONTEXT:\n- author: None\n- publication_year: 1900\n") and got.endswith("treat faithful transcription as permitted.\n")
    assert value(spark, lambda: P.log_tail(F.lit("a\nb\nc"), 2)) == "b\nc" and value(spark, lambda: P.log_tail(F.lit("a"), 200)) == "a"

"""Text, path and page functions over the test tables, and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import repair as R
from foliant.functions import text as X
from foliant.functions import udfs as U
from foliant.sources.adapters import catalog, with_catalog


def lit(s: str) -> str:
    """A string as SQL that Spark and DuckDB read alike."""
    s = s.replace("'", "''").replace("\\", "' || chr(92) || '").replace("\n", "' || chr(10) || '")
    return f"('{s}')".replace("{", "{{").replace("}", "}}")


_TEX = f"""SELECT doc_id, text, {lit(chr(92) + 'documentclass[12pt,a4paper]{article}' + chr(10) + chr(92) + 'usepackage{geometry}' + chr(10) + '% draft' + chr(10) + chr(92) + 'begin{document}')}
  || {lit(chr(10) + chr(92) + 'section{')} || substr(split_part(text, chr(10), 1), 1, 40) || {lit('}' + chr(10))} || replace(text, chr(10), {lit(chr(10) + ' ' + chr(92) + 'newpage ' + chr(10))})
  || {lit(chr(10) + chr(92) + 'noindent ' + chr(92) + 'textbf{bold} 3' + chr(92) + 'cdot5 {x}  y' + chr(92) * 2 + 'z ' + chr(92) + 'footnote[*]{n}' + chr(10) * 4)}
  || CASE WHEN doc_id % 7 = 0 THEN '' ELSE {lit(chr(92) + 'end{document}' + chr(10))} END AS tex FROM {{documents}}"""
_MODEL = f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '%%% BEGIN_LATEX %%%' || chr(10) || text || chr(10) || '%%% END_LATEX %%%' WHEN 1 THEN 'so: %%%  BEGIN_LATEX %%% ' || text
  WHEN 2 THEN 'see' || chr(10) || '```latex' || chr(10) || text || chr(10) || '```' WHEN 3 THEN text ELSE '```' || chr(10) || {lit(chr(92) + 'begin{document}')} || text || chr(10) || '```' END AS answer FROM {{documents}}"""
_VALUES = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN '1499' WHEN 3 THEN concat('Printed in ', cast(1400 + doc_id % 800 AS string), '.') WHEN 4 THEN concat(' ', cast(1490 + doc_id % 700 AS string), ' ') ELSE concat(' Some  Name ', source, ' ') END AS v FROM {documents}"""
_LOGS = f"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN {lit('Overfull ' + chr(92) + 'hbox (3pt too wide)')} WHEN 1 THEN {lit('  Underfull ' + chr(92) + 'hbox (badness 10)')} WHEN 2 THEN 'Missing character: There is no x' WHEN 3 THEN concat('Package hyperref Warning: Token not allowed ', text, ' on input line ', cast(doc_id AS string), '.')
  WHEN 4 THEN concat('LaTeX Warning: Reference undefined on input line ', cast(doc_id AS string), '.') WHEN 5 THEN 'Package babel Info: The file is missing' WHEN 6 THEN '' ELSE text END AS line FROM {{documents}}"""
_PATHS = """SELECT doc_id, concat('Doc ', cast(doc_id AS string)) AS name, CASE doc_id % 12 WHEN 0 THEN concat('doc ', cast(doc_id AS string), '_Source.PDF') WHEN 1 THEN concat('Doc ', cast(doc_id AS string), '_Korean.tex') WHEN 2 THEN 'images/page_001.png' WHEN 3 THEN 'images/extra/Über scan.PNG' WHEN 4 THEN 'page_012.tex' WHEN 5 THEN 'page_012_structure.json'
  WHEN 6 THEN 'page_012_failure.json' WHEN 7 THEN 'page_12.tex' WHEN 8 THEN 'notes/Final Report (v2).tar.json' WHEN 9 THEN concat('Doc ', cast(doc_id AS string), '_quality_report.json') WHEN 10 THEN 'a//b c.txt' ELSE concat('Doc ', cast(doc_id AS string), '_translation_notes.txt') END AS path FROM {documents}"""
_RANGES = """SELECT doc_id, cast(1 + doc_id % 9 AS int) AS n, CASE doc_id % 4 WHEN 0 THEN '1-3,5' WHEN 1 THEN '4, 2 ,7' WHEN 2 THEN '5-2,1' ELSE concat(cast(doc_id % 5 AS string), '-', cast(doc_id % 9 AS string), ',,2') END AS spec FROM {documents}"""


def _of(sql: str):
    def make(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")))

        return run

    return make


def _sql(base: str, select: str) -> str:
    return f"WITH t AS ({base.format(documents='documents')}) {select}"


def _one(f, name: str, *cols: str):
    return lambda df: df.select("doc_id", *cols, f().alias(name))


_tex, _model, _values, _logs, _paths, _ranges = map(_of, (_TEX, _MODEL, _VALUES, _LOGS, _PATHS, _RANGES))
_c = F.col


def _pages():
    return F.transform(F.sequence(F.lit(1), (_c("doc_id") % 7 + 1).cast("int")), lambda i: (i * 3 - _c("doc_id") % 4).cast("string"))


def _strs():
    return F.split(F.concat_ws(",", F.lit("3, 2,x,-1,0,2,7"), (_c("doc_id") % 9).cast("string"), F.lit("1.5")), ",")


def _layout(df: DataFrame) -> DataFrame:
    from foliant.operators.layout import layout_profile

    sized = df.select("doc_id", F.explode(F.sequence(F.lit(1), (_c("doc_id") % 5 + 1).cast("int"))).alias("page"))
    sized = sized.select("doc_id", (380.0 + (_c("doc_id") * 37 + _c("page") * 11) % 200).alias("width"), (560.0 + (_c("doc_id") * 53 + _c("page") * 17) % 220).alias("height"),
        *(F.when(_c("doc_id") % 3 != 0, (_c("doc_id") * m + _c("page") * 3) % 25 / 100.0).alias(s) for m, s in ((7, "left"), (11, "right"), (13, "top"), (17, "bottom"))))
    return layout_profile(sized, "doc_id")


QUERIES = {
    "clean_text": _values(_one(lambda: X.clean_text(_c("v")), "cleaned", "v")),
    "coerce_year": _values(_one(lambda: X.coerce_year(_c("v")), "year", "v")),
    "sort_name": _values(_one(lambda: X.sort_name(_c("v")), "name", "v")),
    "century_label": lambda s, d: catalog(s, d).select("id", X.century_label(_c("publication_year") - _c("id").cast("int") % 3 * 1000).alias("label")),
    "era_id": lambda s, d: catalog(s, d).select("id", X.era_id(F.coalesce("century_label", F.lit("--"))).alias("era")),
    "ascii_fold": _tex(_one(lambda: U.ascii_fold("text"), "folded")),
    "slugify": lambda s, d: catalog(s, d).select("id", X.slug_of_folded(U.ascii_fold(F.when(_c("id") % 50 == 0, F.lit("  ")).when(_c("id") % 50 == 1, F.lit("日本")).otherwise(_c("title"))), F.when(_c("id") % 50 == 0, F.lit("  ")).when(_c("id") % 50 == 1, F.lit("日本")).otherwise(_c("title"))).alias("slug")),
    "is_latex": _model(_one(lambda: X.is_latex(_c("answer")), "latex")),
    "latex_to_text": _tex(_one(lambda: X.latex_to_text(_c("tex")), "readable")),
    "split_pages": _tex(lambda df: df.select("doc_id", F.posexplode(X.split_pages(_c("tex"))).alias("place", "page"))),
    "merge_pages": _tex(_one(lambda: X.merge_pages(X.split_pages(_c("tex"))), "merged")),
    "normalize_latex": _model(_one(lambda: X.normalize_latex(_c("answer")), "source")),
    "extract_block": _model(_one(lambda: X.extract_block(_c("answer"), "BEGIN_LATEX"), "block")),
    "prepare_latex": _tex(_one(lambda: X.prepare_latex(_c("tex")), "prepared")),
    "apply_layout": _tex(_one(lambda: X.apply_layout(_c("tex"), (_c("doc_id") % 3 + 10).cast("int"), F.lit("paperwidth=400bp"), F.lit("5.56in x 8in, 12pt")), "styled")),
    "plausible_fix": _tex(_one(lambda: X.plausible_fix(_c("tex"), F.substring(_c("tex"), F.lit(1), (F.length("tex") * (85 + _c("doc_id") % 15) / 100).cast("int"))), "plausible")),
    "missing_graphics": _tex(_one(lambda: R.repair_graphics(F.concat(_c("tex"), F.lit("\n\\includegraphics[width=3cm]{figs/a.png}\n")), F.when(_c("doc_id") % 2 == 0, "! File `a.png' not found.")), "repaired")),
    "compile_fix": _tex(_one(lambda: R.compile_fix(F.when(_c("doc_id") % 3 == 0, _c("tex")).otherwise(X.prepare_latex(_c("tex"))), F.when(_c("doc_id") % 2 == 0, "! Missing $ inserted.").otherwise(""), "pdflatex"), "fixed")),
    "extract_json": _model(_one(lambda: U.extract_json(F.concat(F.lit("Here {x} is: "), F.to_json(F.struct("doc_id", "answer")), F.lit(" done"))), "found")),
    "log_classify": _logs(_one(lambda: X.log_message(_c("line")), "message", "line")),
    "truncate": _logs(_one(lambda: X.truncate(F.coalesce(X.log_message(_c("line")), F.lit(""))), "short")),
    "asset_type": _paths(_one(lambda: X.asset_type(_c("path"), _c("name")), "kind", "path")),
    "storage_path": _paths(_one(lambda: X.storage_path(_c("path"), X.asset_type(_c("path"), _c("name")), U.ascii_fold("path")), "stored", "path")),
    "mime_type": _paths(_one(lambda: X.mime_type(_c("path")), "mime", "path")),
    "source_hash": _tex(_one(lambda: F.sha2(_c("text"), 256), "hash")),
    "parse_page_range": _ranges(_one(lambda: X.parse_page_range(_c("spec"), _c("n")), "places", "spec", "n")),
    "coerce_pages": _ranges(lambda df: df.select("doc_id", X.coerce_pages(_strs()).alias("ordered"), X.coerce_pages(_strs(), ordered=False).alias("seen"))),
    "sample_evenly": _ranges(_one(lambda: X.sample_evenly(_pages(), 4), "sample")),
    "chunked": _ranges(lambda df: df.select("doc_id", F.posexplode(_pages()).alias("p", "page")).groupBy("doc_id", F.floor(_c("p") / 3).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "page"))), lambda x: x["page"]).alias("pages"))),
    "page_names": _ranges(lambda df: df.select("doc_id", X.page_name(_c("n")).alias("tex"), X.page_name(_c("n"), "png").alias("png"))),
    "tex_length": _ranges(_one(lambda: X.tex_length(_c("doc_id") % 700 / 8.0, "bp"), "length")),
    "layout_profile": _ranges(_layout),
}

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_YEAR = "try_cast(nullif(regexp_extract(v, '\\b(1[5-9]\\d{2}|20\\d{2}|2100)\\b', 1), '') AS int)"
_FOLD = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"


def _ordinal_sql(n: str) -> str:
    return f"(cast({n} AS string) || CASE WHEN {n} % 100 IN (11, 12, 13) THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"


_TITLE = "CASE WHEN id % 50 = 0 THEN '  ' WHEN id % 50 = 1 THEN '日本' ELSE title END"
_SLUG = f"regexp_replace(regexp_replace(regexp_replace(lower({_STRIP.format(_FOLD.format('t'))}), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g')"
_BODY = r"CASE WHEN regexp_matches(tex, '(?s)\\begin\{document\}(.*?)\\end\{document\}') THEN regexp_extract(tex, '(?s)\\begin\{document\}(.*?)\\end\{document\}', 1) ELSE tex END"


def _readable() -> str:
    out = _BODY
    for pattern, to in X._READABLE:
        flags = "'g'"
        to = to.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{to}', {flags})"
    return _STRIP.format(out)


_SPLIT = r"""SELECT doc_id, tex, CASE WHEN regexp_matches(tex, '(?s)^(.*?\\begin\{document\})(.*)\\end\{document\}\s*$') THEN
  list_transform(list_filter(list_transform(regexp_split_to_array(regexp_extract(tex, '(?s)^(.*?\\begin\{document\})(.*)\\end\{document\}\s*$', 2), '\n\s*\\newpage\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
    lambda x: regexp_extract(tex, '(?s)^(.*?\\begin\{document\})', 1) || chr(10) || x || chr(10) || '\end{document}') ELSE [tex] END AS pages FROM t"""
_MESSAGE = r"""CASE WHEN starts_with(s, 'Overfull \hbox') THEN 'Overfull hbox' WHEN starts_with(s, 'Underfull \hbox') THEN 'Underfull hbox' WHEN starts_with(s, 'Missing character:') THEN 'Missing character'
  WHEN regexp_matches(s, '^Package (\S+) Warning:\s*(.+)$') THEN regexp_extract(s, '^Package (\S+) Warning:\s*(.+)$', 1) || ' warning: ' || trim(regexp_replace(regexp_extract(s, '^Package (\S+) Warning:\s*(.+)$', 2), '\s+on input line \d+\.?$', ''))
  WHEN regexp_matches(s, '^LaTeX Warning:\s*(.+)$') THEN 'LaTeX warning: ' || trim(regexp_replace(regexp_extract(s, '^LaTeX Warning:\s*(.+)$', 1), '\s+on input line \d+\.?$', ''))
  WHEN regexp_matches(s, '^Package (\S+) Info:\s*(.+ is missing)\s*$') THEN regexp_extract(s, '^Package (\S+) Info:\s*(.+ is missing)\s*$', 1) || ' info: ' || regexp_extract(s, '^Package (\S+) Info:\s*(.+ is missing)\s*$', 2) END"""
_WITH_S = f"SELECT *, {_STRIP.format('line')} AS s FROM t"
_KIND = "CASE " + " ".join(f"WHEN lower(path) = lower(name) || '{s}' THEN '{k}'" for s, (k, _) in X.NAMED_ASSETS.items()) + " WHEN starts_with(path, 'images/') THEN 'page_image' " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{k}'" for p, k in X.PAGE_ASSETS) + " ELSE 'artifact' END"
_STRS = "string_split(concat_ws(',', '3, 2,x,-1,0,2,7', cast(doc_id % 9 AS string), '1.5'), ',')"
_INTS = f"list_filter(list_transform({_STRS}, lambda x: CASE WHEN regexp_matches(x, '^\\s*[+-]?\\d+\\s*$') THEN try_cast(trim(x) AS int) END), lambda i: i > 0)"
_PAGES_SQL = "list_transform(range(1, doc_id % 7 + 2), lambda i: cast(i * 3 - doc_id % 4 AS string))"
_LEN = "regexp_replace(regexp_replace(printf('%.2f', doc_id % 700 / 8.0), '0+$', ''), '\\.$', '') || 'bp'"

ORACLE_SQL = {
    "clean_text": _sql(_VALUES, f"SELECT doc_id, v, nullif({_STRIP.format('v')}, '') AS cleaned FROM t"),
    "coerce_year": _sql(_VALUES, f"SELECT doc_id, v, CASE WHEN regexp_matches(v, '^\\s*[+-]?\\d+\\s*$') AND NOT try_cast(trim(v) AS int) BETWEEN 1500 AND 2100 THEN NULL ELSE {_YEAR} END AS year FROM t"),
    "sort_name": _sql(_VALUES, "SELECT doc_id, v, nullif(lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))), '') AS name FROM t"),
    "century_label": with_catalog(f"SELECT id, CASE WHEN y > 0 THEN {_ordinal_sql('((y - 1) // 100 + 1)')} || ' century' END AS label FROM (SELECT id, publication_year - id % 3 * 1000 AS y FROM catalog)"),
    "era_id": with_catalog("SELECT id, concat('era-', coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(century_label, '--')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'undated')) AS era FROM catalog"),
    "ascii_fold": f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents",
    "slugify": with_catalog(f"SELECT id, CASE WHEN trim(t) = '' THEN 'untitled-document' WHEN {_SLUG} = '' THEN 'document-' || substr(sha256(trim(t)), 1, 12) ELSE {_SLUG} END AS slug FROM (SELECT id, {_TITLE} AS t FROM catalog)"),
    "is_latex": _sql(_MODEL, "SELECT doc_id, contains(answer, '\\documentclass') OR contains(answer, '\\begin{document}') AS latex FROM t"),
    "latex_to_text": _sql(_TEX, f"SELECT doc_id, {_readable()} AS readable FROM t"),
    "split_pages": _sql(_TEX, f"SELECT doc_id, cast(unnest(range(len(pages))) AS int) AS place, unnest(pages) AS page FROM ({_SPLIT})"),
    "merge_pages": _sql(_TEX, rf"SELECT doc_id, CASE WHEN len(pages) = 1 THEN pages[1] ELSE regexp_extract(pages[1], '(?s)^.*?\\begin\{{document\}}') || chr(10) || array_to_string(list_transform(pages, lambda p: {_STRIP.format(chr(39).join(['regexp_replace(regexp_replace(p, ', '(?s)^.*?' + chr(92) * 2 + 'begin' + chr(92) + '{document' + chr(92) + '}', ', ', '', '), ', chr(92) * 2 + 'end' + chr(92) + '{document' + chr(92) + '}' + chr(92) + 's*$', ', ', '', ')']))}), chr(10) || chr(10) || '\newpage' || chr(10) || chr(10)) || chr(10) || '\end{{document}}' END AS merged FROM ({_SPLIT})"),
    "extract_block": _sql(_MODEL, "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(answer, '{p}') THEN {_STRIP.format(chr(39).join(['regexp_extract(answer, ', p, ', 1)']))}" for p in (r"(?s)%%%\s*BEGIN_LATEX\s*%%%(.*?)%%%\s*END_LATEX\s*%%%", r"(?s)%%%\s*BEGIN_LATEX\s*%%%(.*)$", r"(?is)```(?:latex)?\s*(.*?)```")) + " END AS block FROM t"),
    "normalize_latex": _sql(_MODEL, r"SELECT doc_id, CASE WHEN contains(s, '\begin{document}') AND NOT contains(s, '\end{document}') THEN s || chr(10) || chr(10) || '\end{document}' || chr(10) ELSE s END AS source FROM (SELECT doc_id, " + f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP.format('answer')}, '{X._WRAPPERS[0]}', ''), '{X._WRAPPERS[1]}', ''), '{X._WRAPPERS[2]}', ''), '{X._WRAPPERS[3]}', '') AS s FROM t)"),
    "plausible_fix": _sql(_TEX, f"SELECT doc_id, length({_STRIP.format('tex')}) > 0 AND length({_STRIP.format('substr(tex, 1, cast(floor(length(tex) * (85 + doc_id % 15) / 100) AS int))')}) >= floor(length({_STRIP.format('tex')}) * 0.9) AS plausible FROM t"),
    "log_classify": _sql(_LOGS, f"SELECT doc_id, line, {_MESSAGE} AS message FROM ({_WITH_S})"),
    "truncate": _sql(_LOGS, f"SELECT doc_id, CASE WHEN length(m) <= 96 THEN m ELSE rtrim(substr(m, 1, 93)) || '...' END AS short FROM (SELECT doc_id, coalesce({_MESSAGE}, '') AS m FROM ({_WITH_S}))"),
    "asset_type": _sql(_PATHS, f"SELECT doc_id, path, {_KIND} AS kind FROM t"),
    "mime_type": _sql(_PATHS, "SELECT doc_id, path, CASE lower(regexp_extract(path, '\\.([^.]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in X.MIME.items()) + " ELSE 'application/octet-stream' END AS mime FROM t"),
    "source_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "parse_page_range": _sql(_RANGES, "SELECT doc_id, spec, n, list_transform(list_filter(flatten(list_transform(list_filter(string_split(spec, ','), lambda p: trim(p) <> ''), lambda p: CASE WHEN contains(p, '-') THEN range(cast(trim(split_part(p, '-', 1)) AS int), cast(trim(split_part(p, '-', 2)) AS int) + 1) ELSE [cast(trim(p) AS bigint)] END)), lambda i: i >= 1 AND i <= n), lambda i: cast(i - 1 AS int)) AS places FROM t"),
    "coerce_pages": _sql(_RANGES, f"SELECT doc_id, list_sort(list_distinct({_INTS})) AS ordered, list_filter({_INTS}, lambda x, i: list_position({_INTS}, x) = i) AS seen FROM t"),
    "sample_evenly": _sql(_RANGES, f"SELECT doc_id, CASE WHEN len(p) <= 4 THEN p ELSE list_transform(list_sort(list_distinct(list_transform(range(4), lambda i: cast(round_even(i * (len(p) - 1) / 3.0, 0) AS int)))), lambda i: p[i + 1]) END AS sample FROM (SELECT doc_id, {_PAGES_SQL} AS p FROM t)"),
    "chunked": _sql(_RANGES, f"SELECT doc_id, cast((i - 1) // 3 AS bigint) AS chunk, list(x ORDER BY i) AS pages FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {_PAGES_SQL} AS p FROM t)) GROUP BY 1, 2"),
    "page_names": _sql(_RANGES, "SELECT doc_id, printf('page_%03d.tex', n) AS tex, printf('page_%03d.png', n) AS png FROM t"),
    "tex_length": _sql(_RANGES, f"SELECT doc_id, {_LEN} AS length FROM t"),
}

# What has fixed parts only, as SQL of those parts
_BS = "chr(92)"
_STORED = "CASE doc_id % 12 WHEN 0 THEN 'source.pdf' WHEN 1 THEN 'korean.tex' WHEN 3 THEN 'images/extra/uber-scan.png' WHEN 8 THEN 'notes/final-report-v2.tar.json' WHEN 9 THEN 'quality_report.json' WHEN 10 THEN 'a/b-c.txt' WHEN 11 THEN 'translation_notes.txt' ELSE path END"
_PREPARED = f"replace(replace(CASE WHEN contains(s, {_BS} || 'end{{document}}') THEN s ELSE s || chr(10) || chr(10) || {_BS} || 'end{{document}}' || chr(10) END, 'footnote[*]', 'footnote[1]'), '3' || {_BS} || 'cdot5', '3$' || {_BS} || 'cdot$5')"
_WITH_TEX = f"(SELECT *, {_STRIP.format('tex')} AS s FROM t)"
_SIDES = (("left", 7, 0.08, 0.17, 0.13, "w"), ("right", 11, 0.08, 0.17, 0.13, "w"), ("top", 13, 0.05, 0.12, 0.09, "h"), ("bottom", 17, 0.05, 0.12, 0.09, "h"))
_BP = lambda c: f"(regexp_replace(regexp_replace(printf('%.2f', {c}), '0+$', ''), '\\.$', '') || 'bp')"
_PAGE_SIZES = "SELECT doc_id, 380.0::DOUBLE + (doc_id * 37 + page * 11) % 200 AS width, 560.0::DOUBLE + (doc_id * 53 + page * 17) % 220 AS height, " + ", ".join(f"CASE WHEN doc_id % 3 <> 0 THEN (doc_id * {m} + page * 3) % 25 / 100.0::DOUBLE END AS {n}" for n, m, *_ in _SIDES) + " FROM documents, range(1, 6) r(page) WHERE page <= doc_id % 5 + 1"
ORACLE_SQL |= {
    "storage_path": _sql(_PATHS, f"SELECT doc_id, path, {_STORED} AS stored FROM t"),
    "prepare_latex": _sql(_TEX, f"SELECT doc_id, {_PREPARED} AS prepared FROM {_WITH_TEX}"),
    "compile_fix": _sql(_TEX, f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_PREPARED} WHEN doc_id % 7 = 0 THEN rtrim({_PREPARED}, chr(10)) END AS fixed FROM {_WITH_TEX}"),
    "apply_layout": _sql(_TEX, f"SELECT doc_id, replace(replace(tex, '[12pt,a4paper]', concat('[', doc_id % 3 + 10, 'pt,a4paper]')), {_BS} || 'begin{{document}}', {_BS} || 'geometry{{paperwidth=400bp}}' || chr(10) || '% Auto layout profile: 5.56in x 8in, 12pt' || chr(10) || {_BS} || 'begin{{document}}') AS styled FROM t".replace("{{", "{").replace("}}", "}")),
    "missing_graphics": _sql(_TEX, f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(tex, chr(10), '% Missing source graphic: a.png', chr(10), {_BS}, 'fbox{{', {_BS}, 'parbox[c][8em][c]{{3cm}}{{', {_BS}, 'centering', {_BS}, 'footnotesize Source diagram unavailable}}}}}}}}', chr(10)) END AS repaired FROM t".replace("{{", "{").replace("}}", "}")),
    "layout_profile": f"WITH p AS ({_PAGE_SIZES}), m AS (SELECT doc_id, round(median(width), 2) AS w, round(median(height), 2) AS h, count(\"left\") AS sampled, " + ", ".join(f'round(coalesce(greatest({a}, least({b}, median("{n}"))), {d}), 4) AS "{n}_"'.replace(f"coalesce(greatest({a}, least({b}, median(\"{n}\"))), {d})", f'CASE WHEN median("{n}") IS NULL THEN {d} ELSE greatest({a}, least({b}, median("{n}"))) END') for n, _, a, b, d, _ in _SIDES) + " FROM p GROUP BY 1) "
    "SELECT doc_id, w AS width_bp, h AS height_bp, round(w / 72, 2) AS width_in, round(h / 72, 2) AS height_in, cast(CASE WHEN w / 72 <= 5.9 AND h / 72 <= 8.6 THEN 12 WHEN w / 72 <= 6.4 OR h / 72 <= 9.2 THEN 11 ELSE 10 END AS int) AS font_size_pt, " + ", ".join(f'{n}_ AS "{n}"' for n, *_ in _SIDES) + ", concat_ws(',', 'paperwidth=' || " + _BP("w") + ", 'paperheight=' || " + _BP("h") + ", " + ", ".join(f"'{n}=' || " + _BP(f"cast(round(cast(cast({'h' if n in ('top', 'bottom') else 'w'} * {n}_ AS string) AS decimal(30, 16)), 2) AS double)") for n in ("top", "bottom", "left", "right")) + ", 'headheight=14pt') AS geometry_options, sampled FROM m",
}
ORACLE_SQL["extract_json"] = _sql(_MODEL, "SELECT doc_id, concat('{\"doc_id\": ', doc_id, ', \"answer\": ', cast(to_json(answer) AS string), '}') AS found FROM t")

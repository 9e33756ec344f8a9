"""Bundles, their merge into the archive, override files and metadata context over relations derived from the test tables,
and their DuckDB SQL."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions import text as X
from foliant.functions import udfs as U
from foliant.operators import bundle as B
from foliant.operators import catalog as C
from foliant.operators import snapshot
from foliant.plans import catalog as PC
from foliant.plans import metadata as M
from foliant.sources import artifacts as A
from foliant.sources.adapters import catalog, with_catalog
from foliant.streaming.paths import held, scratch

AS_OF, AT = 2025, "2025-01-01T00:00:00"

#: An output folder of each document: its reports and LaTeX sources. A page is a line of plain letters.
OUTPUTS = r"""SELECT doc_id, concat('out-', cast(doc_id AS string)) AS folder, concat('n', cast(doc_id AS string)) AS name,
  CASE WHEN doc_id % 3 <> 0 THEN concat('{{"effective_metadata": {{"title": "Paper ', cast(doc_id % 50 AS string), '", "author": "Ann  Lee', cast(doc_id % 5 AS string), '", "publication_year": ', cast(1500 + doc_id % 520 AS string), ', "language": "French", "pages": "1-9"}}, "rights_sources": {{"author": "pdf"}}, "ai_inference": {{"doi": "x"}}}}') END AS metadata,
  CASE WHEN doc_id % 4 = 1 THEN '{{"successful_pages": [1, "2", 2, 0], "requested_pages": [1, 2, 3]}}' WHEN doc_id % 4 = 2 THEN '{{"successful_pages": []}}' WHEN doc_id % 4 = 3 THEN 'broken' END AS state,
  CASE WHEN doc_id % 9 = 0 THEN '{{"publication_year": "printed 1620", "assessment": "old"}}' END AS rights, CASE WHEN doc_id % 8 = 0 THEN '{{"font_size_pt":12}}' END AS layout,
  CASE WHEN doc_id % 5 = 0 THEN concat('{{"overrides": {{"title": " Set ', cast(doc_id % 20 AS string), ' ", "publication_year": "in 1801", "doi": ""}}}}') WHEN doc_id % 5 = 1 THEN '[]' END AS override,
  CASE WHEN doc_id % 6 = 0 THEN concat('{{"title": "  Pdf T', cast(doc_id % 30 AS string), ' ", "author": " "}}') END AS pdf,
  CASE WHEN doc_id % 10 <> 9 THEN concat(chr(92), 'documentclass{{x}}', chr(10), chr(92), 'begin{{document}}', chr(10), replace(plain, chr(10), concat(chr(10), chr(10), chr(92), 'newpage', chr(10), chr(10))), chr(10), chr(92), 'end{{document}}') END AS digitalized,
  CASE WHEN doc_id % 11 <> 10 THEN concat(chr(92), 'documentclass{{x}}', chr(10), chr(92), 'begin{{document}}', chr(10), 'K ', replace(plain, chr(10), concat(chr(10), chr(10), chr(92), 'newpage', chr(10), chr(10), 'K ')), chr(10), chr(92), 'end{{document}}') END AS korean,
  sha2 AS source_hash FROM {texts}"""
FILES = r"""SELECT concat('out-', cast(doc_id AS string)) AS folder, concat('n', cast(doc_id AS string), '_source.pdf') AS relative_path, 'source_pdf' AS asset_type, cast(10 AS bigint) AS byte_size, 'application/pdf' AS mime_type FROM {documents} WHERE doc_id % 2 = 0
  UNION ALL SELECT concat('out-', cast(doc_id AS string)), 'notes/Over View.txt', 'artifact', cast(11 AS bigint), 'text/plain' FROM {documents} WHERE doc_id % 4 = 0
  UNION ALL SELECT concat('out-', cast(doc_id AS string)), concat('images/page_00', cast(n AS string), '.png'), 'page_image', cast(12 AS bigint), 'image/png' FROM {documents}, {numbers} WHERE (doc_id + n) % 3 <> 0
  UNION ALL SELECT concat('out-', cast(doc_id AS string)), concat('page_00', cast(n AS string), '.tex'), 'page_tex', cast(13 AS bigint), 'text/x-tex' FROM {documents}, {numbers} WHERE n <= doc_id % 3 + 1"""


#: What makes a text lines of plain letters, none of them blank: pattern and replacement, in their order.
_PLAINLY = (("[^A-Za-z \\n]", ""), ("\\n[ \\n]*\\n", "\\n"), ("^[ \\n]+|[ \\n]+$", ""))


def plain(c: Column) -> Column:
    for pattern, to in _PLAINLY:
        # Letters one by one: Java looks single characters up in a table, and asks ranges in turn.
        c = F.regexp_replace(c, pattern.replace("A-Za-z", ascii_letters), to.replace("\\n", "\n"))
    return c


def plain_sql(c: str) -> str:
    for pattern, to in _PLAINLY:
        c = f"regexp_replace({c}, '{pattern}', {'chr(10)' if to else chr(39) * 2}, 'g')"
    return c


def outputs(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    texts = docs.select("doc_id", plain(F.col("text")).alias("plain"), F.sha2("text", 256).alias("sha2"))
    title = F.when(F.col("doc_id") % 12 == 9, F.concat(F.lit("First "), F.col("doc_id").cast("string")))
    structure = F.when(title.isNotNull(), F.struct(title.alias("title"), F.lit("Max Weber").alias("author"), F.lit(1650).alias("publication_year"), F.lit(None).cast("int").alias("death_year")))
    found = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")))
    return s.sql(OUTPUTS, texts=texts).withColumns({"structure": structure, "found": found}).drop("doc_id")


def existing(s: SparkSession, d: str) -> DataFrame:
    return B.existing(outputs(s, d), AS_OF)


def bundles(s: SparkSession, d: str) -> dict[str, DataFrame]:
    numbers = s.createDataFrame([(1,), (2,), (3,)], "n int")
    return B.assembled(held(existing(s, d), "outputs"), s.sql(FILES, documents=s.read.parquet(f"{d}/documents.parquet").select("doc_id"), numbers=numbers), AT)


def _archive(s: SparkSession, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An archive that holds ten of the papers and two authors already, each with a page, an asset, a snapshot and a link."""
    n = s.range(10)
    one = lambda t: n.select((F.col("id") + 1).alias("document_id"), *[F.lit("old" if k == "string" else 7).cast(k).alias(c) for c, k in new[t].drop("folder", "slug", "relative_path").dtypes])
    docs = n.select((F.col("id") + 1).alias("id"), F.concat(F.lit("paper-"), (F.col("id") * 4).cast("string")).alias("slug"), F.lit("kept").alias("created_by"), *[F.lit(None).cast(k).alias(c) for c, k in new["documents"].drop("folder", "slug").dtypes])
    authors = s.createDataFrame([(5, "ann lee1", "Old", 1600, None), (6, "nobody", "Nobody", None, None)], "id long, sort_name string, display_name string, birth_year int, death_year int")
    links = n.select((F.col("id") + 1).alias("document_id"), F.lit(6).cast("long").alias("author_id"), F.lit(1).alias("ordinal"))
    return {"documents": docs, "authors": authors, "document_authors": links, "document_pages": one("pages"), "document_assets": one("assets"), "document_metadata_snapshots": one("snapshots")}


def _shared(new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Bundles with those in tables that all six tables of the archive are made from; the others are used in one of them, if at all."""
    return new | {k: held(new[k], k) for k in ("documents", "authors")}


def published(s: SparkSession, d: str, policy: str = "overwrite") -> dict[str, DataFrame]:
    new = _shared(bundles(s, d))
    return B.published(_archive(s, new), new, policy)


def _versioned(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The archive as readers have it after two versions of its six tables, the second made from the first."""
    root, new = scratch(s, "archive"), _shared(bundles(s, d))
    snapshot.publish(_archive(s, new), root)
    snapshot.publish(B.published(snapshot.read(s, root), new, hold=lambda df: held(df, "published")), root)
    return snapshot.read(s, root)


def _ov(s: SparkSession, d: str) -> DataFrame:
    return outputs(s, d).select("folder", *(c.alias(f) for f, c in B.override_values(F.col("override")).items()))


def _saved(s: SparkSession, d: str) -> DataFrame:
    new = {f: F.lit(None).cast("int" if f in R.YEARS else "string") for f in R.FIELDS} | {"author": F.when(F.col("folder").endswith("5"), F.lit("New Author"))}
    return outputs(s, d).select("folder", B.override_json(B.merged_override(B.override_values(F.col("override")), new), AT).alias("content"))


def _form(s: SparkSession, d: str) -> DataFrame:
    state = F.lit('{"author": "State Author", "death_year": 1700}')
    return outputs(s, d).select("folder", *(c.alias(f) for f, c in B.form_metadata(F.col("metadata"), F.col("override"), F.col("rights"), F.when(F.col("folder").endswith("3"), state)).items()))


def _context(s: SparkSession, d: str) -> DataFrame:
    i = F.regexp_extract("folder", r"(\d+)$", 1).cast("long")
    report = F.when(i % 3 != 0, F.lit('{"raw_pdf_metadata":{"title":"Old"},"deterministic_inference":{"title":"T"},"ai_inference":{"doi":" 10.1 ","confidence":{"doi":"HIGH"}}}'))
    got = B.metadata_context(F.col("pdf"), report, F.col("override"), i % 2 == 0, i % 5 == 0)
    return outputs(s, d).select("folder", got.alias("c")).select("folder", "c.reused", "c.raw_pdf_metadata", "c.manual_override", F.get_json_object("c.ai_inference", "$.doi").alias("ai_doi"), F.get_json_object("c.ai_inference", "$.confidence.doi").alias("ai_sure"), F.get_json_object("c.deterministic_inference", "$.title").alias("structure_title"))


def _report(s: SparkSession, d: str) -> DataFrame:
    made = B.metadata_report(F.concat(F.lit("n"), F.col("doc_id").cast("string")), M._parts(), M._cols("ov", R.FIELDS), AT)
    df = M._docs(s, d, M._META).select("doc_id", made.alias("r"))
    keys = F.array_sort(F.json_object_keys("r"))
    get = lambda p: F.get_json_object("r", f"$.{p}")
    return df.select("doc_id", keys.alias("keys"), get("paper_name").alias("name"), *(get(f"effective_metadata.{f}").alias(f"e_{f}") for f in ("title", "author", "doi")), get("effective_sources.title").alias("title_source"), *(get(f"rights_metadata.{f}").alias(f"r_{f}") for f in R.RIGHTS_FIELDS), get("rights_sources.author").alias("author_source"))


def _rights(s: SparkSession, d: str) -> DataFrame:
    return existing(s, d).select("folder", B.rights_report(F.col("effective.author"), F.col("effective.publication_year"), F.col("effective.death_year"), {f: F.when(F.lit(f) == "author", F.lit("pdf")) for f in R.RIGHTS_FIELDS}, AS_OF, AT).alias("report"))


def _embedded(s: SparkSession, d: str) -> DataFrame:
    return outputs(s, d).select("folder", B.embedded_metadata(F.col("pdf")).alias("e")).select("folder", "e.title", "e.author", "e.modDate")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    images = F.transform(F.sequence(F.lit(1), (i % 4 + 1).cast("int")), lambda n: F.format_string("page_%03d.png", n))
    return B.page_jobs(s.read.parquet(f"{d}/documents.parquet").select(i.alias("document_id"), F.sequence(F.lit(3), (i % 3 + 3).cast("int")).alias("numbers"), images.alias("images")))


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Files of output folders with the times at which they changed."""
    i = F.col("doc_id")
    names = F.array(F.lit("page_002.tex"), F.when(i % 2 == 0, "page_001.tex"), F.when(i % 3 == 0, "page_1.tex"), F.lit("page_0100.tex"), F.when(i % 5 != 0, F.concat(F.lit("n"), i.cast("string"), F.lit("_quality_report.json"))), F.when(i % 7 == 0, "n_pipeline_state.json"), F.lit("sub/n_metadata.json"))
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("out-"), i.cast("string")).alias("folder"), F.posexplode(F.filter(names, lambda x: x.isNotNull())).alias("n", "path"))
    return rows.select("folder", "path", F.timestamp_seconds(F.lit(1_700_000_000) + i * 10 + F.col("n")).alias("modified"))


def _inferred(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, "no").when(i % 3 == 1, F.concat(F.lit('so: {"title": " T'), i.cast("string"), F.lit('", "publication_year": "c. 1704", "confidence": {"title": "HIGH"}}'))).otherwise("{}")
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", U.extract_json(answer).alias("found"), F.when(i % 5 == 0, " timeout ").alias("failure"))
    got = R.inference(F.col("found"), F.col("failure"))
    return docs.select("doc_id", *(got[k].alias(k) for k in ("title", "publication_year", "doi", "title_confidence", "publication_year_confidence", "doi_confidence", "status", "error")))


def _images(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.when(i % 3 == 0, "a/b.JPG").when(i % 3 == 1, "a.b/c").otherwise("x.jpeg").alias("path"))
    return docs.select("doc_id", X.image_part(F.col("path"), F.col("text").cast("binary")).alias("p")).select("doc_id", "p.media_type", F.regexp_replace("p.data", r"\s", "").alias("data"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("logs//./"), i.cast("string"), F.lit("/../x.log"))).when(i % 5 == 2, "/../a/b/").when(i % 5 == 3, "..")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.normal_path(path, "/data/out").alias("path"))


QUERIES = {
    "page_discovery": lambda s, d: A.page_numbers(_listed(s, d)),
    "last_updated": lambda s, d: A.last_updated(_listed(s, d)),
    "ai_inference": _inferred,
    "image_parts": _images,
    "normal_paths": _paths,
    "shown_text": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.shown(F.concat("text", F.repeat("text", F.lit(8)))).alias("shown")),
    "empty_scan": lambda s, d: C.empty(s, C.catalog_all(catalog(s, d)).schema),
    "browse_state_documents": lambda s, d: C.browse_state(C.published(catalog(s, d)), "oldest", q="author", rights="public_domain")["documents"].select("id", "title"),
    "browse_state_languages": lambda s, d: C.browse_state(C.published(catalog(s, d)), "oldest", q="author")["languages"],
    "bundle_inputs": lambda s, d: existing(s, d).select("folder", "error", "done", "requested", "effective.title", "effective.author", "effective.publication_year", "judged.assessment"),
    "publish_bundle": lambda s, d: bundles(s, d)["documents"],
    "bundle_authors": lambda s, d: bundles(s, d)["authors"],
    "bundle_pages": lambda s, d: bundles(s, d)["pages"],
    "bundle_assets": lambda s, d: bundles(s, d)["assets"],
    "bundle_snapshots": lambda s, d: bundles(s, d)["snapshots"],
    "published_documents": lambda s, d: published(s, d)["documents"].select("id", "slug", "created_by", "title", "author_display", "publication_year", "page_count"),
    "published_version": lambda s, d: _versioned(s, d)["document_pages"].select("document_id", "page_number", "digitalized_text", "image_path"),
    "published_skipping": lambda s, d: published(s, d, " Skip ")["documents"].select("id", "slug", "title"),
    "published_authors": lambda s, d: published(s, d)["authors"],
    "published_links": lambda s, d: published(s, d)["document_authors"],
    "published_pages": lambda s, d: published(s, d)["document_pages"].select("document_id", "page_number", "digitalized_text", "image_path"),
    "published_assets": lambda s, d: published(s, d)["document_assets"].select("document_id", "asset_type", "storage_path"),
    "published_snapshots": lambda s, d: published(s, d)["document_metadata_snapshots"].select("document_id", "effective_metadata"),
    "override_values": _ov,
    "override_merge": _saved,
    "form_metadata": _form,
    "metadata_context": _context,
    "metadata_report": _report,
    "rights_report": _rights,
    "embedded_metadata": _embedded,
    "page_jobs": _jobs,
}

# DuckDB

_TEXTS = f"(SELECT doc_id, {plain_sql('text')} AS plain, sha256(text) AS sha2 FROM documents)"
_PLAIN = "trim(regexp_replace({}, ' {{2,}}', ' ', 'g'))"
_HAS = "doc_id % 3 <> 0"
_TITLE = f"CASE WHEN doc_id % 5 = 0 THEN concat('Set ', doc_id % 20) WHEN {_HAS} THEN concat('Paper ', doc_id % 50) WHEN doc_id % 6 = 0 THEN concat('Pdf T', doc_id % 30) WHEN doc_id % 12 = 9 THEN concat('First ', doc_id) ELSE concat('n', doc_id) END"
_AUTHOR = f"CASE WHEN {_HAS} THEN concat('Ann  Lee', doc_id % 5) WHEN doc_id % 12 = 9 THEN 'Max Weber' END"
_YEAR = f"cast(CASE WHEN doc_id % 5 = 0 THEN 1801 WHEN {_HAS} THEN 1500 + doc_id % 520 WHEN doc_id % 12 = 9 THEN 1650 WHEN doc_id % 9 = 0 THEN 1620 END AS int)"
_FOUND = "CASE WHEN doc_id % 7 = 0 THEN [] ELSE list_transform(range(1, doc_id % 3 + 2), lambda i: cast(i AS int)) END"
_B = f"""WITH o AS (SELECT doc_id, concat('out-', doc_id) AS folder, concat('n', doc_id) AS name, {_TITLE} AS title, {_AUTHOR} AS author, {_YEAR} AS publication_year, sha2 AS source_hash, plain,
  CASE WHEN doc_id % 4 = 1 THEN [1, 2] ELSE {_FOUND} END AS done FROM {_TEXTS}),
x AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN [1, 2, 3] ELSE done END AS requested, replace(lower(title), ' ', '-') AS slug,
  CASE WHEN doc_id % 10 = 9 THEN concat('Missing digitalized TeX: ', folder, '/', name, '_digitalized.tex') WHEN doc_id % 11 = 10 THEN concat('Missing Korean TeX: ', folder, '/', name, '_Korean.tex') WHEN len(done) = 0 THEN 'No page_XXX.tex files were found in the output directory.' END AS error,
  CASE WHEN publication_year <= 1929 THEN 'likely_public_domain_us' ELSE 'unknown' END AS assessment,
  list_filter(list_transform(string_split(plain, chr(10)), lambda l: {_PLAIN.format('l')}), lambda l: l <> '') AS dig, list_transform(string_split(plain, chr(10)), lambda l: {_PLAIN.format("'K ' || l")}) AS kor FROM o),
b AS (SELECT * FROM x WHERE error IS NULL),
f AS (SELECT * EXCLUDE (kind), concat('documents/', slug, '/', CASE asset_type WHEN 'source_pdf' THEN 'source.pdf' WHEN 'artifact' THEN 'notes/over-view.txt' ELSE relative_path END) AS storage_path FROM (SELECT f.*, b.slug, b.doc_id, 1 AS kind FROM ({FILES.format(documents='documents', numbers='(VALUES (1), (2), (3)) v(n)')}) f JOIN b USING (folder))),
p AS (SELECT folder, slug, doc_id, page_number, coalesce(dig[i], '') AS digitalized_text, coalesce(kor[i], '') AS korean_text, CASE WHEN (doc_id + page_number) % 3 <> 0 THEN printf('documents/%s/images/page_%03d.png', slug, page_number) END AS image_path,
  CASE WHEN page_number <= doc_id % 3 + 1 THEN printf('documents/%s/page_%03d.tex', slug, page_number) END AS digitalized_tex_path, cast(NULL AS string) AS structure_json_path FROM (SELECT *, unnest(done) AS page_number, generate_subscripts(done, 1) AS i FROM b)),
ord AS (SELECT *, (publication_year - 1) // 100 + 1 AS c FROM b),
d AS (SELECT folder, slug, title, author AS author_display, publication_year, CASE WHEN publication_year > 0 THEN cast(c AS string) || CASE WHEN c % 100 IN (11, 12, 13) THEN 'th' WHEN c % 10 = 1 THEN 'st' WHEN c % 10 = 2 THEN 'nd' WHEN c % 10 = 3 THEN 'rd' ELSE 'th' END || ' century' END AS century_label,
  CASE WHEN {_HAS} THEN 'French' END AS language, cast(NULL AS string) AS journal_or_book, cast(NULL AS string) AS volume, cast(NULL AS string) AS issue, CASE WHEN {_HAS} THEN '1-9' END AS page_range, cast(NULL AS string) AS doi, cast(NULL AS string) AS summary,
  '{B.VERSION}' AS pipeline_version, '{AT}' AS published_at, '{AT}' AS updated_at, 'published' AS status, '{B.BUCKET}' AS storage_bucket, CASE WHEN doc_id % 2 = 0 THEN concat('documents/', slug, '/source.pdf') END AS source_pdf_path, cast(NULL AS string) AS digitalized_pdf_path, cast(NULL AS string) AS korean_pdf_path,
  CASE WHEN (doc_id + 1) % 3 <> 0 THEN printf('documents/%s/images/page_001.png', slug) END AS cover_image_path, cast(len(done) AS int) AS page_count, cast(len(requested) AS int) AS requested_page_count, assessment AS rights_assessment, source_hash FROM ord),
last AS (SELECT slug, max(folder) AS folder FROM d GROUP BY 1),
old AS (SELECT cast(n + 1 AS bigint) AS id, concat('paper-', n * 4) AS slug FROM range(10) r(n)),
ids AS (SELECT slug, folder, coalesce(old.id, 10 + row_number() OVER (PARTITION BY old.id IS NULL ORDER BY slug)) AS document_id FROM last LEFT JOIN old USING (slug)),
au AS (SELECT sort_name, arg_max(author_display, folder) AS display_name FROM (SELECT *, lower(trim(regexp_replace(author_display, '\\s+', ' ', 'g'))) AS sort_name FROM d SEMI JOIN last USING (slug, folder) WHERE author_display IS NOT NULL) GROUP BY 1),
aid AS (SELECT sort_name, display_name, CASE WHEN sort_name = 'ann lee1' THEN 5 ELSE 6 + row_number() OVER (PARTITION BY sort_name = 'ann lee1' ORDER BY sort_name) END AS id FROM au)
"""
_EFF = "concat('{\"title\":\"', title, '\"', coalesce(',\"author\":\"' || author || '\"', ''), coalesce(',\"publication_year\":' || publication_year, ''), CASE WHEN doc_id % 3 <> 0 THEN ',\"pages\":\"1-9\",\"language\":\"French\"' ELSE '' END, '}')"
_OV = "CASE WHEN doc_id % 5 = 0 THEN {} END"
ORACLE_SQL = {
    "bundle_inputs": f"{_B} SELECT folder, error, done, requested, title, author, publication_year, assessment FROM x",
    "publish_bundle": f"{_B} SELECT * FROM d",
    "bundle_authors": f"{_B} SELECT folder, slug, author_display AS display_name, lower(trim(regexp_replace(author_display, '\\s+', ' ', 'g'))) AS sort_name, cast(NULL AS int) AS birth_year, cast(NULL AS int) AS death_year FROM d WHERE author_display IS NOT NULL",
    "bundle_pages": f"{_B} SELECT * EXCLUDE (doc_id) FROM p",
    "bundle_assets": f"{_B} SELECT folder, slug, relative_path, asset_type, '{B.BUCKET}' AS storage_bucket, storage_path, mime_type, byte_size FROM f",
    "published_documents": f"{_B} SELECT coalesce(i.document_id, old.id) AS id, coalesce(i.slug, old.slug) AS slug, CASE WHEN old.id IS NOT NULL THEN 'kept' END AS created_by, d.title, d.author_display, d.publication_year, d.page_count FROM old FULL JOIN ids i USING (slug) LEFT JOIN d ON d.folder = i.folder",
    "published_skipping": f"{_B} SELECT id, slug, cast(NULL AS string) AS title FROM old UNION ALL SELECT 10 + row_number() OVER (ORDER BY slug), slug, title FROM d SEMI JOIN last USING (slug, folder) WHERE slug NOT IN (SELECT slug FROM old)",
    "published_authors": f"{_B} SELECT id, sort_name, display_name, cast(NULL AS int) AS birth_year, cast(NULL AS int) AS death_year FROM aid UNION ALL SELECT 6, 'nobody', 'Nobody', NULL, NULL UNION ALL SELECT 5, 'ann lee1', 'Old', 1600, NULL WHERE NOT EXISTS (SELECT 1 FROM aid WHERE id = 5)",
    "published_links": f"{_B} SELECT document_id, id AS author_id, 1 AS ordinal FROM ids JOIN d USING (slug, folder) JOIN aid ON sort_name = lower(trim(regexp_replace(author_display, '\\s+', ' ', 'g'))) UNION ALL SELECT id, 6, 1 FROM old ANTI JOIN ids USING (slug)",
    "published_pages": f"{_B} SELECT document_id, page_number, digitalized_text, image_path FROM p JOIN ids USING (slug, folder) UNION ALL SELECT id, 7, 'old', 'old' FROM old ANTI JOIN ids USING (slug)",
    "published_version": f"{_B} SELECT document_id, page_number, digitalized_text, image_path FROM p JOIN ids USING (slug, folder) UNION ALL SELECT id, 7, 'old', 'old' FROM old ANTI JOIN ids USING (slug)",
    "published_assets": f"{_B} SELECT document_id, asset_type, storage_path FROM f JOIN ids USING (slug, folder) UNION ALL SELECT id, 'old', 'old' FROM old ANTI JOIN ids USING (slug)",
    "published_snapshots": f"{_B} SELECT document_id, {_EFF} AS effective_metadata FROM b JOIN ids USING (slug, folder) UNION ALL SELECT id, 'old' FROM old ANTI JOIN ids USING (slug)",
    "override_values": "SELECT concat('out-', doc_id) AS folder, " + ", ".join(f"{_OV.format(dict(title=chr(39).join(['concat(', 'Set ', ', doc_id % 20)']), publication_year='cast(1801 AS int)').get(f, 'cast(NULL AS int)' if f in R.YEARS else 'cast(NULL AS string)'))} AS {f}" for f in R.FIELDS) + " FROM documents",
    "override_merge": f"SELECT concat('out-', doc_id) AS folder, CASE WHEN doc_id % 5 = 0 OR doc_id % 10 = 5 THEN concat('{{\"updated_at\":\"{AT}\",\"overrides\":{{\"title\":\"Set ', doc_id % 20, '\"', CASE WHEN doc_id % 10 = 5 THEN ',\"author\":\"New Author\"' ELSE '' END, ',\"publication_year\":1801}}}}') END AS content FROM documents",
    "form_metadata": f"SELECT concat('out-', doc_id) AS folder, coalesce(CASE WHEN {_HAS} THEN concat('Ann  Lee', doc_id % 5) END, CASE WHEN doc_id % 10 = 3 THEN 'State Author' END, '') AS author, coalesce(CASE WHEN doc_id % 5 = 0 THEN '1801' WHEN {_HAS} THEN cast(1500 + doc_id % 520 AS string) WHEN doc_id % 9 = 0 THEN 'printed 1620' END, '') AS publication_year, CASE WHEN doc_id % 10 = 3 THEN '1700' ELSE '' END AS death_year FROM documents",
    "metadata_context": "SELECT folder, u AS reused, CASE WHEN doc_id % 6 = 0 THEN concat('{\"title\":\"Pdf T', doc_id % 30, '\"}') WHEN u THEN '{\"title\":\"Old\"}' ELSE '{}' END AS raw_pdf_metadata, CASE WHEN doc_id % 5 = 0 THEN concat('{\"title\":\"Set ', doc_id % 20, '\",\"publication_year\":1801}') ELSE '{}' END AS manual_override, CASE WHEN u THEN '10.1' END AS ai_doi, CASE WHEN u THEN 'high' ELSE 'none' END AS ai_sure, CASE WHEN u THEN 'T' END AS structure_title FROM (SELECT doc_id, concat('out-', doc_id) AS folder, doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AS u FROM documents)",
    "rights_report": f"{_B} SELECT folder, concat('{{\"checked_at\":\"{AT}\",\"author\":', coalesce('\"' || author || '\"', 'null'), ',\"publication_year\":', coalesce(cast(publication_year AS string), 'null'), ',\"death_year\":null,\"assessment\":\"', assessment, '\",\"reason\":\"', CASE WHEN publication_year <= 1929 THEN 'Publication year is 1929 or earlier (US heuristic).' WHEN publication_year IS NOT NULL THEN 'Publication year alone was not enough for this heuristic.' ELSE 'Insufficient metadata.' END, '\",\"basis\":', CASE WHEN publication_year <= 1929 THEN '\"publication_year\"' ELSE 'null' END, ',\"needs_manual_review\":', CASE WHEN publication_year > 1929 THEN 'true' ELSE 'false' END, ',\"source_summary\":\"author=pdf\",\"warnings\":[]}}') AS report FROM x",
    "embedded_metadata": "SELECT concat('out-', doc_id) AS folder, CASE WHEN doc_id % 6 = 0 THEN concat('Pdf T', doc_id % 30) END AS title, cast(NULL AS string) AS author, cast(NULL AS string) AS \"modDate\" FROM documents",
    "page_jobs": "SELECT doc_id AS document_id, cast(2 + n AS int) AS page_number, printf('page_%03d.png', n) AS image FROM documents, range(1, 5) r(n) WHERE n <= least(doc_id % 3 + 1, doc_id % 4 + 1)",
}
ORACLE_SQL["bundle_snapshots"] = (
    f"{_B} SELECT folder, slug, CASE WHEN doc_id % 6 = 0 THEN concat('{{\"title\":\"Pdf T', doc_id % 30, '\"}}') ELSE '{{}}' END AS raw_pdf_metadata, CASE WHEN doc_id % 12 = 9 THEN concat('{{\"title\":\"First ', doc_id, '\",\"author\":\"Max Weber\",\"publication_year\":1650}}') ELSE '{{}}' END AS deterministic_metadata,"
    f" CASE WHEN {_HAS} THEN '{{\"doi\":\"x\"}}' ELSE '{{}}' END AS ai_metadata, {_EFF} AS effective_metadata, CASE WHEN doc_id % 5 = 0 THEN concat('{{\"title\":\"Set ', doc_id % 20, '\",\"publication_year\":1801}}') ELSE '{{}}' END AS manual_override,"
    f" concat('{{', coalesce('\"author\":\"' || author || '\",', ''), coalesce('\"publication_year\":' || publication_year || ',', ''), '\"assessment\":\"', assessment, '\",\"reason\":\"', CASE WHEN publication_year <= 1929 THEN 'Publication year is 1929 or earlier (US heuristic).' WHEN publication_year IS NOT NULL THEN 'Publication year alone was not enough for this heuristic.' ELSE 'Insufficient metadata.' END, '\"', CASE WHEN publication_year <= 1929 THEN ',\"basis\":\"publication_year\"' ELSE '' END, ',\"needs_manual_review\":', CASE WHEN publication_year > 1929 THEN 'true' ELSE 'false' END, CASE WHEN {_HAS} THEN ',\"source_summary\":\"author=pdf\"' ELSE '' END, ',\"warnings\":[]}}') AS rights_metadata,"
    " CASE WHEN doc_id % 8 = 0 THEN '{\"font_size_pt\":12}' ELSE '{}' END AS layout_profile FROM b")

_DOCS = "FROM documents"
ORACLE_SQL |= {
    "page_discovery": f"SELECT concat('out-', doc_id) AS folder, CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [2] END AS pages {_DOCS}",
    "last_updated": f"SELECT concat('out-', doc_id) AS folder, CASE WHEN doc_id % 5 <> 0 OR doc_id % 7 = 0 THEN strftime(make_timestamp((1700000000 + doc_id * 10 + n) * 1000000), '%Y-%m-%dT%H:%M:%S') END AS updated_at FROM (SELECT doc_id, 1 + CAST(doc_id % 2 = 0 AS int) + CAST(doc_id % 3 = 0 AS int) + CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 2 ELSE 1 END AS n {_DOCS})",
    "ai_inference": f"SELECT doc_id, CASE WHEN ok THEN concat('T', doc_id) END AS title, cast(CASE WHEN ok THEN 1704 END AS int) AS publication_year, cast(NULL AS string) AS doi, CASE WHEN ok THEN 'high' ELSE 'none' END AS title_confidence, CASE WHEN ok THEN 'low' ELSE 'none' END AS publication_year_confidence, 'none' AS doi_confidence, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN ok THEN 'ok' ELSE 'empty' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'timeout' WHEN NOT ok THEN 'Could not parse metadata JSON response.' END AS error FROM (SELECT doc_id, doc_id % 3 = 1 AND doc_id % 5 <> 0 AS ok {_DOCS})",
    "image_parts": f"SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END AS media_type, to_base64(encode(text)) AS data {_DOCS}",
    "normal_paths": f"SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN '/data/out/logs/x.log' WHEN 2 THEN '/a/b' WHEN 3 THEN '/data' END AS path {_DOCS}",
    "shown_text": f"SELECT doc_id, substr(repeat(text, 9), 1, {X.SHOWN}) AS shown {_DOCS}",
    "empty_scan": "SELECT * FROM (" + PC.ORACLE_SQL["catalog_all"] + ") WHERE false",
    "browse_state_documents": with_catalog("SELECT id, title FROM published WHERE contains(lower(concat_ws(' ', title, author_display, journal_or_book, doi, century_label, language)), 'author') AND starts_with(rights_assessment, 'likely_public_domain')"),
    "browse_state_languages": with_catalog("SELECT DISTINCT nullif(trim(language), '') AS language FROM published WHERE language IS NOT NULL"),
}
_MD, _RD = (M.ORACLE_SQL[k] for k in ("metadata_refresh", "apply_override"))
ORACLE_SQL["metadata_report"] = (
    "SELECT e.doc_id, ['ai_inference', 'checked_at', 'deterministic_inference', 'effective_metadata', 'effective_sources', 'manual_override', 'paper_name', 'raw_pdf_metadata', 'rights_metadata', 'rights_sources'] AS keys, concat('n', e.doc_id) AS name,"
    " e.title AS e_title, e.author AS e_author, e.doi AS e_doi, e.title_source AS title_source, cast(r.author AS string) AS r_author, cast(r.publication_year AS string) AS r_publication_year, cast(r.death_year AS string) AS r_death_year, r.author_source AS author_source"
    f" FROM ({_MD}) e JOIN ({_RD}) r USING (doc_id)"
)

"""Catalog queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import catalog as C
from foliant.sources.adapters import catalog, pages, with_catalog, with_pages

BASE = "https://archive.example.org/"

_NORM = "lower(regexp_replace(coalesce(cast({} AS string), ''), '^\\s+|\\s+$', '', 'g'))"
_TEXT = "concat_ws(' ', " + ", ".join(f"nullif({_NORM.format(c)}, '')" for c in C.SEARCH_FIELDS) + ")"
_BUCKET = "CASE WHEN coalesce(starts_with(rights_assessment, 'likely_public_domain'), false) THEN 'public_domain' ELSE 'undetermined' END"
_CLEAN = "nullif(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"
_AUTHOR = "coalesce(nullif(author_display, ''), 'Unknown author')"
_CENTURY = "coalesce(nullif(century_label, ''), 'Undated')"
_COLUMNS = ", ".join(C.CATALOG_COLUMNS)


def _ordinal(n: str) -> str:
    return f"(cast({n} AS string) || CASE WHEN {n} % 100 IN (11, 12, 13) THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"


_ERA = f"""(SELECT *, coalesce({_ordinal('century_number')} || ' century', century_label, 'Undated') AS era FROM (SELECT *,
  cast(CASE WHEN publication_year > 0 THEN (publication_year - 1) // 100 + 1 ELSE try_cast(nullif(regexp_extract(coalesce(century_label, ''), '^\\s*(\\d+)', 1), '') AS int) END AS int) AS century_number FROM published))"""
_ERA_ID = "concat('era-', coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'undated'))"
_SECTIONS = f"""(SELECT {_ERA_ID.format('era')} AS id, era AS label, century_number, count(*) AS documents,
  CASE WHEN min(publication_year) IS NULL THEN 'Undated' ELSE concat(min(publication_year), '-', max(publication_year)) END AS years,
  count(DISTINCT publication_year) + max(CASE WHEN publication_year IS NULL THEN 1 ELSE 0 END) AS buckets FROM {_ERA} GROUP BY era, century_number)"""
_ORDERS = {
    "recent": "published_at DESC NULLS LAST, title, id", "oldest": "publication_year ASC NULLS LAST, title, id", "title": "title, id",
    "author": "coalesce(author_display, 'Unknown author'), title, id", "pages_desc": "page_count DESC, title, id",
}


def _url(path: str) -> str:
    return f"CASE WHEN {path} <> '' THEN concat('https://archive.example.org/storage/v1/object/public/', replace(storage_bucket, ' ', '%20'), '/', replace({path}, ' ', '%20')) END"


def _published(f):
    return lambda s, d: f(C.published(catalog(s, d)))


_BROWSE = {"q": "author", "author": "SRC", "year_from": "1600", "year_to": "1.9e3", "language": "english", "rights": "public_domain"}

QUERIES = {
    "catalog_all": lambda s, d: C.catalog_all(catalog(s, d)),
    "catalog_recent": lambda s, d: C.catalog_recent(catalog(s, d)),
    "doc_by_slug": lambda s, d: C.doc_by_slug(catalog(s, d), "doc-28"),
    "doc_pages": lambda s, d: C.doc_pages(pages(s, d), 28),
    "public_url": lambda s, d: catalog(s, d).select("id", X.public_url(BASE, F.col("storage_bucket"), F.col("digitalized_pdf_path")).alias("url")),
    "search_tokens": _published(lambda p: C.search(p, "author  th century").select("id", "title")),
    "filter_fields": _published(lambda p: C.browse(p, journal="journal 1", volume="1").select("id", "journal_or_book", "volume")),
    "filter_year_range": _published(lambda p: C.browse(p, year_from=" 1700 ", year_to="1800").select("id", "publication_year")),
    "filter_language": _published(lambda p: C.browse(p, language=" SPANISH").select("id", "language")),
    "filter_rights": _published(lambda p: C.browse(p, rights="undetermined").select("id", "rights_assessment")),
    "browse_catalog": _published(lambda p: C.browse(p, **_BROWSE).select(*C.CATALOG_COLUMNS)),
    "rights_label": lambda s, d: catalog(s, d).select("id", C.rights_label().alias("label")),
    "archive_overview": _published(C.overview),
    "language_options": _published(C.language_options),
    "group_by_author": _published(C.by_author),
    "group_by_century": _published(C.by_century),
    "top_authors": _published(C.top_authors),
    "top_centuries": _published(C.top_centuries),
    "era_sections": _published(C.era_sections),
    "era_year_buckets": _published(C.era_year_buckets),
    "era_rollup": _published(C.era_rollup),
    "viewer_state": lambda s, d: C.viewer(C.published(catalog(s, d)), pages(s, d), BASE),
    "card_projection": _published(C.cards),
    "page_snippet": lambda s, d: pages(s, d).select("id", X.page_snippet(F.col("digitalized_text"), F.col("korean_text")).alias("snippet")),
    "page_availability": lambda s, d: pages(s, d).select("id", X.page_availability(F.col("digitalized_text"), F.col("korean_text")).alias("label")),
} | {f"sort_{k}": (lambda k: _published(lambda p: C.positions(p, k)))(k) for k in C.SORTS} | {f"sort_{k}_locale": (lambda k: _published(lambda p: C.positions(p, k, "UNICODE")))(k) for k in C.SORTS}

_SNIP = "trim(regexp_replace(coalesce(digitalized_text, korean_text, ''), '\\s+', ' ', 'g'))"

ORACLE_SQL = {
    "catalog_all": with_catalog(f"SELECT {_COLUMNS} FROM published"),
    "catalog_recent": with_catalog(f"SELECT {_COLUMNS} FROM published ORDER BY published_at DESC NULLS LAST, id LIMIT 6"),
    "doc_by_slug": with_catalog("SELECT * FROM catalog WHERE slug = 'doc-28'"),
    "doc_pages": with_pages("SELECT * FROM doc_pages WHERE document_id = 28"),
    "public_url": with_catalog(f"SELECT id, {_url('digitalized_pdf_path')} AS url FROM catalog"),
    "search_tokens": with_catalog(f"SELECT id, title FROM (SELECT *, {_TEXT} AS t FROM published) WHERE contains(t, 'author') AND contains(t, 'th') AND contains(t, 'century')"),
    "filter_fields": with_catalog("SELECT id, journal_or_book, volume FROM published WHERE contains(lower(coalesce(journal_or_book, '')), 'journal 1') AND contains(coalesce(volume, ''), '1')"),
    "filter_year_range": with_catalog("SELECT id, publication_year FROM published WHERE publication_year BETWEEN 1700 AND 1800"),
    "filter_language": with_catalog("SELECT id, language FROM published WHERE lower(trim(language)) = 'spanish'"),
    "filter_rights": with_catalog(f"SELECT id, rights_assessment FROM published WHERE {_BUCKET} = 'undetermined'"),
    "browse_catalog": with_catalog(f"SELECT {_COLUMNS} FROM (SELECT *, {_TEXT} AS t FROM published) WHERE contains(t, 'author') AND contains(lower(coalesce(author_display, '')), 'src') AND publication_year BETWEEN 1600 AND 1900 AND lower(trim(language)) = 'english' AND {_BUCKET} = 'public_domain'"),
    "rights_label": with_catalog(f"SELECT id, CASE WHEN {_BUCKET} = 'public_domain' THEN 'Likely public domain' ELSE 'Rights uncertain' END AS label FROM catalog"),
    "archive_overview": with_catalog(f"SELECT count(*) AS total_documents, count(DISTINCT {_CLEAN.format('author_display')}) AS authors, count(DISTINCT {_CLEAN.format('century_label')}) AS centuries, count(DISTINCT {_CLEAN.format('language')}) AS languages, count(*) FILTER ({_BUCKET} = 'public_domain') AS public_domain, greatest(count(*) - count(*) FILTER ({_BUCKET} = 'public_domain'), 0) AS undetermined, min(publication_year) AS min_year, max(publication_year) AS max_year FROM published"),
    "language_options": with_catalog(f"SELECT DISTINCT {_CLEAN.format('language')} AS language FROM published WHERE {_CLEAN.format('language')} IS NOT NULL"),
    "group_by_author": with_catalog(f"SELECT {_AUTHOR} AS author, count(*) OVER (PARTITION BY {_AUTHOR}) AS documents, id FROM published"),
    "group_by_century": with_catalog(f"SELECT {_CENTURY} AS century, count(*) OVER (PARTITION BY {_CENTURY}) AS documents, id FROM published"),
    "top_authors": with_catalog(f"SELECT {_AUTHOR} AS author, count(*) AS documents FROM published GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6"),
    "top_centuries": with_catalog(f"SELECT {_CENTURY} AS century, count(*) AS documents FROM published GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6"),
    "era_sections": with_catalog(f"SELECT * FROM {_SECTIONS}"),
    "era_year_buckets": with_catalog(f"SELECT era, coalesce(cast(publication_year AS string), 'Undated') AS year_label, count(*) OVER (PARTITION BY era, publication_year) AS documents, id FROM {_ERA}"),
    "era_rollup": with_catalog(f"SELECT count(*) AS sections, cast(sum(buckets) AS bigint) AS year_buckets, cast(sum(documents) AS bigint) AS documents FROM {_SECTIONS}"),
    "viewer_state": with_pages(f"SELECT p.document_id, slug, page_number, {_url('source_pdf_path')} AS source_pdf_url, {_url('digitalized_pdf_path')} AS digitalized_pdf_url, {_url('korean_pdf_path')} AS korean_pdf_url, {_url('image_path')} AS image_url FROM doc_pages p JOIN catalog c ON c.id = p.document_id WHERE status = 'published'"),
    "card_projection": with_catalog(f"SELECT id, title, {_AUTHOR} AS author, coalesce(cast(publication_year AS string), 'n.d.') AS year, coalesce(journal_or_book, 'Independent manuscript') AS journal, concat_ws(' · ', 'Vol. ' || volume, 'No. ' || issue) AS numbers, CASE WHEN {_BUCKET} = 'public_domain' THEN 'Likely public domain' ELSE 'Rights uncertain' END AS rights FROM published"),
    "page_snippet": with_pages(f"SELECT id, CASE WHEN {_SNIP} = '' THEN 'No extracted text available.' WHEN length({_SNIP}) > 140 THEN concat(rtrim(substr({_SNIP}, 1, 137)), '...') ELSE {_SNIP} END AS snippet FROM doc_pages"),
    "page_availability": with_pages("SELECT id, CASE WHEN trim(coalesce(digitalized_text, '')) <> '' AND trim(coalesce(korean_text, '')) <> '' THEN 'Original + Korean' WHEN trim(coalesce(digitalized_text, '')) <> '' THEN 'Original only' WHEN trim(coalesce(korean_text, '')) <> '' THEN 'Korean only' ELSE 'Image only' END AS label FROM doc_pages"),
} | {f"sort_{k}": with_catalog(f"SELECT id, cast(row_number() OVER (ORDER BY {o}) AS int) AS pos FROM published") for k, o in _ORDERS.items()}
# Names in the order of a locale: ties of the collation go by the id.
ORACLE_SQL |= {f"sort_{k}_locale": with_catalog(f"SELECT id, cast(row_number() OVER (ORDER BY {o.replace('title', 'title COLLATE en').replace('author\')', 'author\') COLLATE en')}) AS int) AS pos FROM published") for k, o in _ORDERS.items()}

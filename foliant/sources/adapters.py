"""Shapes the test tables into the archive's relations. The same SQL runs on Spark and DuckDB; it holds no rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = r"""
SELECT d.doc_id AS id, concat('doc-', cast(d.doc_id AS string)) AS slug,
  coalesce(nullif(substr(split_part(d.text, chr(10), 1), 1, 60), ''), 'untitled') AS title,
  CASE WHEN d.source = 'src0' THEN NULL WHEN d.doc_id % 11 = 0 THEN concat(' Author ', d.source, ' ') ELSE concat('Author ', d.source) END AS author_display,
  cast(CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE 1500 + (d.doc_id * 7919) % 600 END AS int) AS publication_year,
  cast(CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 1540 + (d.doc_id * 7919) % 600 END AS int) AS death_year,
  CASE WHEN d.doc_id % 26 = 0 THEN '17th century' WHEN d.doc_id % 39 = 0 THEN 'Antiquity' WHEN d.doc_id % 13 = 0 THEN NULL
    WHEN d.doc_id % 17 = 0 THEN NULL ELSE concat(cast(cast(floor((1499 + (d.doc_id * 7919) % 600) / 100.0) AS int) + 1 AS string), 'th century') END AS century_label,
  CASE d.lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN ' Spanish ' ELSE NULL END AS language,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('Journal ', cast(d.doc_id % 17 AS string)) END AS journal_or_book,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE cast(d.doc_id % 40 AS string) END AS volume,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE cast(d.doc_id % 12 AS string) END AS issue,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE concat(cast(d.doc_id % 90 + 1 AS string), '-', cast(d.doc_id % 90 + 9 AS string)) END AS page_range,
  CASE WHEN d.doc_id % 6 <> 0 THEN NULL ELSE concat('10.1000/', cast(d.doc_id AS string)) END AS doi,
  CASE WHEN d.doc_id % 8 = 0 THEN NULL ELSE substr(d.text, 1, 200) END AS summary,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'draft' ELSE 'published' END AS status, 'archive files' AS storage_bucket,
  concat('doc-', cast(d.doc_id AS string), '/source.pdf') AS source_pdf_path,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE concat('doc-', cast(d.doc_id AS string), '/digital ized.pdf') END AS digitalized_pdf_path,
  CASE WHEN d.doc_id % 12 = 0 THEN NULL ELSE concat('doc-', cast(d.doc_id AS string), '/korean.pdf') END AS korean_pdf_path,
  CASE WHEN d.doc_id % 14 = 0 THEN NULL ELSE concat('doc-', cast(d.doc_id AS string), '/images/page_001.png') END AS cover_image_path,
  cast(1 + floor(d.n_chars / 1800.0) AS int) AS page_count, cast(2 + floor(d.n_chars / 1800.0) AS int) AS requested_page_count,
  CASE d.doc_id % 4 WHEN 0 THEN 'likely_public_domain_us' WHEN 1 THEN 'likely_public_domain_life_plus_70' WHEN 2 THEN 'unknown' ELSE NULL END AS rights_assessment,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE concat('2024-', lpad(cast(1 + d.doc_id % 12 AS string), 2, '0'), '-', lpad(cast(1 + d.doc_id % 28 AS string), 2, '0'), 'T00:00:00') END AS published_at
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

#: Each of a document's lines is a page of its own.
PAGES = r"""
SELECT d.doc_id * 1000 + p.n AS id, d.doc_id AS document_id, cast(p.n AS int) AS page_number,
  CASE WHEN p.n % 6 = 0 THEN NULL ELSE concat('doc-', cast(d.doc_id AS string), '/images/page_', lpad(cast(p.n AS string), 3, '0'), '.png') END AS image_path,
  CASE WHEN p.n % 5 = 4 THEN NULL ELSE p.line END AS digitalized_text, CASE WHEN p.n % 3 = 2 THEN NULL WHEN p.n % 7 = 6 THEN '  ' ELSE concat('K ', p.line) END AS korean_text
FROM {documents} d, {lines} p WHERE p.doc_id = d.doc_id
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    # No column holds more than a text's first 200 characters; cut before the join, whole texts aren't shuffled.
    docs = docs.select("doc_id", F.substring("text", 1, 200).alias("text"), "lang", "source", "n_chars")
    return spark.sql(CATALOG, documents=docs, labels=labels)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of documents: their lines, numbered from 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.selectExpr("doc_id", "posexplode(split(text, '\n')) AS (p, line)").selectExpr("doc_id", "p + 1 AS n", "line")
    return spark.sql(PAGES, documents=docs.select("doc_id"), lines=lines)


def with_catalog(select: str) -> str:
    """DuckDB SQL over `catalog` and `published`."""
    return f"WITH catalog AS ({CATALOG.format(documents='documents', labels='labels')}), published AS (SELECT * FROM catalog WHERE status = 'published') {select}"


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def with_pages(select: str) -> str:
    """DuckDB SQL over `catalog` and `pages`."""
    return f"WITH catalog AS ({CATALOG.format(documents='documents', labels='labels')}), doc_pages AS ({PAGES.format(documents='documents', lines=_LINES)}) {select}"

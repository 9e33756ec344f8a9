"""The archive's relations as Spark schemas, and empty ones to begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Table -> columns. Fixed values.
TABLES = {
    "documents": "id long, slug string, title string, author_display string, publication_year int, century_label string, language string, journal_or_book string, volume string, issue string, page_range string, doi string, summary string, pipeline_version string, status string, storage_bucket string, source_pdf_path string, digitalized_pdf_path string, korean_pdf_path string, cover_image_path string, page_count int, requested_page_count int, rights_assessment string, source_hash string, published_at timestamp, updated_at timestamp, created_at timestamp",
    "authors": "id long, display_name string, sort_name string, birth_year int, death_year int, created_at timestamp",
    "document_authors": "document_id long, author_id long, ordinal int",
    "document_pages": "id long, document_id long, page_number int, image_path string, digitalized_tex_path string, digitalized_text string, korean_text string, structure_json_path string, created_at timestamp",
    "document_assets": "id long, document_id long, asset_type string, storage_bucket string, storage_path string, mime_type string, byte_size long, created_at timestamp",
    "document_metadata_snapshots": "document_id long, raw_pdf_metadata variant, deterministic_metadata variant, ai_metadata variant, effective_metadata variant, manual_override variant, rights_metadata variant, layout_profile variant, updated_at timestamp",
}
#: Table -> what identifies a row. Fixed values.
KEYS = {
    "documents": ("slug",),
    "authors": ("sort_name",),
    "document_authors": ("document_id", "author_id"),
    "document_pages": ("document_id", "page_number"),
    "document_assets": ("document_id", "storage_path"),
    "document_metadata_snapshots": ("document_id",),
}
#: What no two rows of a table share.
UNIQUE = {t: ((("id",),) if TABLES[t].startswith("id ") else ()) + (key,) for t, key in KEYS.items()}
#: Table -> columns that are never null. Fixed values.
REQUIRED = {
    "documents": ("id", "slug", "title", "status", "storage_bucket", "page_count", "requested_page_count", "updated_at", "created_at"),
    "authors": ("id", "display_name", "sort_name", "created_at"),
    "document_authors": ("document_id", "author_id", "ordinal"),
    "document_pages": ("id", "document_id", "page_number", "created_at"),
    "document_assets": ("id", "document_id", "asset_type", "storage_bucket", "storage_path", "created_at"),
    "document_metadata_snapshots": ("document_id", "raw_pdf_metadata", "deterministic_metadata", "ai_metadata", "effective_metadata", "rights_metadata", "layout_profile", "updated_at"),
}
#: Table and column -> the table and column it refers to; what refers to a row goes with it. Fixed values.
REFERENCES = {
    ("document_authors", "document_id"): ("documents", "id"),
    ("document_authors", "author_id"): ("authors", "id"),
    ("document_pages", "document_id"): ("documents", "id"),
    ("document_assets", "document_id"): ("documents", "id"),
    ("document_metadata_snapshots", "document_id"): ("documents", "id"),
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def write_table(rows: DataFrame, path: str) -> None:
    """A new snapshot of a table; readers switch to its path once it is whole."""
    rows.write.mode("errorifexists").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports, one JSON object a line."""
    reports.write.mode("errorifexists").json(path)

"""Queries over the catalog: scans, filters, search, sorts, facets, eras, authors, pages and views.

Operators take and return DataFrames and never collect; parameters that a request brings are plain Python values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.operators.order import numbered

#: Fields that search reads, in their order. Fixed values.
SEARCH_FIELDS = ("title", "author_display", "journal_or_book", "century_label", "language", "publication_year", "volume", "issue", "page_range", "doi")
#: Columns of the catalog scan. Fixed values.
CATALOG_COLUMNS = (
    "id", "slug", "title", "author_display", "publication_year", "century_label", "language", "journal_or_book", "volume", "issue", "page_range", "doi", "summary",
    "status", "storage_bucket", "source_pdf_path", "digitalized_pdf_path", "korean_pdf_path", "cover_image_path", "page_count", "requested_page_count", "rights_assessment", "published_at",
)
SORTS = ("recent", "oldest", "title", "author", "pages_desc")
UNKNOWN_AUTHOR, UNDATED = "Unknown author", "Undated"


# Request parameters


def year_param(value: str | None) -> int | None:
    """A whole number above 0 in any form that a number may take; anything else is no bound."""
    s = (value or "").strip()
    try:
        n = float(int(s, 0)) if s[:2].lower() in ("0x", "0o", "0b") else float(s.replace("_", "x"))
    except ValueError:
        return None
    return int(n) if n > 0 and n == int(n) else None


def first_param(value: str | Sequence[str] | None) -> str:
    return value if isinstance(value, str) else value[0] if value else ""


def sort_param(value: str | None) -> str:
    return value if value in SORTS else "recent"


# Scans


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """What a scan gives while no store is configured."""
    return spark.createDataFrame([], schema)


def published(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status") == "published")


def catalog_all(docs: DataFrame) -> DataFrame:
    """All published documents, oldest first, undated last, then by title."""
    return published(docs).select(*CATALOG_COLUMNS).orderBy(F.col("publication_year").asc_nulls_last(), "title", "id")


def catalog_recent(docs: DataFrame, n: int = 6) -> DataFrame:
    return published(docs).select(*CATALOG_COLUMNS).orderBy(F.col("published_at").desc_nulls_last(), "id").limit(n)


def doc_by_slug(docs: DataFrame, slug: str) -> DataFrame:
    """The document of a slug, whatever its status; two rows where slugs are not unique, which callers must reject."""
    return docs.where(F.col("slug") == slug).limit(2)


def doc_pages(pages: DataFrame, document_id: int) -> DataFrame:
    return pages.where(F.col("document_id") == document_id).orderBy("page_number")


# Filters


def search_text() -> Column:
    """What search looks in: the fields, lower case and stripped, empty ones left out."""
    fields = [X.norm(F.nullif(F.col(c), F.lit(0)) if c == "publication_year" else F.col(c)) for c in SEARCH_FIELDS]
    return F.array_join(F.filter(F.array(*fields), lambda x: x != ""), " ")


def tokens(query: str) -> list[str]:
    return query.lower().split()


def search(docs: DataFrame, query: str) -> DataFrame:
    """Documents that hold every token of the query somewhere; the text is built once for a row."""
    found = tokens(query)
    if not found:
        return docs
    return docs.where(F.exists(F.array(search_text()), lambda t: reduce(and_, (t.contains(x) for x in found))))


def rights_bucket() -> Column:
    return F.when(F.coalesce(F.col("rights_assessment").startswith("likely_public_domain"), F.lit(False)), "public_domain").otherwise("undetermined")


def rights_label() -> Column:
    return F.when(rights_bucket() == "public_domain", "Likely public domain").otherwise("Rights uncertain")


#: Filter -> the field in which it is sought. Fixed values.
FIELD_FILTERS = {"title": "title", "author": "author_display", "journal": "journal_or_book", "volume": "volume", "issue": "issue"}


def browse(docs: DataFrame, q: str = "", year_from: str = "", year_to: str = "", language: str = "", rights: str = "", **fields: str) -> DataFrame:
    """Documents under all filters given; a blank one is none."""
    docs = search(docs, q)
    for name, column in FIELD_FILTERS.items():
        if (value := fields.get(name, "").strip().lower()):
            docs = docs.where(X.norm(F.col(column)).contains(value))
    if (low := year_param(year_from)) is not None:
        docs = docs.where(F.col("publication_year") >= low)
    if (high := year_param(year_to)) is not None:
        docs = docs.where(F.col("publication_year") <= high)
    if language.strip():
        docs = docs.where(X.norm(F.col("language")) == language.strip().lower())
    if rights.strip():
        docs = docs.where(rights_bucket() == rights.strip())
    return docs


# Sorts


def sort_order(sort: str, locale: str | None = "UNICODE") -> list[Column]:
    """Columns to order by; names in the locale's order, or by code point where locale is None."""
    named = lambda c: F.collate(c, locale) if locale else c
    title = named(F.col("title"))
    return {
        "title": [title],
        "author": [named(F.coalesce("author_display", F.lit(UNKNOWN_AUTHOR))), title],
        "pages_desc": [F.col("page_count").desc(), title],
        "oldest": [F.col("publication_year").asc_nulls_last(), title],
    }.get(sort_param(sort), [F.col("published_at").desc_nulls_last(), title]) + [F.col("id")]


def sort_documents(docs: DataFrame, sort: str, locale: str | None = "UNICODE") -> DataFrame:
    return docs.orderBy(*sort_order(sort, locale))


def positions(docs: DataFrame, sort: str, locale: str | None = None) -> DataFrame:
    """id and pos, the document's place in the order."""
    named = lambda c: F.collate(c, locale) if locale else c
    title, unless = named(F.col("title")), lambda c: [F.col(c).isNull(), F.col(c)]
    key = {
        "title": [title],
        "author": [named(F.coalesce("author_display", F.lit(UNKNOWN_AUTHOR))), title],
        "pages_desc": [-F.col("page_count"), title],
        "oldest": [*unless("publication_year"), title],
    }.get(sort_param(sort), [F.col("published_at").isNull(), -F.unix_micros(F.col("published_at").cast("timestamp")), title])
    return numbered(docs, [*key, F.col("id")], "pos").select("id", F.col("pos").cast("int").alias("pos"))


# Groups and facets


def _distinct(c: str) -> Column:
    return F.count_distinct(X.clean_text(F.col(c)))


def overview(docs: DataFrame) -> DataFrame:
    """One row of what a collection holds."""
    public = F.count_if(rights_bucket() == "public_domain")
    return docs.agg(
        F.count("*").alias("total_documents"), _distinct("author_display").alias("authors"), _distinct("century_label").alias("centuries"), _distinct("language").alias("languages"),
        public.alias("public_domain"), F.greatest(F.count("*") - public, F.lit(0)).alias("undetermined"), F.min("publication_year").alias("min_year"), F.max("publication_year").alias("max_year"))


def language_options(docs: DataFrame) -> DataFrame:
    return docs.select(X.clean_text(F.col("language")).alias("language")).where("language IS NOT NULL").distinct().orderBy("language")


def _author() -> Column:
    return F.when(F.coalesce(F.col("author_display"), F.lit("")) == "", UNKNOWN_AUTHOR).otherwise(F.col("author_display"))


def _century() -> Column:
    return F.when(F.coalesce(F.col("century_label"), F.lit("")) == "", UNDATED).otherwise(F.col("century_label"))


def grouped(docs: DataFrame, key: Column, name: str) -> DataFrame:
    """A row for each document: its group, how many documents that holds, and id; groups and ids in order."""
    keyed = docs.select(key.alias(name), "id")
    sizes = keyed.groupBy(name).agg(F.count("*").alias("documents"))
    return keyed.join(sizes, name).select(name, "documents", "id").orderBy(name, "id")


def by_author(docs: DataFrame) -> DataFrame:
    return grouped(docs, _author(), "author")


def by_century(docs: DataFrame) -> DataFrame:
    return grouped(docs, _century(), "century")


def top(docs: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    """The n largest groups, ties by label."""
    return docs.groupBy(key.alias(name)).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), name).limit(n)


def top_authors(docs: DataFrame, n: int = 6) -> DataFrame:
    return top(docs, _author(), "author", n)


def top_centuries(docs: DataFrame, n: int = 6) -> DataFrame:
    return top(docs, _century(), "century", n)


def with_era(docs: DataFrame) -> DataFrame:
    """docs with century_number and era: by year, else by the label's leading digits, else the label itself."""
    lead = F.regexp_extract(F.coalesce("century_label", F.lit("")), r"^\s*(\d+)", 1)
    number = F.when(F.col("publication_year") > 0, X.century(F.col("publication_year"))).otherwise(F.nullif(lead, F.lit("")).try_cast("int"))
    return docs.withColumn("century_number", number).withColumn("era", F.coalesce(F.concat(X.ordinal(F.col("century_number")), F.lit(" century")), F.col("century_label"), F.lit(UNDATED)))


def era_sections(docs: DataFrame) -> DataFrame:
    """A row for each era: id, label, documents, span of years, number of year buckets."""
    eras = with_era(docs).groupBy("era", "century_number").agg(
        F.count("*").alias("documents"), F.min("publication_year").alias("first"), F.max("publication_year").alias("last"),
        (F.count_distinct("publication_year") + F.max(F.col("publication_year").isNull().cast("int"))).alias("buckets"))
    span = F.when(F.col("first").isNull(), UNDATED).otherwise(F.concat_ws("-", "first", "last"))
    return eras.select(X.era_id(F.col("era")).alias("id"), F.col("era").alias("label"), "century_number", "documents", span.alias("years"), "buckets")


def era_year_buckets(docs: DataFrame) -> DataFrame:
    """A row for each document: its era, the year (the undated ones together), how many documents share them, and id; in
    the order of the oldest-first sort."""
    label = F.coalesce(F.col("publication_year").cast("string"), F.lit(UNDATED))
    keyed = with_era(docs).select("era", label.alias("year_label"), "title", "id")
    sizes = keyed.groupBy("era", "year_label").agg(F.count("*").alias("documents"))
    return keyed.join(sizes, ["era", "year_label"]).orderBy("era", "year_label", "title", "id").select("era", "year_label", "documents", "id")


def era_rollup(docs: DataFrame) -> DataFrame:
    """Totals over the eras."""
    return era_sections(docs).agg(F.count("*").alias("sections"), F.sum("buckets").alias("year_buckets"), F.sum("documents").alias("documents"))


def browse_state(docs: DataFrame, sort: str = "recent", **filters: str) -> dict[str, DataFrame]:
    """What a browse page shows: filtered rows in order; options and overview over all rows."""
    return {"documents": sort_documents(browse(docs, **filters), sort), "languages": language_options(docs), "overview": overview(docs)}


# Views


def viewer(docs: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """Documents with the addresses of their files, joined with their pages and the pages' images."""
    d = docs.select(F.col("id").alias("document_id"), "slug", "storage_bucket", *(X.public_url(base, F.col("storage_bucket"), F.col(f"{k}_pdf_path")).alias(f"{k}_pdf_url") for k in ("source", "digitalized", "korean")))
    found = pages.join(d, "document_id")
    return found.select("document_id", "slug", "page_number", "source_pdf_url", "digitalized_pdf_url", "korean_pdf_url", X.public_url(base, F.col("storage_bucket"), F.col("image_path")).alias("image_url"))


def cards(docs: DataFrame) -> DataFrame:
    """What a card shows of a document."""
    numbers = F.concat_ws(" · ", F.concat(F.lit("Vol. "), F.nullif("volume", F.lit(""))), F.concat(F.lit("No. "), F.nullif("issue", F.lit(""))))
    return docs.select("id", "title", F.coalesce(F.nullif("author_display", F.lit("")), F.lit(UNKNOWN_AUTHOR)).alias("author"), F.coalesce(F.col("publication_year").cast("string"), F.lit("n.d.")).alias("year"),
        F.coalesce(F.nullif("journal_or_book", F.lit("")), F.lit("Independent manuscript")).alias("journal"), numbers.alias("numbers"), rights_label().alias("rights"))

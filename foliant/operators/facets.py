"""Everything that a browse page counts, from one pass over the catalog, and kept up to date from signed changes.

A document stands for a few facet values: itself, its author, century, language, rights bucket, and its era with its year. The
number of documents of each value is all that overview, language options, eras and year buckets need, so one scan and one
shuffle of partial counts give them together. Counts add up: a change is its old row with sign -1 and its new one with +1, and
a value whose count falls to 0 is gone, which lowers distinct counts and moves minima and maxima.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.functions import text as X
from foliant.operators import catalog as C
from foliant.streaming.state import latest, maintain

#: What facets are made of.
COLUMNS = ("author_display", "century_label", "language", "rights_assessment", "publication_year")
KEYS = ["facet", "label", "century_number", "year"]
_SCHEMA = "facet string, label string, century_number int, year int, documents long"


def _values() -> Column:
    """The facet values of a row of COLUMNS, century_number and era."""
    none = F.lit(None).cast("int")
    value = lambda facet, label, number=none, year=none: F.struct(F.lit(facet).alias("facet"), label.alias("label"), number.alias("century_number"), year.alias("year"))
    named = [value(f, X.clean_text(F.col(c))) for f, c in (("author", "author_display"), ("century", "century_label"), ("language", "language"))]
    era = value("era", F.col("era"), F.col("century_number").cast("int"), F.col("publication_year").cast("int"))
    return F.filter(F.array(value("all", F.lit("")), *named, value("rights", C.rights_bucket()), era), lambda v: v["label"].isNotNull())


def counts(docs: DataFrame, sign: Column | None = None) -> DataFrame:
    """facet, label, century_number, year, documents: how many documents have each value, added with their sign if one is
    given. Works on a batch and, in update mode, on a stream."""
    rows = C.with_era(docs).select(F.inline(_values()), *([sign.alias("_sign")] if sign is not None else []))
    return rows.groupBy(*KEYS).agg((F.count("*") if sign is None else F.sum("_sign")).cast("long").alias("documents"))


# What a page shows, from counts


def overview(found: DataFrame) -> DataFrame:
    """As catalog.overview of the documents."""
    is_ = lambda f: F.col("facet") == f
    total, public = (F.coalesce(F.sum(F.when(c, F.col("documents"))), F.lit(0)) for c in (is_("all"), is_("rights") & (F.col("label") == "public_domain")))
    return found.agg(
        total.alias("total_documents"), F.count_if(is_("author")).alias("authors"), F.count_if(is_("century")).alias("centuries"), F.count_if(is_("language")).alias("languages"),
        public.alias("public_domain"), F.greatest(total - public, F.lit(0)).alias("undetermined"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def language_options(found: DataFrame) -> DataFrame:
    """As catalog.language_options of the documents."""
    return found.where("facet = 'language'").select(F.col("label").alias("language")).orderBy("language")


def era_sections(found: DataFrame) -> DataFrame:
    """As catalog.era_sections of the documents."""
    eras = found.where("facet = 'era'").groupBy(F.col("label").alias("era"), "century_number").agg(
        F.sum("documents").alias("documents"), F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("buckets"))
    span = F.when(F.col("first").isNull(), C.UNDATED).otherwise(F.concat_ws("-", "first", "last"))
    return eras.select(X.era_id(F.col("era")).alias("id"), F.col("era").alias("label"), "century_number", "documents", span.alias("years"), "buckets")


def year_buckets(found: DataFrame) -> DataFrame:
    """The years of each era, the undated together, with their number of documents."""
    year = F.coalesce(F.col("year").cast("string"), F.lit(C.UNDATED)).alias("year_label")
    return found.where("facet = 'era'").groupBy(F.col("label").alias("era"), year).agg(F.sum("documents").alias("documents"))


# Changes


def signed(old: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """What leads from old to new as rows of COLUMNS with sign -1 or 1; rows that are equal in COLUMNS give none. Keys are unique."""
    row = lambda df, name: df.select(key, F.struct(*COLUMNS).alias(name))
    one = lambda s, name: F.when(F.col(name).isNotNull(), F.struct(F.lit(s).alias("sign"), F.col(name).alias("row")))
    both = row(new, "_new").withColumn("_old", F.lit(None).cast(row(new, "_new").schema["_new"].dataType)) if old is None else row(old, "_old").join(row(new, "_new"), key, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    changes = F.filter(F.array(one(-1, "_old"), one(1, "_new")), lambda c: c.isNotNull())
    return both.select(F.explode(changes).alias("c")).select("c.sign", "c.row.*")


def refresh(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of signed rows into a table of counts: state and table are touched for changed values only."""
    return maintain(counts(changes, F.col("sign")), path, checkpoint)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The counts that the table holds now."""
    return latest(spark, path, _SCHEMA, KEYS).where("documents > 0")


def page(docs: DataFrame, held: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Overview, languages, eras and years of a browse page from one scan. held: keeps the counts, which are few, in a table."""
    found = held(counts(docs))
    return {"overview": overview(found), "languages": language_options(found), "eras": era_sections(found), "years": year_buckets(found)}

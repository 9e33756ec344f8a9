"""Publish bundles as relations keyed by slug, from recorded reports and files, and their merge into the archive's tables.

A folder's reports are JSON strings; a missing, broken or non-object one counts as {}. Nothing is computed per folder on
the driver: all folders of a batch go through the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions import text as X
from foliant.functions import udfs as U
from foliant.operators import publish as P

#: The version that bundles name, and the storage bucket, where none is given.
VERSION, BUCKET = "pipeline-v1", "archive-files"
#: What PDF files say of themselves. Fixed values.
EMBEDDED = ("title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate")
NO_PAGES = "No page_XXX.tex files were found in the output directory."


def _object(json: Column) -> Column:
    """A JSON object as a variant; null for anything else."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def embedded_metadata(raw: Column) -> Column:
    """A PDF's own metadata (JSON) as a struct of the eight known keys, cleaned, null where nothing is left."""
    v = _object(raw)
    return F.struct(*(X.clean_text(_text(v, f"$.{k}")).alias(k) for k in EMBEDDED))


def override_values(json: Column) -> dict[str, Column]:
    """The values that a person has set, from an override file: below `overrides` if that is an object, cleaned, null
    where there is none."""
    v = _object(json)
    inner = F.try_variant_get(v, "$.overrides", "variant")
    held = F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(v)
    return {f: R.clean_field(f, _text(held, f"$.{f}")) for f in R.FIELDS}


def override_of_arguments(arguments: dict[str, Column]) -> dict[str, Column]:
    """The same from single values, as they come from a command line."""
    return {f: R.clean_field(f, arguments[f]) if f in arguments else R.none() for f in R.FIELDS}


def merged_override(old: dict[str, Column], new: dict[str, Column]) -> dict[str, Column]:
    """Set values after new ones are saved over them."""
    return {f: F.coalesce(new[f], old[f]) for f in R.FIELDS}


def override_json(values: dict[str, Column], updated_at: str) -> Column:
    """An override file's content; null where nothing is set, for then there is no file."""
    held = F.struct(*(c.alias(f) for f, c in values.items()))
    some = F.coalesce(*(c.cast("string") for c in values.values())).isNotNull()
    return F.when(some, F.to_json(F.struct(F.lit(updated_at).alias("updated_at"), held.alias("overrides"))))


def form_metadata(report: Column, override: Column, rights: Column, state: Column) -> dict[str, Column]:
    """What a form shows of author and years: set by a person, else the report's rights, else its effective metadata, else
    the rights check, else the state; "" where there is none."""
    r, o, c, s = _object(report), override_values(override), _object(rights), _object(state)
    name = lambda v, p: F.nullif(_text(v, p), F.lit(""))
    out = {}
    for f in R.RIGHTS_FIELDS:
        get = name if f == "author" else _text
        out[f] = F.coalesce(F.nullif(o[f].cast("string"), F.lit("")), get(r, f"$.rights_metadata.{f}"), get(r, f"$.effective_metadata.{f}"), _text(c, f"$.{f}"), _text(s, f"$.{f}"), F.lit(""))
    return out


def metadata_context(raw: Column, report: Column, override: Column, resume: Column, force: Column) -> Column:
    """What a run knows before it infers: a recorded report counts only on a resumed run that isn't forced to refresh; the
    PDF's own metadata go before recorded ones, the override always holds. Struct of JSON objects and `reused`."""
    r = F.when(resume & ~force, _object(report))
    used = F.coalesce(F.json_object_keys(F.to_json(r)), F.array())
    part = lambda k: F.when(F.schema_of_variant(F.try_variant_get(r, f"$.{k}", "variant")).startswith("OBJECT"), F.to_json(F.try_variant_get(r, f"$.{k}", "variant")))
    own = F.to_json(embedded_metadata(raw))
    empty = F.to_json(F.struct(*(F.lit(None).cast("string").alias(f) for f in ("title", "author", *R.YEARS))), {"ignoreNullFields": "false"})
    values, confidence = _inferred(F.when(resume & ~force, report))
    ai = F.struct(*(values[f].alias(f) for f in R.FIELDS), F.struct(*(confidence[f].alias(f) for f in R.FIELDS)).alias("confidence"))
    reused = F.size(used) > 0
    return F.struct(
        F.coalesce(F.nullif(own, F.lit("{}")), part("raw_pdf_metadata"), F.lit("{}")).alias("raw_pdf_metadata"),
        F.coalesce(part("deterministic_inference"), empty).alias("deterministic_inference"), F.to_json(ai).alias("ai_inference"),
        F.to_json(F.struct(*(c.alias(f) for f, c in override_values(override).items()))).alias("manual_override"), reused.alias("reused"))


def _inferred(report: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    v = _object(report)
    return R.normalized_ai({f: _text(v, f"$.ai_inference.{f}") for f in R.FIELDS}, {f: F.coalesce(_text(v, f"$.ai_inference.confidence.{f}"), F.lit("")) for f in R.FIELDS})


def metadata_report(name: Column, parts: dict, override: dict[str, Column], checked_at: str, raw: dict[str, Column] | None = None) -> Column:
    """The ten-key report of a refresh as JSON: effective and rights metadata with what a person has set over both."""
    effective = R.overridden(R.effective_metadata(**parts), override)
    rights = R.overridden(R.rights_metadata(**parts), {f: override[f] for f in R.RIGHTS_FIELDS})
    shown = lambda d: F.struct(*(c.alias(f) for f, c in d.items()))
    pick = lambda d, i: shown({f: v[i] for f, v in d.items()})
    return F.to_json(F.struct(
        F.lit(checked_at).alias("checked_at"), name.alias("paper_name"), shown(raw or parts["pdf"]).alias("raw_pdf_metadata"), shown(parts["structure"]).alias("deterministic_inference"),
        shown(parts["ai"]).alias("ai_inference"), shown(override).alias("manual_override"), pick(effective, 0).alias("effective_metadata"), pick(effective, 1).alias("effective_sources"),
        pick(rights, 0).alias("rights_metadata"), pick(rights, 1).alias("rights_sources")))


def rights_report(author: Column, year: Column, death: Column, sources: dict[str, Column], as_of: int, checked_at: str) -> Column:
    """The rights check of a document as JSON: what was judged, the judgement, and when."""
    a = R.assess_rights(author, year, death, sources, as_of)
    judged = ("assessment", "reason", "basis", "needs_manual_review", "source_summary", "warnings")
    return F.to_json(F.struct(F.lit(checked_at).alias("checked_at"), author.alias("author"), year.alias("publication_year"), death.alias("death_year"), *(a[k].alias(k) for k in judged)), {"ignoreNullFields": "false"})


def page_jobs(runs: DataFrame) -> DataFrame:
    """Jobs of runs (document_id, numbers, images): each page number with the image of the same place."""
    n = F.least(F.size("numbers"), F.size("images"))
    return runs.select("document_id", F.explode(F.arrays_zip(F.slice("numbers", F.lit(1), n).alias("numbers"), F.slice("images", F.lit(1), n).alias("images"))).alias("j")).select("document_id", F.col("j.numbers").alias("page_number"), F.col("j.images").alias("image"))


def existing(outputs: DataFrame, as_of: int) -> DataFrame:
    """What a bundle needs of each output folder, from what a run has left there; `error` says why there is none.

    outputs: folder, name, metadata, state, rights, layout, override (JSON strings or null), pdf (JSON of the source's own
    metadata), structure (struct of title, author and years, or null), digitalized, korean (LaTeX or null), found (the
    numbers of its page files), source_hash.
    """
    report, state, old = _object(F.col("metadata")), _object(F.col("state")), _object(F.col("rights"))
    some = lambda k: F.nullif(F.to_json(F.try_variant_get(report, f"$.{k}", "variant")), F.lit("{}"))
    override, sources = override_values(F.col("override")), {f: _text(report, f"$.rights_sources.{f}") for f in R.RIGHTS_FIELDS}
    recorded = some("effective_metadata").isNotNull()
    raw = embedded_metadata(F.col("pdf"))
    pdf = {f: F.coalesce(_text(report, f"$.raw_pdf_metadata.{f}"), F.when(some("raw_pdf_metadata").isNull(), raw[f])) for f in ("title", "author")}
    fields = ("title", "author", *R.YEARS)
    told = some("deterministic_inference")
    structure = {f: F.coalesce(_text(report, f"$.deterministic_inference.{f}"), F.when(told.isNull(), F.col(f"structure.{f}").cast("string"))) for f in fields}
    years = {f: structure[f].try_cast("int") for f in R.YEARS}
    fallback = R.fallback_metadata(pdf, structure | years, {f: _text(old, f"$.{f}") for f in R.RIGHTS_FIELDS}, F.col("name"))
    effective = {}
    for f in R.FIELDS:
        kind = "int" if f in R.YEARS else "string"
        held = F.try_variant_get(report, f"$.effective_metadata.{f}", kind)
        effective[f] = F.coalesce(override[f], F.when(recorded, held).otherwise(fallback[f].cast(kind)))
    numbers = lambda k: X.coerce_pages(F.from_json(F.to_json(F.try_variant_get(state, f"$.{k}", "variant")), "array<string>"))
    done = F.when(F.size(numbers("successful_pages")) > 0, numbers("successful_pages")).otherwise(F.coalesce("found", F.array().cast("array<int>")))
    asked = numbers("requested_pages")
    error = R.ladder([
        (F.col("digitalized").isNull(), F.concat(F.lit("Missing digitalized TeX: "), "folder", F.lit("/"), "name", F.lit("_digitalized.tex"))),
        (F.col("korean").isNull(), F.concat(F.lit("Missing Korean TeX: "), "folder", F.lit("/"), "name", F.lit("_Korean.tex"))),
        (F.size("done") == 0, F.lit(NO_PAGES)),
    ], R.none())
    values = outputs.select(
        "*", F.struct(*(c.alias(f) for f, c in effective.items())).alias("effective"), done.alias("done"), F.when(F.size(asked) > 0, asked).otherwise(done).alias("requested"),
        F.struct(*(c.alias(f) for f, c in sources.items())).alias("sources"), F.coalesce(some("raw_pdf_metadata"), F.when(F.col("pdf").isNotNull(), F.to_json(raw)), F.lit("{}")).alias("raw_json"),
        F.coalesce(told, F.to_json("structure"), F.lit("{}")).alias("structure_json"), F.coalesce(some("ai_inference"), F.lit("{}")).alias("ai_json"),
        F.coalesce(F.nullif(F.to_json(_object(F.col("layout"))), F.lit("{}")), F.lit("{}")).alias("layout_json"), F.to_json(F.struct(*(c.alias(f) for f, c in override.items()))).alias("override_json"))
    judged = R.assess_rights(F.col("effective.author"), F.col("effective.publication_year"), F.col("effective.death_year"), {f: F.col(f"sources.{f}") for f in R.RIGHTS_FIELDS}, as_of)
    out = values.select("folder", "name", "digitalized", "korean", "source_hash", "effective", "done", "requested", "raw_json", "structure_json", "ai_json", "layout_json", "override_json", judged.alias("judged"), error.alias("error"))
    return out


def assembled(outputs: DataFrame, files: DataFrame, at: str, bucket: str = BUCKET, version: str = VERSION) -> dict[str, DataFrame]:
    """The bundles of existing() outputs without error, as documents (25 columns), authors, pages, assets and snapshots,
    each with the folder and slug that it belongs to.

    files: folder, relative_path, asset_type, byte_size, mime_type.
    """
    e = F.col("effective")
    title = F.coalesce(F.nullif(e["title"], F.lit("")), F.col("name"))
    named = outputs.where("error IS NULL").withColumn("title", title).withColumn("slug", X.slug_of_folded(U.ascii_fold("title"), F.col("title")))
    root = F.concat(F.lit("documents/"), F.col("slug"), F.lit("/"))
    stored = files.join(named.select("folder", "slug"), "folder").withColumn("storage_bucket", F.lit(bucket))
    stored = stored.withColumn("storage_path", F.concat(root, X.storage_path(F.col("relative_path"), F.col("asset_type"), U.ascii_fold("relative_path"))))
    texts = P.page_texts(F.col("done"), X.split_pages(F.col("digitalized")), X.split_pages(F.col("korean")))
    paired = named.select("folder", "slug", F.explode(texts).alias("p")).select("folder", "slug", "p.page_number", *(X.latex_to_text(F.col(f"p.{c}")).alias(c) for c in ("digitalized_text", "korean_text")))
    assets = stored.select(F.col("folder").alias("document_id"), "relative_path", "storage_path", "asset_type")
    paths = P.page_assets(named.select(F.col("folder").alias("document_id"), F.explode("done").alias("page_number")), assets).withColumnRenamed("document_id", "folder")  # of numbers alone: no text is read for them
    pages = paired.join(paths, ["folder", "page_number"]).select("folder", "slug", "page_number", "image_path", F.col("tex_path").alias("digitalized_tex_path"), "digitalized_text", "korean_text", F.col("structure_path").alias("structure_json_path"))
    kinds = ("source_pdf", "digitalized_pdf", "korean_pdf")
    key = P.key_assets(assets).where(F.col("asset_type").isin(*kinds)).groupBy(F.col("document_id").alias("folder")).agg(*(F.max(F.when(F.col("asset_type") == k, F.col("storage_path"))).alias(f"{k}_path") for k in kinds))
    cover = paths.join(named.select("folder", F.get("done", F.lit(0)).alias("page_number")), ["folder", "page_number"]).select("folder", F.col("image_path").alias("cover_image_path"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = named.join(key, "folder", "left").join(cover, "folder", "left").select(
        "folder", "slug", "title", e["author"].alias("author_display"), e["publication_year"].alias("publication_year"), X.century_label(e["publication_year"]).alias("century_label"), e["language"].alias("language"),
        e["journal_or_book"].alias("journal_or_book"), e["volume"].alias("volume"), e["issue"].alias("issue"), e["pages"].alias("page_range"), e["doi"].alias("doi"), null("string").alias("summary"),
        F.lit(version).alias("pipeline_version"), F.lit(at).alias("published_at"), F.lit(at).alias("updated_at"), F.lit("published").alias("status"), F.lit(bucket).alias("storage_bucket"),
        "source_pdf_path", "digitalized_pdf_path", "korean_pdf_path", "cover_image_path", F.size("done").alias("page_count"), F.size("requested").alias("requested_page_count"),
        F.col("judged.assessment").alias("rights_assessment"), "source_hash")
    authors = named.where(F.coalesce(e["author"], F.lit("")) != "").select("folder", "slug", e["author"].alias("display_name"), X.sort_name(e["author"]).alias("sort_name"), null("int").alias("birth_year"), e["death_year"].alias("death_year"))
    j = F.col("judged")
    rights = F.struct(*(e[f].alias(f) for f in R.RIGHTS_FIELDS), *(j[k].alias(k) for k in ("assessment", "reason", "basis", "needs_manual_review", "source_summary", "warnings")))
    snapshots = named.select(
        "folder", "slug", F.col("raw_json").alias("raw_pdf_metadata"), F.col("structure_json").alias("deterministic_metadata"), F.col("ai_json").alias("ai_metadata"), F.to_json(e).alias("effective_metadata"),
        F.col("override_json").alias("manual_override"), F.to_json(rights).alias("rights_metadata"), F.col("layout_json").alias("layout_profile"))
    return {"documents": rows, "authors": authors, "pages": pages, "assets": stored.select("folder", "slug", "relative_path", "asset_type", "storage_bucket", "storage_path", "mime_type", "byte_size"), "snapshots": snapshots}


def _of_last(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The rows of the folders that have the last word on their slug."""
    return rows.join(last.select("folder", "slug"), ["folder", "slug"], "left_semi")


def published(current: dict[str, DataFrame], bundles: dict[str, DataFrame], policy: str = "overwrite", hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The archive's six tables (documents, authors, document_authors, document_pages, document_assets,
    document_metadata_snapshots) after bundles are published.

    Documents merge by slug and keep their ids, authors by sort name; pages, assets, snapshots and author links of the
    documents published are replaced. Of folders that share a slug the last counts. With the policy "skip", documents whose
    slug is there already stay as they are. hold: keeps the new documents and authors, which the other tables are made from, in a
    table, where all six are wanted.
    """
    docs = current["documents"]
    last = bundles["documents"].groupBy("slug").agg(F.max("folder").alias("folder"))
    if P.conflict_policy(policy) == "skip":
        last = last.join(docs.select("slug"), "slug", "left_anti")
    incoming = {k: _of_last(df, last) for k, df in bundles.items()}
    merged = P.upsert(docs, incoming["documents"].drop("folder"), "slug")
    fresh = P.identities(merged.where("id IS NULL").drop("id"), docs, "slug")
    documents = hold(merged.where("id IS NOT NULL").unionByName(fresh))
    ids = documents.join(last.select("slug"), "slug", "left_semi").select("slug", F.col("id").alias("document_id"))
    named = incoming["authors"].where("sort_name IS NOT NULL")
    authors = P.upsert(current["authors"], _last_author(named), "sort_name")
    authors = hold(authors.where("id IS NOT NULL").unionByName(P.identities(authors.where("id IS NULL").drop("id"), current["authors"], "sort_name")))
    linked = named.join(ids, "slug").join(authors.select("sort_name", F.col("id").alias("author_id")), "sort_name").select("document_id", "author_id", F.lit(1).alias("ordinal"))
    child = lambda k, *drop: incoming[k].join(ids, "slug").drop("folder", "slug", *drop)
    assets = child("assets", "relative_path").dropDuplicates(["document_id", "storage_path"])
    new = {"document_authors": linked, "document_pages": child("pages"), "document_assets": assets, "document_metadata_snapshots": child("snapshots")}
    return {"documents": documents, "authors": authors} | {t: P.replace_children(current[t], rows.select(*current[t].columns), ids, "document_id") for t, rows in new.items()}


def _last_author(named: DataFrame) -> DataFrame:
    """One row for each sort name: that of the last folder."""
    return named.groupBy("sort_name").agg(F.max_by(F.struct("display_name", "birth_year", "death_year"), "folder").alias("a")).select("sort_name", "a.*")

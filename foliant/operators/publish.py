"""Publishing: queue, bundles, upserts, and the decisions that a run takes about its pages. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions import text as X
from foliant.operators.order import numbered


def queue(ready: DataFrame, limit: int | None = None) -> DataFrame:
    """Ready folders (folder, name, slug, priority_rank) with pos, status and reason: one of each slug is queued, in order.

    A positive limit ends the queue; what is skipped after the last queued one is not reported.
    """
    order = [F.col("priority_rank"), F.lower("folder"), F.col("folder")]
    named = ready.where("name IS NOT NULL")
    first = Window.partitionBy("slug").orderBy(*order)
    marked = named.withColumn("_n", F.row_number().over(first)).withColumn("_holder", F.first("folder").over(first))
    status = F.when(F.col("_n") == 1, "queued").otherwise("skipped_duplicate_slug")
    reason = F.when(F.col("_n") > 1, F.concat(F.lit("Slug '"), F.col("slug"), F.lit("' is already queued for "), F.col("_holder"), F.lit(".")))
    found = marked.select("folder", "name", "slug", "priority_rank", status.alias("status"), reason.alias("reason"))
    lost = ready.where("name IS NULL").select("folder", "name", "slug", "priority_rank", F.lit("skipped_unresolved_name").alias("status"), F.lit("Could not infer output name.").alias("reason"))
    found = found.unionByName(lost)
    if not limit or limit < 1:
        return found
    # The limit's last entry is found without ranking all rows in one task; what precedes it is a filter.
    last = found.where("status = 'queued'").orderBy(*order).limit(limit).agg(F.count("*").alias("_n"), F.max(F.struct("priority_rank", F.lower("folder").alias("l"), "folder")).alias("_last"))
    place = F.struct("priority_rank", F.lower("folder").alias("l"), "folder")
    return found.crossJoin(F.broadcast(last)).where((F.col("_n") < limit) | (place <= F.col("_last"))).drop("_n", "_last")  # last is one row


def conflict_policy(value: str | None) -> str:
    v = (value or "overwrite").strip().lower()
    if v not in ("overwrite", "skip"):
        raise ValueError(f"unknown slug conflict policy: {value}")
    return v


def resolve_conflicts(incoming: DataFrame, existing: DataFrame, policy: str) -> DataFrame:
    """What happens to each incoming document: insert, overwrite or skipped, with the existing id and title."""
    there = existing.select("slug", F.col("id").alias("existing_id"), F.col("title").alias("existing_title"))
    hit = "skipped" if conflict_policy(policy) == "skip" else "overwrite"
    return incoming.join(there, "slug", "left").withColumn("action", F.when(F.col("existing_id").isNotNull(), hit).otherwise("insert"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table after a merge by column: a key's row takes the columns that incoming has and keeps its others; new keys are
    added. Of rows that repeat a key in incoming the last by `order` counts (without one, the greatest row)."""
    fields = F.struct(*incoming.columns)
    last = incoming.groupBy(key).agg((F.max_by(fields, order) if order else F.max(fields)).alias("new")).withColumnRenamed(key, "_key")
    both = current.withColumn("_old", F.lit(True)).join(last, F.col(key) == F.col("_key"), "full")
    has = set(incoming.columns)
    return both.select(*[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in has else F.col(c) for c in current.columns])


def replace_children(current: DataFrame, incoming: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A child table after the children of some parents are deleted and written anew."""
    return current.join(parents.select(key).distinct(), key, "left_anti").unionByName(incoming)


def identities(rows: DataFrame, current: DataFrame, order: str) -> DataFrame:
    """rows with ids after the greatest in current, in order; placed by ranges, so no task ranks all rows."""
    most = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))  # one row
    return numbered(rows.crossJoin(F.broadcast(most)), [F.col(order)], "id", F.col("_most")).drop("_most")


def page_assets(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Pages (document_id, page_number) with the stored paths of image, source and structure, null where there is none."""
    n = F.col("page_number")
    names = {"image": F.concat(F.lit("images/"), X.page_name(n, "png")), "tex": X.page_name(n), "structure": F.format_string("page_%03d_structure.json", n)}
    wanted = pages.select("document_id", "page_number", F.explode(F.create_map(*(x for k, c in names.items() for x in (F.lit(k), c)))).alias("k", "relative_path"))
    found = wanted.join(assets.select("document_id", "relative_path", "storage_path"), ["document_id", "relative_path"], "left")
    return found.groupBy("document_id", "page_number").agg(*(F.max(F.when(F.col("k") == k, F.col("storage_path"))).alias(f"{k}_path") for k in names))


def page_texts(numbers: Column, originals: Column, translations: Column) -> Column:
    """Pages with texts by their place in the lists, not by number; a missing text is empty."""
    text = lambda texts, i: F.coalesce(F.get(texts, i), F.lit(""))
    paired = lambda o, t: F.transform(numbers, lambda n, i: F.struct(n.alias("page_number"), text(o, i).alias("digitalized_text"), text(t, i).alias("korean_text")))
    return X.let(originals, lambda o: X.let(translations, lambda t: paired(o, t)))  # the lists are made once, not for each number


def key_assets(assets: DataFrame, order: str = "relative_path") -> DataFrame:
    """The stored path of each asset type; the last in order of paths holds, plain artifacts have none.

    As text page_1000 comes before page_999; where pages may be more than 999, order names a column that sorts them by number.
    """
    return assets.where("asset_type <> 'artifact'").groupBy("document_id", "asset_type").agg(F.max_by("storage_path", order).alias("storage_path"))


def author_bridge(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors (sort_name, display_name) and the links of documents with them."""
    named = docs.select(F.col("id").alias("document_id"), "author_display", X.sort_name(F.col("author_display")).alias("sort_name")).where("sort_name IS NOT NULL")
    return named.groupBy("sort_name").agg(F.min("author_display").alias("display_name")), named.select("document_id", "sort_name", F.lit(1).alias("ordinal"))


def batch_counts(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(F.count_if(s != "skipped").alias("queued"), F.count_if(s.startswith("skipped")).alias("skipped"), F.count_if(s == "published").alias("published"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "dry_run").alias("dry_run"))


def publish_report(status: Column, reason: Column, slug: Column) -> Column:
    return F.to_json(F.struct(status.alias("status"), reason.alias("reason"), slug.alias("slug")))


def _report(status: str, reason: Column, slug: Column, **more: Column | None) -> Column:
    """A report as JSON that keeps nulls; keys without a column are left out."""
    null = F.lit(None).cast("string")
    parts = {"status": F.lit(status), "reason": reason, "slug": slug} | {k: c for k, c in more.items() if c is not None} | {"published_at": null}
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())), {"ignoreNullFields": "false"})


def dry_run_report(slug: Column, bucket: Column, root: Column, assets: Column, pages: Column, policy: str | None = None) -> Column:
    """What a publication would have done."""
    return _report("dry_run", F.lit(None).cast("string"), slug, storage_bucket=bucket, storage_root=root, uploaded_assets=assets, published_pages=pages, slug_conflict_policy=F.lit(policy) if policy else None)


def disabled_report(reason: str = "Publishing disabled by configuration.") -> Column:
    return _report("disabled", F.lit(reason), F.lit(None).cast("string"))


def failed_report(slug: Column, reason: Column, policy: str | None = None, health: Column | None = None) -> Column:
    """Why a publication failed; health is a struct of status and reason."""
    return _report("failed", reason, slug, slug_conflict_policy=F.lit(policy) if policy else None, health_check=health)


def result_rows(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """The entries of a batch with what their reports (folder, report as JSON, report_path) say; entries without stay out."""
    r, kinds = F.col("report"), {"status": "string", "reason": "string", "published_at": "string", "slug_conflict_policy": "string", "overwrote_existing": "boolean"}
    told = reports.select("folder", "report_path", *(F.get_json_object(r, f"$.{k}").cast(t).alias(k) for k, t in kinds.items()))
    return entries.drop("status", "reason").join(told, "folder")


def batch(entries: DataFrame, dry_run: bool) -> DataFrame:
    """One report for each queued entry; an entry with an error fails alone."""
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("dry_run" if dry_run else "published")
    return entries.where("status = 'queued'").select("folder", "slug", status.alias("status"), F.col("error").alias("reason"), publish_report(status, F.col("error"), F.col("slug")).alias("report"))


def quality_report(name: Column, pages: Column, failed: Column, digitalized: Column, korean: Column, date: str) -> Column:
    """The report of a run as JSON."""
    pdf = lambda ok, end: F.struct(ok.alias("compiled"), F.when(ok, F.concat(name, F.lit(end))).alias("file"))
    return F.to_json(F.struct(name.alias("paper_name"), F.lit(date).alias("date"), (pages + F.size(failed)).alias("total_pages"), F.struct(pages.alias("successful_pages"), failed.alias("failed_pages"), (F.size(failed) > 0).alias("partial_output")).alias("transcription"),
        pdf(digitalized, "_digitalized.pdf").alias("digitalized_pdf"), pdf(korean, "_Korean.pdf").alias("korean_pdf")), {"ignoreNullFields": "false"})


def merged_pages(requested: DataFrame, failures: DataFrame) -> DataFrame:
    """Requested pages without those that failed."""
    return requested.join(failures, ["document_id", "page_number"], "left_anti")


def reusable_pages(pages: DataFrame, retry: DataFrame, structures: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages whose cached files a resumed run keeps."""
    key = ["document_id", "page_number"]
    return pages.join(structures, key, "left_semi").join(sources, key, "left_semi").join(retry, key, "left_anti")


def resolve_pages(spec: Column, retry: Column, total: Column, state: Column) -> Column:
    """Requested places, retried numbers and the pages of a run: the retried ones, else the range, else all; recorded pages stay."""
    chosen, again = X.parse_page_range(spec, total), X.parse_page_range(retry, total)
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    places = F.when(F.size(again) > 0, again).when(F.size(chosen) > 0, chosen).otherwise(every)
    return F.struct(places.alias("places"), F.transform(again, lambda i: i + 1).alias("retry"), F.array_sort(F.array_union(F.coalesce(state, F.array().cast("array<int>")), F.transform(places, lambda i: i + 1))).alias("requested"))


def first_cached(pages: DataFrame) -> DataFrame:
    """The first page of each document with a valid source: a preferred one before others, then by number."""
    fit = pages.where(F.col("has_structure") & X.is_latex(F.col("tex")))
    return fit.groupBy("document_id").agg(F.min_by("page_number", F.struct(F.coalesce("preferred", F.lit(1 << 30)), "page_number")).alias("page_number"))


def rebuild(old: dict[str, Column], new: dict[str, Column], retry: Column) -> Column:
    """Whether later stages must run again: something was retried, or an input differs, null counting as a value."""
    out = retry
    for k in old:
        out = out | ~old[k].eqNullSafe(new[k])
    return out


def first_structure(pages: DataFrame) -> DataFrame:
    """Metadata of the first page (document_id, page_number, json) of each document that gives a title, author or year."""
    found = pages.select("document_id", "page_number", F.struct(*(c.alias(k) for k, c in R.structure_metadata(F.col("json")).items())).alias("m"))
    usable = found.where(F.coalesce("m.title", "m.author", F.col("m.publication_year").cast("string")).isNotNull())
    return usable.groupBy("document_id").agg(F.min_by("m", "page_number").alias("m")).select("document_id", "m.*")


def cached_images(requested: DataFrame, images: DataFrame) -> DataFrame:
    """The images of a document's requested pages if there are all of them, else none."""
    there = requested.join(images.select("document_id", "page_number", F.lit(True).alias("_there")), ["document_id", "page_number"], "left")
    names = F.transform(F.array_sort(F.collect_list("page_number")), lambda n: F.concat(F.lit("images/"), X.page_name(n, "png")))
    return there.groupBy("document_id").agg(F.when(F.every(F.coalesce("_there", F.lit(False))), names).otherwise(F.array().cast("array<string>")).alias("images"))


def reassessed(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """Recorded rights with a new assessment over them; its values win even where they are null."""
    new = [c for c in fresh.columns if c != "document_id"]
    return recorded.drop(*new).join(fresh, "document_id", "left")


def cached_source(candidates: list[tuple[Column, Column]]) -> Column:
    """The first path, of (path, whether it exists), that is there."""
    return F.coalesce(*(F.when((path != "") & there, path) for path, there in candidates))


def log_tail(log: Column, n: int = 200) -> Column:
    """The last n lines of a log."""
    lines = F.split(log, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")

"""State of a document's processing: one wide row for each output folder, from its reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions import text as X

#: Report -> the end of its file's name. Fixed values.
REPORTS = {
    "quality": "_quality_report.json",
    "publish": "_publish_report.json",
    "state": "_pipeline_state.json",
    "metadata": "_metadata.json",
    "override": "_metadata_override.json",
    "rights": "_rights_check.json",
}
#: End of a log's name -> (target, severity). Fixed values.
LOGS = {
    "_digitalized.log": ("digitalized", "warning"),
    "_Korean.log": ("korean", "warning"),
    "_digitalized_error.log": ("digitalized", "error"),
    "_Korean_error.log": ("korean", "error"),
}


def reports(files: DataFrame) -> DataFrame:
    """One row for each folder: its first file of each kind, and which others there are."""
    top, path = ~F.col("path").contains("/"), F.col("path")
    first = [F.min_by(F.when(top & path.endswith(end), F.col("content")), F.when(top & path.endswith(end), path)).alias(k) for k, end in REPORTS.items()]
    there = [F.max(top & path.endswith(end)).alias(n) for n, end in (("has_quality_report", REPORTS["quality"]), ("has_publish_report", REPORTS["publish"]), ("digitalized_pdf", "_digitalized.pdf"), ("korean_pdf", "_Korean.pdf"), ("digitalized_error", "_digitalized_error.log"), ("korean_error", "_Korean_error.log"))]
    return files.groupBy("folder").agg(*first, *there)


def log_lines(files: DataFrame) -> DataFrame:
    """Lines of compiler logs with target and severity."""
    path = F.col("path")
    kind = R.ladder([(path.endswith(end), F.struct(F.lit(t).alias("target"), F.lit(s).alias("severity"))) for end, (t, s) in LOGS.items()], F.lit(None))
    return files.where(path.endswith(".log") & ~path.contains("/")).select("folder", "path", kind.alias("k"), F.explode(F.split("content", "\n")).alias("line")).where("k IS NOT NULL").select("folder", "path", "k.*", "line")


def compile_warnings(lines: DataFrame) -> DataFrame:
    """Warnings by target, severity and message: number, and the first file."""
    found = lines.withColumn("message", X.log_message(F.col("line"))).where("message IS NOT NULL")
    return found.groupBy("folder", "target", "severity", "message").agg(F.count("*").alias("count"), F.min("path").alias("path"))


def warning_summary(warnings: DataFrame, most: int = 3) -> DataFrame:
    """Total and a line on the first warnings of each folder: errors first, then the most frequent."""
    order = Window.partitionBy("folder").orderBy(F.col("severity") != "error", F.desc("count"), "target", "message")
    line = F.concat(F.col("target"), F.lit(": "), X.truncate(F.col("message")), F.lit(" x"), F.col("count").cast("string"))
    ranked = warnings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    first = ranked.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), ", ").alias("compile_warning_summary"))
    return warnings.groupBy("folder").agg(F.sum("count").alias("compile_warning_count")).join(first, "folder")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def summary(files: DataFrame, as_of: str) -> DataFrame:
    """The state of every folder as of a time. Reports that are no JSON object count as absent values."""
    wide = reports(files)
    objects = {k: F.when(F.col(k).rlike(r"^[ \t\n\r]*\{"), F.try_parse_json(k)) for k in REPORTS}
    v = wide.withColumns({f"_{k}": c for k, c in objects.items()}).drop(*REPORTS)
    q, s, p, m, r, o = (F.col(f"_{k}") for k in ("quality", "state", "publish", "metadata", "rights", "override"))
    strings = lambda c, path: F.coalesce(_get(c, path, "array<string>"), F.array().cast("array<string>"))
    failed = F.array_sort(F.array_union(X.coerce_pages(strings(q, "$.transcription.failed_pages")), X.coerce_pages(strings(s, "$.failed_pages"))))
    requested, done = X.coerce_pages(strings(s, "$.requested_pages")), X.coerce_pages(strings(s, "$.successful_pages"))
    successful = F.coalesce(X.coerce_int(_get(q, "$.transcription.successful_pages")), F.nullif(F.size(done), F.lit(0)))
    blank = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(blank(F.coalesce(_get(o, "$.overrides.title"), _get(o, "$.title"))), blank(_get(m, "$.effective_metadata.title")), blank(_get(q, "$.paper_name")), blank(_get(s, "$.paper_name")), F.col("folder"))
    silent = F.to_timestamp_ntz(F.lit(as_of)).cast("timestamp").cast("long") - F.try_to_timestamp(F.replace(_get(s, "$.last_progress_at"), F.lit("T"), F.lit(" "))).cast("long")
    idle = F.when(silent < 0, F.lit(0)).otherwise(silent)
    limit = R.hung_threshold(*(X.coerce_int(_get(s, f"$.runtime_settings.{k}")) for k in ("api_timeout_sec", "api_retry_attempts", "latex_compile_timeout_sec")))
    review = R.rights_review(_get(r, "$.assessment"), _get(r, "$.reason"), _get(r, "$.source_summary"), _get(r, "$.warnings", "array<string>"),
        F.when(F.schema_of_variant(F.variant_get(r, "$.needs_manual_review", "variant")) == "BOOLEAN", _get(r, "$.needs_manual_review", "boolean")), {f: _get(m, f"$.rights_sources.{f}") for f in R.RIGHTS_FIELDS})
    known = lambda v, at: {f: _get(v, f"$.{at}{f}") for f in R.FIELDS}
    manual = {f: F.coalesce(_get(o, f"$.overrides.{f}"), _get(o, f"$.{f}"), _get(m, f"$.manual_override.{f}")) for f in R.FIELDS}
    fields = R.metadata_review_rows(known(m, "effective_metadata."), known(m, "effective_sources."), known(m, "ai_inference."), known(m, "ai_inference.confidence."), known(m, "ai_inference.evidence."), manual)
    base = v.select(
        fields.alias("_fields"), _get(m, "$.ai_inference.error").alias("_ai_error"), F.coalesce(X.clean_text(_get(m, "$.ai_inference.status")), F.lit("not_run")).alias("metadata_ai_status"),
        F.array_sort(F.filter(F.array(*(F.when(c.isNotNull(), F.lit(f)) for f, c in manual.items())), lambda x: x.isNotNull())).alias("metadata_override_fields"), *(_get(s, f"$.{c}").alias(c) for c in ("last_successful_stage", "last_progress_at", "last_progress_note", "stdout_log_path", "stderr_log_path")),
        "folder", title.alias("title"), "has_quality_report", "has_publish_report", failed.alias("failed_pages"), successful.alias("successful_pages"),
        F.coalesce(X.coerce_int(_get(q, "$.total_pages")), F.nullif(F.size(requested), F.lit(0)), successful + F.size(failed)).alias("total_pages"),
        (F.coalesce(_get(q, "$.transcription.partial_output", "boolean"), F.lit(False)) | (F.size(failed) > 0)).alias("partial_output"),
        *(R.pdf_compiled(F.variant_get(q, f"$.{k}_pdf.compiled", "variant"), F.col(f"{k}_pdf"), F.col(f"{k}_error")).alias(f"{k}_compiled") for k in ("digitalized", "korean")),
        F.coalesce(blank(_get(p, "$.status")), F.lit("missing")).alias("publish_status"), blank(_get(p, "$.reason")).alias("publish_reason"), _get(p, "$.slug").alias("slug"), _get(p, "$.published_at").alias("published_at"),
        R.publish_issue(F.coalesce(_get(p, "$.status"), F.lit("missing")), _get(p, "$.reason"), _get(p, "$.health_check.status"), _get(p, "$.health_check.reason")).alias("_issue"), review.alias("_review"),
        _get(s, "$.current_stage").alias("current_stage"), _get(s, "$.last_error").alias("last_error"), idle.alias("seconds_since_progress"), limit.alias("hung_threshold_sec"))
    base = base.withColumns({
        "metadata_review_fields": F.transform(F.filter("_fields", lambda x: x["review_needed"]), lambda x: x["field"]), "metadata_review_needed": F.exists("_fields", lambda x: x["review_needed"]),
        "metadata_review_summary": R.metadata_review_summary(F.col("_fields"), F.col("_ai_error"))})
    base = base.select("*", "_issue.*", "_review.*").drop("_issue", "_review", "_fields", "_ai_error")
    base = base.join(warning_summary(compile_warnings(log_lines(files))), "folder", "left").fillna({"compile_warning_count": 0})
    base = base.withColumn("hung_suspected", R.hung(F.col("current_stage"), F.col("seconds_since_progress"), F.col("hung_threshold_sec")))
    return base.withColumns({"publish_ready": R.publish_ready(), "next_action": R.next_action(), "priority_rank": R.priority_rank()})


def ranked(summaries: DataFrame) -> DataFrame:
    """The most urgent first."""
    return summaries.orderBy("priority_rank", F.lower("folder"), "folder")


def counts(summaries: DataFrame) -> DataFrame:
    """Totals over all folders."""
    tests = {
        "published_outputs": F.col("publish_status") == "published", "ready_to_publish_outputs": F.col("publish_ready"), "publish_failed_outputs": F.col("publish_status") == "failed",
        "metadata_review_outputs": F.col("metadata_review_needed"), "rights_review_outputs": F.col("rights_needs_manual_review"), "compile_warning_outputs": F.col("compile_warning_count") > 0, "partial_outputs": F.col("partial_output"),
        "hung_suspected_outputs": F.col("hung_suspected"), "missing_quality_reports": ~F.col("has_quality_report"),
    }
    return summaries.agg(F.count("*").alias("total_outputs"), *(F.count_if(t).alias(n) for n, t in tests.items()))


def summary_table(summaries: DataFrame) -> DataFrame:
    """What an operator's table shows of each folder, "-" for what is missing."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-")).alias(c)
    failed = F.coalesce(F.nullif(F.array_join(F.col("failed_pages").cast("array<string>"), ", "), F.lit("")), F.lit("-"))
    return summaries.select("folder", "title", F.coalesce(F.nullif("total_pages", F.lit(0)).cast("string"), F.lit("-")).alias("total_pages"), failed.alias("failed_pages"), "publish_status", *(dash(c) for c in ("metadata_review_summary", "rights_review_summary", "compile_warning_summary", "publish_issue_summary")), "next_action")

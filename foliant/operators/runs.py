"""Runs over a document: the state one starts in, and the regrouping of its pages for translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X

#: What a run records of pages and layout, and hands on to the next. Fixed values.
CARRIED = {
    "last_rendered_pages": "array<int>",
    "failed_pages": "array<int>",
    "failed_page_details": "array<string>",
    "successful_pages": "array<int>",
    "layout_profile": "string",
    "last_successful_stage": "string",
}
#: Where a run begins, and its note there. Fixed values.
FIRST_STAGE, FIRST_NOTE = "step0_images", "Preparing page images."


def initial_state(runs: DataFrame, prior: DataFrame, at: str) -> DataFrame:
    """runs (document_id, requested_pages) in the state they start in: what an earlier run recorded (prior: document_id and
    any of CARRIED) is carried over, lists being empty where nothing was; errors are not."""
    none = {c: F.array().cast(k) if k.startswith("array") else F.lit(None).cast(k) for c, k in CARRIED.items()}
    old = prior.select(F.col("document_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in CARRIED if c in prior.columns))
    held = runs.join(old, F.col("document_id") == F.col("_id"), "left")
    carried = [F.coalesce(F.col(f"_{c}"), none[c]).alias(c) if c in prior.columns else none[c].alias(c) for c in CARRIED]
    return held.select(*runs.columns, *carried, F.lit(FIRST_STAGE).alias("current_stage"), F.lit(None).cast("string").alias("last_error"), F.lit(at).alias("last_progress_at"), F.lit(FIRST_NOTE).alias("last_progress_note"))


def page_groups(pages: Column, size: int) -> Column:
    """Pages in groups of `size`, in order; one group where there are no more than that."""
    n = lambda ps: F.ceil(F.size(ps) / size).cast("int")
    cut = lambda ps: F.transform(F.sequence(F.lit(0), n(ps) - 1), lambda i: F.slice(ps, i * size + 1, F.lit(size)))
    return X.let(pages, lambda ps: F.when(F.size(ps) > size, cut(ps)).otherwise(F.array(ps)))  # made once, not for each group


def translation_chunks(sources: DataFrame, key: str, source: Column, size: int) -> DataFrame:
    """A row for each chunk of a document to translate: key, chunk (from 1), pages, and the chunk as one document."""
    groups = sources.select(key, F.posexplode(page_groups(X.split_pages(source), size)).alias("p", "g"))
    return groups.select(key, (F.col("p") + 1).alias("chunk"), F.size("g").alias("pages"), X.merge_pages(F.col("g")).alias("source"))


def translated(answers: DataFrame, key: str) -> DataFrame:
    """answers (key, chunk, answer of a model) as one document each and the notes, labelled by chunk; an answer without a
    marked block counts as a whole."""
    a = F.col("answer")
    block = X.normalize_latex(F.coalesce(F.nullif(X.extract_block(a, "BEGIN_KOREAN_LATEX"), F.lit("")), a))
    note = F.nullif(X.extract_block(a, "TRANSLATION_NOTES"), F.lit(""))
    told = F.when(note.isNotNull(), F.concat(F.lit("--- Chunk "), F.col("chunk").cast("string"), F.lit(" ---\n"), note))
    rows = answers.select(key, F.struct("chunk", block.alias("page"), told.alias("note")).alias("r"))
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))  # the chunks of one document
    notes = F.filter(F.transform("r", lambda x: x["note"]), lambda x: x.isNotNull())
    return held.select(key, X.merge_pages(F.transform("r", lambda x: x["page"])).alias("translation"), notes.alias("notes"))

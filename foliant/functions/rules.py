"""Rules on metadata, rights and operations: ordered ladders as Column expressions, the first match wins."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as X

#: The bibliographic fields and their labels. Fixed values.
FIELDS = {
    "title": "Title",
    "author": "Author",
    "publication_year": "Publication year",
    "death_year": "Death year",
    "journal_or_book": "Journal or book",
    "volume": "Volume",
    "issue": "Issue",
    "pages": "Pages",
    "language": "Language",
    "doi": "DOI",
}
YEARS = ("publication_year", "death_year")
RIGHTS_FIELDS = ("author", *YEARS)
#: Authors' deaths that are known without a source. Fixed values.
KNOWN_DEATHS = {"emmy noether": 1935, "albert einstein": 1955}

Fields = Mapping[str, Column]


def none() -> Column:
    return F.lit(None).cast("string")


def ladder(rungs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(rungs):
        out = F.when(condition, value).otherwise(out)
    return out


def clean_field(name: str, c: Column) -> Column:
    return X.coerce_year(c) if name in YEARS else X.clean_text(c)


# Metadata


def structure_metadata(json: Column) -> dict[str, Column]:
    """Title, author and years that a page's structure gives; the year is the first from 1600 on anywhere in it."""
    v = F.try_parse_json(json)
    get = lambda p: X.clean_text(F.try_variant_get(v, p, "string"))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    author = X.clean_text(F.regexp_replace(get("$.article_header.author_line"), r"^(?i:by|von)\s+", ""))
    year = X.found(json, r"\b(1[6-9]\d{2}|20\d{2})\b").try_cast("int")
    death = ladder([(F.lower(author) == a, F.lit(y)) for a, y in KNOWN_DEATHS.items()], F.lit(None).cast("int"))
    return {k: F.when(ok, c) for k, c in {"title": get("$.article_header.title_text"), "author": author, "publication_year": year, "death_year": death}.items()}


def normalized_ai(values: Fields, confidence: Fields) -> tuple[dict[str, Column], dict[str, Column]]:
    """Cleaned values, and confidences: an unknown one is low where there is a value, none where not."""
    clean = {f: clean_field(f, c) for f, c in values.items()}
    rate = {}
    for f, c in confidence.items():
        word = F.lower(X.strip(c))
        rate[f] = F.when(word.isin("high", "medium", "low", "none"), word).when(clean[f].isNotNull(), "low").otherwise("none")
    return clean, rate


def inference(found: Column, error: Column) -> dict[str, Column]:
    """What a model's answer gives: the fields and confidences of its first JSON object (found, null for none), status and
    error; an error of the call leaves all fields empty."""
    v = F.when(error.isNull(), F.try_parse_json(found))
    get = lambda p: F.try_variant_get(v, p, "string")
    values, confidence = normalized_ai({f: get(f"$.{f}") for f in FIELDS}, {f: F.coalesce(get(f"$.confidence.{f}"), F.lit("")) for f in FIELDS})
    some = F.size(F.coalesce(F.json_object_keys(found), F.array())) > 0
    status = F.when(error.isNotNull(), "error").when(some, "ok").otherwise("empty")
    told = F.when(error.isNotNull(), X.strip(error)).when(~some, "Could not parse metadata JSON response.")
    return values | {f"{f}_confidence": c for f, c in confidence.items()} | {"status": status, "error": told}


def first_of(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that is not null, and the name of its source."""
    value = F.coalesce(*(c for _, c in sources))
    return value, ladder([(c.isNotNull(), F.lit(n)) for n, c in sources], none())


def effective_metadata(pdf: Fields, structure: Fields, ai: Fields, confidence: Fields, user: Fields) -> dict[str, tuple[Column, Column]]:
    """Value and source of each field; inferred values count at high or medium confidence."""
    trusted = {f: F.when(confidence[f].isin("high", "medium"), c) for f, c in ai.items()}
    out = {
        "title": first_of(("pdf", pdf["title"]), ("structure", structure["title"]), ("ai", trusted["title"])),
        "author": first_of(("user", user["author"]), ("pdf", pdf["author"]), ("structure", structure["author"]), ("ai", trusted["author"])),
    }
    for f in YEARS:
        out[f] = first_of(("user", user[f]), ("structure", structure[f]), ("ai", trusted[f]))
    for f in FIELDS:
        out.setdefault(f, first_of(("ai", trusted[f])))
    return out


def rights_metadata(pdf: Fields, structure: Fields, ai: Fields, confidence: Fields, user: Fields) -> dict[str, tuple[Column, Column]]:
    """Value and source of what rights depend on; inferred values count at high confidence only."""
    sure = {f: F.when(confidence[f] == "high", ai[f]) for f in RIGHTS_FIELDS}
    out = {"author": first_of(("user", user["author"]), ("pdf", pdf["author"]), ("structure", structure["author"]), ("ai_high", sure["author"]))}
    for f in YEARS:
        out[f] = first_of(("user", user[f]), ("structure", structure[f]), ("ai_high", sure[f]))
    return out


def overridden(found: Mapping[str, tuple[Column, Column]], override: Fields) -> dict[str, tuple[Column, Column]]:
    """Values that a person has set replace those found."""
    return {f: (F.coalesce(override[f], v), F.when(override[f].isNotNull(), "manual_override").otherwise(s)) if f in override else (v, s) for f, (v, s) in found.items()}


def fallback_metadata(pdf: Fields, structure: Fields, rights: Fields, name: Column) -> dict[str, Column]:
    """Metadata of an output without a report; empty values fall through."""
    some = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    year = lambda f: F.coalesce(F.nullif(structure[f], F.lit(0)), X.coerce_year(rights[f]))
    out = {"title": some(pdf["title"], structure["title"], name), "author": some(pdf["author"], structure["author"], rights["author"])}
    return out | {f: year(f) for f in YEARS} | {f: none() for f in FIELDS if f not in (*out, *YEARS)}


def source_summary(sources: Fields, labels: bool = False) -> Column:
    parts = [F.concat(F.lit(f"{FIELDS[f] if labels else f}="), X.clean_text(sources[f])) for f in RIGHTS_FIELDS]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def assess_rights(author: Column, year: Column, death: Column, sources: Fields, as_of: int) -> Column:
    """Assessment, reason, basis, review and warnings of a document's rights, as of a year."""
    src = {f: X.clean_text(sources[f]) for f in RIGHTS_FIELDS}
    late = F.coalesce(year > as_of, F.lit(False)), F.coalesce(death > as_of, F.lit(False))
    notes = F.filter(F.array(F.when(late[0], "Publication year is in the future."), F.when(late[1], "Author death year is in the future.")), lambda x: x.isNotNull())
    old, long_dead = F.coalesce(year <= 1929, F.lit(False)), F.coalesce(as_of - death >= 70, F.lit(False))
    is_ = lambda f, *v: F.coalesce(src[f].isin(*v), F.lit(False))
    unsure_year = is_("publication_year", "ai_high")
    unsure_death = is_("death_year", "ai_high") | is_("author", "ai_high", "pdf") | (F.coalesce(author, F.lit("")) == "")
    text = lambda s, unsure, more: F.concat(F.lit(s), F.when(unsure, more).otherwise(""))

    def row(assessment: str, reason: Column, basis: str | None, review: Column) -> Column:
        return F.struct(F.lit(assessment).alias("assessment"), reason.alias("reason"), F.lit(basis).cast("string").alias("basis"), review.alias("needs_manual_review"))

    chosen = ladder([
        (late[0] | late[1], row("unknown", notes[0], None, F.lit(True))),
        (old, row("likely_public_domain_us", text("Publication year is 1929 or earlier (US heuristic).", unsure_year, " Publication year came from AI-inferred metadata; confirm manually."), "publication_year", unsure_year)),
        (long_dead, row("likely_public_domain_life_plus_70", text("Author death year is at least 70 years ago.", unsure_death, " Death year or author identity came from inferred/embedded metadata; confirm manually."), "death_year", unsure_death)),
        (year.isNotNull(), row("unknown", F.lit("Publication year alone was not enough for this heuristic."), None, F.lit(True))),
        (death.isNotNull(), row("unknown", F.lit("Death year alone was not enough for this heuristic."), None, F.lit(True))),
    ], row("unknown", F.lit("Insufficient metadata."), None, F.lit(False)))
    return F.struct(*(chosen[c].alias(c) for c in ("assessment", "reason", "basis", "needs_manual_review")), source_summary(sources).alias("source_summary"), notes.alias("warnings"))


def rights_context(author: Column, year: Column, death: Column, assessed: Column) -> Column:
    """The note on rights that goes with a request to a model; assessed is what assess_rights gives."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    flag = F.when(assessed["needs_manual_review"], "True").otherwise("False")
    lines = [("author", show(author)), ("publication_year", show(year)), ("death_year", show(death)), ("assessment", show(assessed["assessment"])), ("reason", show(assessed["reason"])), ("needs_manual_review", flag), ("sources", assessed["source_summary"])]
    careful = "Proceed conservatively if policy restrictions apply."
    end = F.when(~assessed["assessment"].startswith("likely_public_domain"), f"Rights status is not confirmed as public-domain by heuristic.\n{careful}").when(
        assessed["needs_manual_review"], f"Rights heuristic suggests public-domain status, but the metadata still needs manual confirmation.\n{careful}").otherwise(
        "Rights heuristic suggests public-domain status and no additional review flag is present.\nFor this task, treat faithful transcription as permitted.")
    return F.concat(F.concat_ws("\n", F.lit("RIGHTS CONTEXT:"), *(F.concat(F.lit(f"- {k}: "), c) for k, c in lines), end), F.lit("\n"))


def metadata_review_rows(effective: Fields, sources: Fields, ai: Fields, confidence: Fields, evidence: Fields, override: Fields) -> Column:
    """A row for each field of which something is known, and whether a person should look at it."""
    rows = []
    for f, label in FIELDS.items():
        conf = F.lower(X.strip(confidence[f]))
        conf = F.when(conf.isin("high", "medium", "low", "none"), conf).otherwise("none")
        proof, manual = X.clean_text(evidence[f]), override[f].isNotNull()
        value = F.when(manual, override[f]).otherwise(effective[f])
        source = F.when(manual, "manual_override").otherwise(X.clean_text(sources[f]))
        known = reduce(or_, (F.coalesce(c.cast("string"), F.lit("")) != "" for c in (value, ai[f], override[f], proof))) | source.isNotNull()
        is_ = lambda s: F.coalesce(source == s, F.lit(False))  # noqa: E731, B023
        review = F.when(is_("manual_override"), False).when(is_("ai"), (conf != "high") | proof.isNull()).otherwise(ai[f].isNotNull() & conf.isin("medium", "low"))
        rows.append(F.when(known, F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), value.cast("string").alias("effective_value"), source.alias("effective_source"), ai[f].cast("string").alias("ai_value"),
            conf.alias("ai_confidence"), proof.alias("ai_evidence"), manual.alias("manual"), review.alias("review_needed"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def metadata_review_summary(rows: Column, ai_error: Column) -> Column:
    """What is to be reviewed, in the fields' order."""
    todo = F.transform(F.filter(rows, lambda r: r["review_needed"]), lambda r: F.concat(r["label"], F.lit("="), r["ai_confidence"]))
    return ladder([
        (F.size(todo) > 0, F.array_join(todo, ", ")),
        (F.exists(rows, lambda r: F.coalesce(r["effective_source"] == "ai", F.lit(False))), F.lit("AI verified")),
        (F.exists(rows, lambda r: r["manual"]), F.lit("Manual override")),
        (X.clean_text(ai_error).isNotNull(), F.concat(F.lit("AI skipped: "), X.clean_text(ai_error))),
    ], none())


def rights_review(assessment: Column, reason: Column, summary: Column, warnings: Column, explicit: Column, sources: Fields) -> Column:
    """Whether a document's rights need a person, and a line that says why."""
    kind, why = F.coalesce(X.clean_text(assessment), F.lit("unknown")), X.clean_text(reason)
    where = F.coalesce(X.clean_text(summary), source_summary(sources, labels=True))
    notes = F.filter(F.transform(F.coalesce(warnings, F.array().cast("array<string>")), X.clean_text), lambda x: x.isNotNull())
    inferred = reduce(or_, (F.coalesce(X.clean_text(sources[f]) == "ai_high", F.lit(False)) for f in RIGHTS_FIELDS))
    review = F.coalesce(explicit, inferred | ((kind == "unknown") & (where.isNotNull() | why.isNotNull() | (F.size(notes) > 0))))
    label = F.when(kind == "likely_public_domain_us", "Likely public domain (US)").when(kind == "likely_public_domain_life_plus_70", "Likely public domain (life+70)").otherwise("Rights uncertain")
    line = F.when(review, F.concat(F.lit("Review required: "), label, F.coalesce(F.concat(F.lit(" ("), where, F.lit(")")), F.lit("")))).when(kind != "unknown", label).otherwise(why)
    line = F.nullif(F.concat_ws("; ", line, F.get(notes, F.lit(0))), F.lit(""))
    return F.struct(kind.alias("rights_assessment"), why.alias("rights_reason"), review.alias("rights_needs_manual_review"), where.alias("rights_source_summary"), notes.alias("rights_warnings"), line.alias("rights_review_summary"))


# Operations


def pdf_compiled(reported: Column, exists: Column, error: Column) -> Column:
    """reported: a variant; only a real boolean counts, else whether the file is there. An error log rules it out."""
    real = F.coalesce(F.schema_of_variant(reported) == "BOOLEAN", F.lit(False))
    return F.when(real, F.try_variant_get(reported, "$", "boolean")).otherwise(exists) & ~error


def hung_threshold(api_timeout: Column, retries: Column, compile_timeout: Column) -> Column:
    least = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return F.greatest(least(api_timeout) * (least(retries) + 1), least(compile_timeout), F.lit(300)) + 60


def hung(stage: Column, idle_seconds: Column, threshold: Column) -> Column:
    return F.coalesce((stage != "") & (stage != "complete") & (idle_seconds > threshold), F.lit(False))


#: Health status -> (type, label). Fixed values.
HEALTH_ISSUES = {"dns_failed": ("dns", "DNS"), "auth_failed": ("auth", "Auth"), "missing_credentials": ("credentials", "Credentials"), "api_failed": ("api", "API")}
#: Words of a reason -> (type, label). Fixed values.
REASON_ISSUES = (
    (r"could not resolve|name or service not known|dns", "dns", "DNS"),
    (r"service key|\(401\)|\(403\)|unauthorized|forbidden", "auth", "Auth"),
    (r"^missing |no page_| not found", "missing_file", "Missing file"),
)


def publish_issue(status: Column, reason: Column, health: Column, health_reason: Column) -> Column:
    """What kept a document from being published: type, label, detail and a line."""
    why, state = X.clean_text(reason), X.norm(health)
    detail = F.coalesce(X.clean_text(health_reason), why)
    rungs = [(state == h, F.struct(F.lit(t).alias("type"), F.lit(n).alias("label"))) for h, (t, n) in HEALTH_ISSUES.items()]
    rungs += [(F.coalesce(F.lower(why).rlike(p), F.lit(False)), F.struct(F.lit(t).alias("type"), F.lit(n).alias("label"))) for p, t, n in REASON_ISSUES]
    rungs.append((why.isNotNull() & F.coalesce(status == "failed", F.lit(False)), F.struct(F.lit("publish_error").alias("type"), F.lit("Publish error").alias("label"))))
    issue = ladder(rungs, F.struct(none().alias("type"), none().alias("label")))
    return F.struct(issue["type"].alias("publish_issue_type"), issue["label"].alias("publish_issue_label"), detail.alias("publish_issue_detail"), F.when(detail.isNotNull(), F.concat_ws(": ", issue["label"], detail)).alias("publish_issue_summary"))


def _states() -> list[tuple[Column, str, int]]:
    """The first that holds decides on the next action and the priority. Columns are those of operations.summary()."""
    c, no = F.col, F.lit(False)
    issue = lambda *v: F.coalesce(c("publish_issue_type").isin(*v), no)
    return [
        (c("hung_suspected"), "Inspect hung pipeline", 0),
        (F.coalesce((c("current_stage") != "") & (c("current_stage") != "complete"), no), "Wait for pipeline", 1),
        (F.size("failed_pages") > 0, "Retry failed pages", 2),
        (~c("has_quality_report"), "Run pipeline", 3),
        (~c("digitalized_compiled") | ~c("korean_compiled"), "Fix PDF compilation", 4),
        (c("rights_needs_manual_review"), "Review rights metadata", 5),
        (issue("missing_file"), "Fix publish inputs", 6),
        (issue("dns", "api"), "Fix Supabase connectivity", 6),
        (issue("auth", "credentials"), "Fix Supabase credentials", 6),
        (c("publish_status") == "failed", "Retry publish", 6),
        (c("publish_status") != "published", "Publish to Supabase", 7),
    ]


def next_action() -> Column:
    return ladder([(when, F.lit(action)) for when, action, _ in _states()], F.lit("Published"))


def priority_rank() -> Column:
    """0 (first) to 8; warnings of the compiler keep even a published document at 7."""
    return ladder([(when, F.lit(rank)) for when, _, rank in _states()] + [(F.col("compile_warning_count") > 0, F.lit(7))], F.lit(8))


def publish_ready() -> Column:
    return F.col("has_quality_report") & F.col("digitalized_compiled") & F.col("korean_compiled") & (F.size("failed_pages") == 0) & (F.col("publish_status") != "published")


def publish_health(url: Column, key: Column, resolves: Column, http_status: Column) -> Column:
    """Status of the publishing service from what a probe found."""
    return ladder([
        ((F.coalesce(X.strip(url), F.lit("")) == "") | (F.coalesce(X.strip(key), F.lit("")) == ""), F.lit("missing_credentials")),
        (~url.rlike(r"^https?://[^/\s]+"), F.lit("invalid_url")),
        (~F.coalesce(resolves, F.lit(False)), F.lit("dns_failed")),
        (http_status.isin(401, 403), F.lit("auth_failed")),
        (http_status.isNull() | (http_status >= 400), F.lit("api_failed")),
    ], F.lit("ok"))

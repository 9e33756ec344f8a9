"""Metadata reconciliation and rights over values derived from the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions import text as X

#: As of which year rights are judged.
AS_OF = 2025


def _value(f: str, i: int, kind: str, every: int, year: int) -> str:
    gone = f"(doc_id + {i}) % {every} = 0"
    made = f"cast({year} + (doc_id * 31 + {i} * 7) % 600 AS int)" if f in R.YEARS else f"concat('{kind} {f} ', cast(doc_id % 97 AS string))"
    return f"CASE WHEN {gone} THEN NULL ELSE {made} END"


_RARE = lambda f, i: f"CASE WHEN (doc_id + 2 * {i}) % 9 = 0 THEN {'cast(1700 + doc_id % 90 AS int)' if f in R.YEARS else f'concat({chr(39)}set {f} {chr(39)}, cast(doc_id % 89 AS string))'} END"
_META = "SELECT doc_id, " + ", ".join(
    [f"{_value('title', 1, 'pdf', 2, 0)} AS pdf_title", f"{_value('author', 2, 'pdf', 2, 0)} AS pdf_author"]
    + [f"{_value(f, i, 'st', 3, 1550)} AS st_{f}" for i, f in enumerate(("title", "author", *R.YEARS))]
    + [f"{_RARE(f, i + 4)} AS user_{f}" for i, f in enumerate(R.RIGHTS_FIELDS)]
    + [f"{_value(f, i, 'ai', 3, 1500)} AS ai_{f}" for i, f in enumerate(R.FIELDS)]
    + [f"CASE (doc_id + {i}) % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN ' LOW ' WHEN 3 THEN 'none' ELSE 'odd' END AS conf_{f}" for i, f in enumerate(R.FIELDS)]
    + [f"CASE WHEN (doc_id + {i}) % 4 = 0 THEN ' ' ELSE concat('line ', cast({i} AS string)) END AS ev_{f}" for i, f in enumerate(R.FIELDS)]
    + [f"{_RARE(f, i)} AS ov_{f}" for i, f in enumerate(R.FIELDS)]
    + ["CASE WHEN doc_id % 6 = 0 THEN 'timeout' END AS ai_error"]
) + " FROM {documents}"
_STRUCTURE = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN '[1, 1700]' WHEN 2 THEN concat('{{"article_header": {{"title_text": " T', cast(doc_id AS string), ' ", "author_line": "By  Some Author"}}, "note": "printed ', cast(1400 + doc_id % 700 AS string), '"}}')
  WHEN 3 THEN '{{"article_header": {{"author_line": "von Emmy Noether"}}}}' ELSE concat('{{"article_header": {{"title_text": "", "author_line": "Albert Einstein"}}, "y": ', cast(1600 + doc_id % 300 AS string), '}}') END AS json FROM {documents}"""
_REPORT = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'likely_public_domain_us' WHEN 2 THEN 'likely_public_domain_life_plus_70' ELSE 'unknown' END AS assessment, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Some reason.' END AS reason,
  CASE WHEN doc_id % 5 = 0 THEN 'author=pdf' END AS summary, CASE doc_id % 7 WHEN 0 THEN 'Publication year is in the future.' WHEN 1 THEN ' ' END AS warning, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS explicit,
  CASE WHEN doc_id % 11 = 0 THEN 'ai_high' WHEN doc_id % 11 = 1 THEN 'pdf' END AS s_author, CASE WHEN doc_id % 13 = 0 THEN 'ai_high' END AS s_publication_year, CASE WHEN doc_id % 17 = 0 THEN 'user' END AS s_death_year FROM {documents}"""


def _docs(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _cols(prefix: str, fields) -> dict:
    return {f: F.col(f"{prefix}_{f}") for f in fields}


def _parts() -> dict:
    ai, conf = R.normalized_ai(_cols("ai", R.FIELDS), _cols("conf", R.FIELDS))
    user = {f: F.col(f"user_{f}") for f in R.RIGHTS_FIELDS}
    return {"pdf": _cols("pdf", ("title", "author")), "structure": _cols("st", ("title", "author", *R.YEARS)), "ai": ai, "confidence": conf, "user": user}


def _pairs(df: DataFrame, found: dict) -> DataFrame:
    return df.select("doc_id", *(c for f, (v, s) in found.items() for c in (v.alias(f), s.alias(f"{f}_source"))))


def effective(s: SparkSession, d: str) -> DataFrame:
    return _pairs(_docs(s, d, _META), R.effective_metadata(**_parts()))


def rights(s: SparkSession, d: str) -> DataFrame:
    return _pairs(_docs(s, d, _META), R.rights_metadata(**_parts()))


def refreshed(s: SparkSession, d: str) -> DataFrame:
    """Effective metadata, then what a person has set over it."""
    return _pairs(_docs(s, d, _META), R.overridden(R.effective_metadata(**_parts()), _cols("ov", R.FIELDS)))


def _assessed(s: SparkSession, d: str) -> DataFrame:
    r = rights(s, d)
    got = R.assess_rights(F.col("author"), F.col("publication_year"), F.col("death_year"), {f: F.col(f"{f}_source") for f in R.RIGHTS_FIELDS}, AS_OF)
    return r.select("doc_id", "author", "publication_year", "death_year", got.alias("r")).select("doc_id", "author", "publication_year", "death_year", "r.*")


def _context_text(s: SparkSession, d: str) -> DataFrame:
    a = _assessed(s, d)
    note = R.rights_context(F.col("author"), F.col("publication_year"), F.col("death_year"), F.struct("assessment", "reason", "needs_manual_review", "source_summary"))
    return a.select("doc_id", note.alias("note"))


def _review(s: SparkSession, d: str) -> DataFrame:
    e = _pairs(_docs(s, d, _META), R.effective_metadata(**_parts()))
    both = e.join(_docs(s, d, _META), "doc_id")
    rows = R.metadata_review_rows({f: F.col(f) for f in R.FIELDS}, {f: F.col(f"{f}_source") for f in R.FIELDS}, _cols("ai", R.FIELDS), _cols("conf", R.FIELDS), _cols("ev", R.FIELDS), _cols("ov", R.FIELDS))
    return both.select("doc_id", "ai_error", rows.alias("rows"))


def _rights_review(s: SparkSession, d: str) -> DataFrame:
    got = R.rights_review(F.col("assessment"), F.col("reason"), F.col("summary"), F.array(F.col("warning")), F.col("explicit"), _cols("s", R.RIGHTS_FIELDS))
    return _docs(s, d, _REPORT).select("doc_id", got.alias("r")).select("doc_id", "r.*")


QUERIES = {
    "infer_structure": lambda s, d: _docs(s, d, _STRUCTURE).select("doc_id", *(c.alias(k) for k, c in R.structure_metadata(F.col("json")).items())),
    "normalize_ai": lambda s, d: _docs(s, d, _META).select("doc_id", *(c.alias(f) for f, c in _parts()["ai"].items()), *(c.alias(f"{f}_conf") for f, c in _parts()["confidence"].items())),
    "effective_metadata": effective,
    "rights_metadata": rights,
    "apply_override": lambda s, d: _pairs(_docs(s, d, _META), R.overridden(R.rights_metadata(**_parts()), _cols("ov", R.RIGHTS_FIELDS))),
    "metadata_refresh": refreshed,
    "fallback_metadata": lambda s, d: _docs(s, d, _META).select("doc_id", *(c.alias(f) for f, c in R.fallback_metadata(_cols("pdf", ("title", "author")), _cols("st", ("title", "author", *R.YEARS)), _cols("ov", R.RIGHTS_FIELDS), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).items())),
    "assess_rights": _assessed,
    "rights_context": _context_text,
    "source_summary": lambda s, d: rights(s, d).select("doc_id", R.source_summary({f: F.col(f"{f}_source") for f in R.RIGHTS_FIELDS}).alias("summary")),
    "metadata_review": lambda s, d: _review(s, d).select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.*"),
    "metadata_review_summary": lambda s, d: _review(s, d).select("doc_id", R.metadata_review_summary(F.col("rows"), F.col("ai_error")).alias("summary")),
    "rights_review": _rights_review,
}

# DuckDB


def _q(select: str) -> str:
    return f"WITH m AS ({_META.format(documents='documents')}), n AS (SELECT *, {', '.join(f'{_conf(f)} AS c_{f}' for f in R.FIELDS)} FROM m), e AS ({_EFFECTIVE}), r AS ({_RIGHTS}) {select}"


def _conf(f: str) -> str:
    return f"CASE WHEN lower(trim(conf_{f})) IN ('high', 'medium', 'low', 'none') THEN lower(trim(conf_{f})) WHEN ai_{f} IS NOT NULL THEN 'low' ELSE 'none' END"


def _first(f: str, *sources: tuple[str, str]) -> str:
    return f"coalesce({', '.join(c for _, c in sources)}) AS {f}, CASE {' '.join(f'WHEN {c} IS NOT NULL THEN {chr(39)}{n}{chr(39)}' for n, c in sources)} END AS {f}_source"


def _ai(f: str, *levels: str) -> str:
    # Years are cleaned: those out of 1500 to 2100 don't count.
    value = f"CASE WHEN ai_{f} BETWEEN 1500 AND 2100 THEN ai_{f} END" if f in R.YEARS else f"ai_{f}"
    return f"(CASE WHEN c_{f} IN ({', '.join(repr(x) for x in levels)}) THEN {value} END)"


_hm = ("high", "medium")
_EFFECTIVE = "SELECT doc_id, " + ", ".join(
    [_first("title", ("pdf", "pdf_title"), ("structure", "st_title"), ("ai", _ai("title", *_hm))), _first("author", ("user", "user_author"), ("pdf", "pdf_author"), ("structure", "st_author"), ("ai", _ai("author", *_hm)))]
    + [_first(f, ("user", f"user_{f}"), ("structure", f"st_{f}"), ("ai", _ai(f, *_hm))) for f in R.YEARS] + [_first(f, ("ai", _ai(f, *_hm))) for f in list(R.FIELDS)[4:]]) + " FROM n"
_RIGHTS = "SELECT doc_id, " + ", ".join(
    [_first("author", ("user", "user_author"), ("pdf", "pdf_author"), ("structure", "st_author"), ("ai_high", _ai("author", "high")))] + [_first(f, ("user", f"user_{f}"), ("structure", f"st_{f}"), ("ai_high", _ai(f, "high"))) for f in R.YEARS]) + " FROM n"


def _over(base: str, fields) -> str:
    return f"SELECT b.doc_id, {', '.join(f'coalesce(n.ov_{f}, b.{f}) AS {f}, CASE WHEN n.ov_{f} IS NOT NULL THEN {chr(39)}manual_override{chr(39)} ELSE b.{f}_source END AS {f}_source' for f in fields)} FROM {base} b JOIN n USING (doc_id)"


_SUMMARY = "nullif(concat_ws(', ', 'author=' || author_source, 'publication_year=' || publication_year_source, 'death_year=' || death_year_source), '')"
_UNSURE = "coalesce(death_year_source = 'ai_high', false) OR coalesce(author_source IN ('ai_high', 'pdf'), false) OR coalesce(author, '') = ''"
_ASSESS = f"""SELECT doc_id, author, publication_year, death_year, {_SUMMARY} AS source_summary,
  list_filter([CASE WHEN publication_year > {AS_OF} THEN 'Publication year is in the future.' END, CASE WHEN death_year > {AS_OF} THEN 'Author death year is in the future.' END], lambda x: x IS NOT NULL) AS warnings,
  CASE WHEN publication_year > {AS_OF} OR death_year > {AS_OF} THEN 'late' WHEN publication_year <= 1929 THEN 'us' WHEN {AS_OF} - death_year >= 70 THEN 'life' WHEN publication_year IS NOT NULL THEN 'year' WHEN death_year IS NOT NULL THEN 'death' ELSE 'none' END AS k,
  coalesce(publication_year_source = 'ai_high', false) AS uy, ({_UNSURE}) AS ud FROM r"""
_REVIEW = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS i, '{f}' AS field, '{label}' AS label, cast(coalesce(n.ov_{f}, e.{f}) AS string) AS effective_value, CASE WHEN n.ov_{f} IS NOT NULL THEN 'manual_override' ELSE e.{f}_source END AS effective_source, cast(n.ai_{f} AS string) AS ai_value,
  CASE WHEN lower(trim(n.conf_{f})) IN ('high', 'medium', 'low', 'none') THEN lower(trim(n.conf_{f})) ELSE 'none' END AS ai_confidence, nullif(trim(n.ev_{f}), '') AS ai_evidence, n.ov_{f} IS NOT NULL AS manual FROM e JOIN n USING (doc_id)""" for i, (f, label) in enumerate(R.FIELDS.items()))
_REVIEW = f"SELECT *, CASE WHEN effective_source = 'manual_override' THEN false WHEN effective_source = 'ai' THEN ai_confidence <> 'high' OR ai_evidence IS NULL ELSE ai_value IS NOT NULL AND ai_confidence IN ('medium', 'low') END AS review_needed FROM ({_REVIEW}) WHERE coalesce(effective_value, ai_value, ai_evidence) IS NOT NULL OR effective_source IS NOT NULL"
_HEADER = "json_extract_string(j, '$.article_header.{}')"
_A = f"nullif(trim(regexp_replace({_HEADER.format('author_line')}, '(?i)^(by|von)\\s+', '')), '')"

ORACLE_SQL = {
    "infer_structure": f"WITH t AS ({_STRUCTURE.format(documents='documents')}), u AS (SELECT doc_id, json, CASE WHEN json_valid(json) AND starts_with(json, '{{') THEN cast(json AS json) END AS j FROM t) SELECT doc_id, nullif(trim({_HEADER.format('title_text')}), '') AS title, {_A} AS author, CASE WHEN j IS NOT NULL THEN try_cast(nullif(regexp_extract(json, '\\b(1[6-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') AS int) END AS publication_year, CASE lower({_A}) WHEN 'emmy noether' THEN 1935 WHEN 'albert einstein' THEN 1955 END AS death_year FROM u",
    "normalize_ai": _q(f"SELECT doc_id, {', '.join(f'CASE WHEN ai_{f} BETWEEN 1500 AND 2100 THEN ai_{f} END AS {f}' if f in R.YEARS else f'ai_{f} AS {f}' for f in R.FIELDS)}, {', '.join(f'c_{f} AS {f}_conf' for f in R.FIELDS)} FROM n"),
    "effective_metadata": _q("SELECT * FROM e"),
    "rights_metadata": _q("SELECT * FROM r"),
    "apply_override": _q(_over("r", R.RIGHTS_FIELDS)),
    "metadata_refresh": _q(_over("e", R.FIELDS)),
    "fallback_metadata": _q(f"SELECT doc_id, coalesce(pdf_title, st_title, concat('doc-', cast(doc_id AS string))) AS title, coalesce(pdf_author, st_author, ov_author) AS author, coalesce(st_publication_year, ov_publication_year) AS publication_year, coalesce(st_death_year, ov_death_year) AS death_year, {', '.join(f'cast(NULL AS string) AS {f}' for f in list(R.FIELDS)[4:])} FROM n"),
    "assess_rights": _q(f"""SELECT doc_id, author, publication_year, death_year, source_summary, warnings, CASE k WHEN 'us' THEN 'likely_public_domain_us' WHEN 'life' THEN 'likely_public_domain_life_plus_70' ELSE 'unknown' END AS assessment,
  CASE k WHEN 'late' THEN warnings[1] WHEN 'us' THEN 'Publication year is 1929 or earlier (US heuristic).' || CASE WHEN uy THEN ' Publication year came from AI-inferred metadata; confirm manually.' ELSE '' END
  WHEN 'life' THEN 'Author death year is at least 70 years ago.' || CASE WHEN ud THEN ' Death year or author identity came from inferred/embedded metadata; confirm manually.' ELSE '' END
  WHEN 'year' THEN 'Publication year alone was not enough for this heuristic.' WHEN 'death' THEN 'Death year alone was not enough for this heuristic.' ELSE 'Insufficient metadata.' END AS reason,
  CASE k WHEN 'us' THEN 'publication_year' WHEN 'life' THEN 'death_year' END AS basis, CASE k WHEN 'us' THEN uy WHEN 'life' THEN ud WHEN 'none' THEN false ELSE true END AS needs_manual_review FROM ({_ASSESS})"""),
    "source_summary": _q(f"SELECT doc_id, {_SUMMARY} AS summary FROM r"),
    "metadata_review": _q(f"SELECT * EXCLUDE (i) FROM ({_REVIEW})"),
    "metadata_review_summary": _q(f"""SELECT n.doc_id, CASE WHEN todo IS NOT NULL THEN todo WHEN ai THEN 'AI verified' WHEN manual THEN 'Manual override' WHEN ai_error IS NOT NULL THEN 'AI skipped: ' || ai_error END AS summary FROM n LEFT JOIN
  (SELECT doc_id, string_agg(CASE WHEN review_needed THEN label || '=' || ai_confidence END, ', ' ORDER BY i) AS todo, bool_or(coalesce(effective_source = 'ai', false)) AS ai, bool_or(manual) AS manual FROM ({_REVIEW}) GROUP BY doc_id) x USING (doc_id)"""),
    "rights_review": f"""WITH t AS ({_REPORT.format(documents='documents')}), u AS (SELECT *, coalesce(assessment, 'unknown') AS kind, coalesce(summary, nullif(concat_ws(', ', 'Author=' || s_author, 'Publication year=' || s_publication_year, 'Death year=' || s_death_year), '')) AS wher, nullif(trim(warning), '') AS w,
  coalesce(s_author = 'ai_high', false) OR coalesce(s_publication_year = 'ai_high', false) AS inferred FROM t), v AS (SELECT *, coalesce(explicit, inferred OR (kind = 'unknown' AND (wher IS NOT NULL OR reason IS NOT NULL OR w IS NOT NULL))) AS review,
  CASE kind WHEN 'likely_public_domain_us' THEN 'Likely public domain (US)' WHEN 'likely_public_domain_life_plus_70' THEN 'Likely public domain (life+70)' ELSE 'Rights uncertain' END AS label FROM u)
  SELECT doc_id, kind AS rights_assessment, reason AS rights_reason, review AS rights_needs_manual_review, wher AS rights_source_summary, CASE WHEN w IS NULL THEN [] ELSE [w] END AS rights_warnings,
  nullif(concat_ws('; ', CASE WHEN review THEN 'Review required: ' || label || coalesce(' (' || wher || ')', '') WHEN kind <> 'unknown' THEN label ELSE reason END, w), '') AS rights_review_summary FROM v""",
}

_A = ORACLE_SQL["assess_rights"]
_SHOW = lambda c: f"coalesce(cast({c} AS string), 'None')"
ORACLE_SQL["rights_context"] = (
    "SELECT doc_id, concat_ws(chr(10), 'RIGHTS CONTEXT:', " + ", ".join(f"'- {c}: ' || {_SHOW(c)}" for c in ("author", "publication_year", "death_year", "assessment", "reason")) + ", '- needs_manual_review: ' || CASE WHEN needs_manual_review THEN 'True' ELSE 'False' END, '- sources: ' || source_summary,"
    " CASE WHEN NOT starts_with(assessment, 'likely_public_domain') THEN 'Rights status is not confirmed as public-domain by heuristic.' || chr(10) || 'Proceed conservatively if policy restrictions apply.' WHEN needs_manual_review THEN 'Rights heuristic suggests public-domain status, but the metadata still needs manual confirmation.' || chr(10) || 'Proceed conservatively if policy restrictions apply.'"
    f" ELSE 'Rights heuristic suggests public-domain status and no additional review flag is present.' || chr(10) || 'For this task, treat faithful transcription as permitted.' END) || chr(10) AS note FROM ({_A})"
)

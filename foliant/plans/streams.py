"""Streams over the test tables: silent jobs, log tails, a catalog kept up to date, and observed runs; with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import facets as FA
from foliant.plans.catalog import _BUCKET, _CLEAN, _ERA, _SECTIONS, ORACLE_SQL as CATALOG_SQL
from foliant.sources.adapters import CATALOG, catalog
from foliant.streaming import callbacks, logs, progress, state, watch
from foliant.streaming.paths import held, scratch

_TOLD = "job long, stage string, at timestamp, threshold_sec long, event string, told_at timestamp"


def _silent(s: SparkSession, d: str) -> DataFrame:
    """The jobs that a stream of events has raised as silent, by a threshold of each job's own, when its input ends."""
    beats = progress.stream_table(s, f"{d}/events.parquet").transform(progress.heartbeats).withColumn("threshold_sec", (F.col("job") % 5 + 1) * 4000)
    out = scratch(s, "told")
    state.maintain(watch.alerts(beats, final="purchase"), out, scratch(s, "checkpoint"), "append").awaitTermination()
    return watch.suspected(state.history(s, out, _TOLD)).select("job", "stage", "threshold_sec", "told_at")


def _tails(s: SparkSession, d: str) -> DataFrame:
    """The last 100 lines of each source's documents, in the order of their ids, as a stream of lines leaves them."""
    docs = progress.stream_table(s, f"{d}/documents.parquet")
    lines = docs.select(F.col("source").alias("job"), F.col("doc_id").alias("at"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    out = scratch(s, "tails")
    logs.drain(lines, out, scratch(s, "checkpoint")).awaitTermination()
    return logs.shown(s, out)


def _closed(s: SparkSession, d: str) -> DataFrame:
    """The sessions that a stream has closed by itself: those that ended before its watermark."""
    out = scratch(s, "sessions")
    progress.run_once(progress.sessions(progress.stream_table(s, f"{d}/events.parquet").transform(progress.heartbeats)), out, scratch(s, "checkpoint"))
    return s.read.schema("job long, start timestamp, end timestamp, beats long").parquet(out)


def _versions(s: SparkSession, d: str) -> list[DataFrame]:
    """A catalog as it changes: a first load; corrections and deletions; late arrivals and more deletions."""
    c = C.published(catalog(s, d)).select("id", *FA.COLUMNS)
    first = c.where("id % 9 <> 4")
    year, language = F.when(F.col("id") % 4 == 1, F.col("publication_year") + 700).otherwise(F.col("publication_year")), F.when(F.col("id") % 5 == 3, F.lit("Latin")).otherwise(F.col("language"))
    second = first.where("id % 6 <> 2").withColumns({"publication_year": year, "language": language})
    return [first, second, second.where("id % 10 <> 7").unionByName(c.where("id % 9 = 4"))]


def refreshed(s: SparkSession, d: str) -> DataFrame:
    """Facet counts after three rounds of changes, each run of the stream resuming where the last one ended."""
    changes, out, checkpoint = (scratch(s, n) for n in ("changes", "facets", "checkpoint"))
    old = None
    for new in _versions(s, d):
        FA.signed(old, new).write.mode("append").parquet(changes)
        FA.refresh(s.readStream.schema(s.read.parquet(changes).schema).parquet(changes), out, checkpoint).awaitTermination()
        old = new
    return FA.current(s, out)


def _after(view: Callable[[DataFrame], DataFrame]):
    return lambda s, d: view(refreshed(s, d))


def _page(part: str):
    return lambda s, d: FA.page(C.published(catalog(s, d)), lambda df: held(df, "facets"))[part]


def _observed(s: SparkSession, d: str) -> DataFrame:
    """What the beats of a run of three stages say."""
    run = callbacks.Run(s, "lines", scratch(s, "run"))
    docs = run.stage("read", s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    lines = run.stage("split", docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")))
    run.stage("count", lines.where("trim(line) <> ''").groupBy("doc_id").agg(F.count("*").alias("lines")))
    run.finish()
    return run.beats().select("job", "stage", "seq", "rows")


QUERIES = {
    "hung_alerts_stream": _silent,
    "log_tails_stream": _tails,
    "progress_sessions_closed": _closed,
    "refresh_overview": _after(FA.overview),
    "refresh_languages": _after(FA.language_options),
    "refresh_eras": _after(FA.era_sections),
    "browse_facets": lambda s, d: FA.counts(C.published(catalog(s, d))),
    "browse_page_overview": _page("overview"),
    "browse_page_eras": _page("eras"),
    "observed_stages": _observed,
}

_CHANGED = f"""WITH c AS (SELECT * FROM ({CATALOG.format(documents='documents', labels='labels')}) WHERE status = 'published'), published AS (
  SELECT * REPLACE (CASE WHEN id % 9 <> 4 AND id % 4 = 1 THEN publication_year + 700 ELSE publication_year END AS publication_year, CASE WHEN id % 9 <> 4 AND id % 5 = 3 THEN 'Latin' ELSE language END AS language)
  FROM c WHERE id % 9 = 4 OR id % 6 <> 2 AND id % 10 <> 7) """


def _changed(name: str) -> str:
    """A catalog query's SQL on the catalog as it is after all changes."""
    return _CHANGED + CATALOG_SQL[name].split("FROM catalog WHERE status = 'published') ", 1)[1]


def _facet(name: str, label: str, number: str = "NULL", year: str = "NULL") -> str:
    return f"SELECT '{name}' AS facet, {label} AS label, cast({number} AS int) AS century_number, cast({year} AS int) AS year FROM {_ERA}"


_FACETS = " UNION ALL ".join([
    _facet("all", "''"), *(_facet(n, _CLEAN.format(c)) for n, c in (("author", "author_display"), ("century", "century_label"), ("language", "language"))), _facet("rights", _BUCKET), _facet("era", "era", "century_number", "publication_year"),
])
_SESSIONS = "(SELECT job, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS \"end\", count(*) AS beats FROM (SELECT user_id AS job, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY job, s)"

ORACLE_SQL = {
    "hung_alerts_stream": """SELECT job, stage, t AS threshold_sec, make_timestamp((at_s + t + 1) * 1000000) AS told_at FROM (
      SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS stage, cast(floor(epoch(max(ts))) AS bigint) AS at_s, (user_id % 5 + 1) * 4000 AS t FROM events GROUP BY user_id)
      WHERE stage <> 'purchase' AND (at_s + t + 1) * 1000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
    "log_tails_stream": """SELECT source AS job, list(line ORDER BY doc_id, n, line) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, n DESC, line DESC) AS r FROM (
      SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)) WHERE r <= 100 AND source IS NOT NULL GROUP BY source""",
    "progress_sessions_closed": f"SELECT * FROM {_SESSIONS} WHERE epoch_ms(\"end\") <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)",
    "refresh_overview": _changed("archive_overview"),
    "refresh_languages": _changed("language_options"),
    "refresh_eras": _changed("era_sections"),
    "browse_facets": f"WITH published AS (SELECT * FROM ({CATALOG.format(documents='documents', labels='labels')}) WHERE status = 'published') SELECT facet, label, century_number, year, count(*) AS documents FROM ({_FACETS}) WHERE label IS NOT NULL GROUP BY ALL",
    "browse_page_overview": CATALOG_SQL["archive_overview"],
    "browse_page_eras": CATALOG_SQL["era_sections"],
    "observed_stages": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT 'lines' AS job, * FROM (SELECT 'read' AS stage, 0::BIGINT AS seq, count(*) AS rows FROM documents UNION ALL SELECT 'split', 1, count(*) FROM l UNION ALL SELECT 'count', 2, count(DISTINCT doc_id) FROM l WHERE trim(line) <> '' UNION ALL SELECT 'complete', 3, NULL)""",
}

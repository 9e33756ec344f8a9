"""Files, constraints and the search index over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import integrity
from foliant.operators import operations as O
from foliant.operators import publish as P
from foliant.operators import trigrams
from foliant.operators.layout import margins
from foliant.operators.medians import medians
from foliant.plans.catalog import _TEXT, ORACLE_SQL as CATALOG_SQL
from foliant.plans.operations import AS_OF, FILES, ORACLE_SQL as OPERATIONS_SQL
from foliant.sources import files as sink
from foliant.sources import folders
from foliant.sources.adapters import catalog, pages, with_catalog, with_pages
from foliant.streaming.paths import scratch

_SUPPLIERS = "(SELECT s_suppkey AS doc_id FROM supplier)"


# Folders and files


def _folders(s: SparkSession, d: str) -> str:
    """An output folder for each supplier, with its reports, logs and PDFs as files."""
    root = scratch(s, "output")
    made = s.sql(FILES, documents=s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS doc_id"))
    dealt = made.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "folder")  # the table is one task's; a folder's files go together
    sink.write(dealt.select(F.concat_ws("/", "folder", "path").alias("path"), F.col("content").cast("binary").alias("content")), root)
    return root


def _summary(s: SparkSession, d: str) -> DataFrame:
    return O.summary(folders.read(s, _folders(s, d)), AS_OF).drop("rights_warnings")


def _kinds(s: SparkSession, d: str) -> DataFrame:
    """How many files of each kind there are, and the bytes of those that were read."""
    files = folders.read(s, _folders(s, d))
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes_read"))


def _written(s: SparkSession, d: str) -> DataFrame:
    """Reports as files, read again as they are."""
    root, i = scratch(s, "reports"), F.col("s_suppkey")
    slug = F.concat(F.lit("é-"), i.cast("string"))
    report = P.dry_run_report(slug, F.lit("b"), F.concat(F.lit("documents/"), slug), (i % 7).cast("int"), (i % 5).cast("int"), "skip")
    rows = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("out-"), i.cast("string"), F.lit("/n_publish_report.json")).alias("path"), report.alias("content"))
    sink.write(rows.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "path"), root)
    read = s.read.text(root, wholetext=True, recursiveFileLookup=True)
    return read.select(F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("path"), F.col("value").alias("content"))


# Constraints: tables with faults of every kind


_TABLES = {
    "documents": "SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN 'doc-1' ELSE concat('doc-', cast(doc_id AS string)) END AS slug, CASE WHEN doc_id % 70 = 3 THEN NULL ELSE source END AS title, lang AS status, 'b' AS storage_bucket, n_chars AS page_count, n_chars AS requested_page_count FROM {documents}",
    "authors": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END AS display_name, concat('a', cast(s_nationkey AS string)) AS sort_name FROM {supplier}",
    "document_authors": "SELECT doc_id AS document_id, doc_id % 150 AS author_id, CASE WHEN doc_id % 8 <> 0 THEN 1 END AS ordinal FROM {documents}",
    "document_assets": "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 400 END AS document_id, 'artifact' AS asset_type, 'b' AS storage_bucket, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE lang END AS storage_path FROM {documents}",
    "document_metadata_snapshots": "SELECT doc_id - doc_id % 3 AS document_id FROM {documents}",
}
_PAGES = "SELECT id, CASE WHEN id % 11 = 5 THEN document_id + 1000000000 ELSE document_id END AS document_id, CASE WHEN page_number % 7 = 6 THEN 1 ELSE page_number END AS page_number FROM {pages}"


def tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    given = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "supplier")}
    made = {n: s.sql(q, **{g: given[g] for g in given if f"{{{g}}}" in q}) for n, q in _TABLES.items()}
    return made | {"document_pages": s.sql(_PAGES, pages=pages(s, d).select("id", "document_id", "page_number"))}


def _deleted(s: SparkSession, d: str) -> DataFrame:
    """What the tables hold of each document after the documents of two titles have gone."""
    left = integrity.delete(tables(s, d), "documents", F.col("title").isin("src1", "src2"))
    rows = [df.select(F.lit(n).alias("name"), F.col("id" if n in ("documents", "authors") else "document_id").alias("key")) for n, df in left.items()]
    return reduce(DataFrame.union, rows).groupBy("name", "key").agg(F.count("*").alias("rows"))


# Search


def _search(query: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        docs, path = C.published(catalog(s, d)), scratch(s, "index")
        trigrams.build(docs, path)
        return docs.join(trigrams.search(s, path, query), "id", "left_semi").select("id", "title")

    return run


# Medians


def _medians(s: SparkSession, d: str) -> DataFrame:
    """Median sizes of all pages of a language: a group holds a large part of all rows."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("lang", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n, p = F.length("line"), F.col("p")
    sized = docs.select("lang", (380.0 + n % 211 + (p % 10) / 10.0).alias("width"), (560.0 + n % 223).cast("double").alias("height"), F.when(p % 4 != 0, n % 25 / 100.0).alias("left"))
    return medians(sized, "lang", ["width", "height", "left"])


# Margins: a text is a page of 200 columns, whose white space is paper


_WIDTH = 200


def _margins(s: SparkSession, d: str) -> DataFrame:
    ink = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x"), r"[\x20\x09-\x0D]", "\u00ff")
    pages = s.read.parquet(f"{d}/documents.parquet").select("doc_id", ink.alias("ink")).withColumn("rows", F.ceil(F.length("ink") / _WIDTH).cast("int"))
    pixels = F.encode(F.rpad("ink", F.col("rows") * _WIDTH, F.lit("\u00ff")), "ISO-8859-1")
    return pages.select("doc_id", margins(pixels, F.lit(_WIDTH), F.col("rows")).alias("m")).select("doc_id", "m.*")


QUERIES = {
    "page_medians": _medians,
    "page_margins": _margins,
    "folder_summary": _summary,
    "folder_kinds": _kinds,
    "report_files": _written,
    "constraint_audit": lambda s, d: integrity.audit(tables(s, d)),
    "cascade_delete": _deleted,
    "search_index": _search("author  th century"),
    "search_index_rare": _search("10.1000/1 journal 3 src"),
}

_ALL = ", ".join(f"{n} AS ({q.format(documents='documents', supplier='supplier')})" for n, q in ((f"t_{n}", q) for n, q in _TABLES.items())) + f", t_document_pages AS ({_PAGES.format(pages='doc_pages')})"


def _with(select: str) -> str:
    return with_pages("@").removesuffix("@").rstrip() + f", {_ALL} {select}"


def _audits() -> str:
    parts = []
    for name, columns in (("documents", ("id", "slug", "title", "status", "storage_bucket", "page_count", "requested_page_count")), ("authors", ("id", "display_name", "sort_name")), ("document_authors", ("document_id", "author_id", "ordinal")),
                          ("document_pages", ("id", "document_id", "page_number")), ("document_assets", ("id", "document_id", "asset_type", "storage_bucket", "storage_path")), ("document_metadata_snapshots", ("document_id",))):
        parts += [f"SELECT '{name}: {c} is missing' AS rule, NULL AS key, count(*) AS rows FROM t_{name} WHERE {c} IS NULL HAVING count(*) > 0" for c in columns]
    for name, key in (("documents", ("id",)), ("documents", ("slug",)), ("authors", ("id",)), ("authors", ("sort_name",)), ("document_authors", ("document_id", "author_id")), ("document_pages", ("id",)), ("document_pages", ("document_id", "page_number")),
                      ("document_assets", ("id",)), ("document_assets", ("document_id", "storage_path")), ("document_metadata_snapshots", ("document_id",))):
        parts.append(f"SELECT '{name}: unique {', '.join(key)}', [{', '.join(f'cast({k} AS string)' for k in key)}], count(*) FROM t_{name} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in key)} GROUP BY {', '.join(key)} HAVING count(*) > 1")
    for child, column, parent in (("document_authors", "document_id", "documents"), ("document_authors", "author_id", "authors"), ("document_pages", "document_id", "documents"), ("document_assets", "document_id", "documents"), ("document_metadata_snapshots", "document_id", "documents")):
        parts.append(f"SELECT '{child}: {column} refers to {parent}', [cast({column} AS string)], count(*) FROM t_{child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM t_{parent}) GROUP BY {column}")
    return " UNION ALL ".join(f"({p})" for p in parts)


_GONE = "(SELECT id FROM t_documents WHERE title IN ('src1', 'src2'))"
_LEFT = " UNION ALL ".join(
    ["SELECT 'documents' AS name, id AS key FROM t_documents WHERE coalesce(title NOT IN ('src1', 'src2'), true)", "SELECT 'authors', id FROM t_authors"]
    + [f"SELECT '{n}', document_id FROM t_{n} WHERE document_id IS NULL OR document_id NOT IN {_GONE}" for n in ("document_authors", "document_pages", "document_assets", "document_metadata_snapshots")])
_REPORT = "'{\n  \"status\": \"dry_run\",\n  \"reason\": null,\n  \"slug\": \"é-' || s_suppkey || '\",\n  \"storage_bucket\": \"b\",\n  \"storage_root\": \"documents/é-' || s_suppkey || '\",\n  \"uploaded_assets\": ' || s_suppkey % 7 || ',\n  \"published_pages\": ' || s_suppkey % 5 || ',\n  \"slug_conflict_policy\": \"skip\",\n  \"published_at\": null\n}'"
_KIND = "CASE path WHEN 'n_digitalized.pdf' THEN 'pdf' WHEN 'n_Korean.pdf' THEN 'pdf' " + " ".join(f"WHEN 'n{end}' THEN '{k}'" for k, end in O.REPORTS.items()) + " ELSE 'log' END"

_LEAST = "greatest(6, cast(floor({} * 0.02) AS int))"
ORACLE_SQL = {
    "page_margins": f"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'x', 'g'), '[\\x20\\x09-\\x0D]', ' ', 'g'), '') AS c FROM documents),
      p AS (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS i, cast(ceil(len(c) / {_WIDTH}) AS int) AS h FROM t),
      x AS (SELECT doc_id, i % {_WIDTH} AS x, any_value(h) AS h FROM p WHERE c <> ' ' GROUP BY 1, 2 HAVING count(*) >= {_LEAST.format('any_value(h)')}),
      y AS (SELECT doc_id, i // {_WIDTH} AS y, any_value(h) AS h FROM p WHERE c <> ' ' GROUP BY 1, 2 HAVING count(*) >= {_LEAST.format(_WIDTH)}),
      m AS (SELECT doc_id, min(x) AS l, {_WIDTH} - 1 - max(x) AS r FROM x GROUP BY 1), n AS (SELECT doc_id, min(y) AS t, any_value(h) - 1 - max(y) AS b, any_value(h) AS h FROM y GROUP BY 1)
      SELECT d.doc_id, l / {_WIDTH}.0::DOUBLE AS "left", r / {_WIDTH}.0::DOUBLE AS "right", n.t / n.h::DOUBLE AS top, n.b / n.h::DOUBLE AS bottom FROM documents d LEFT JOIN (m JOIN n USING (doc_id)) USING (doc_id)""",
    "page_medians": """SELECT lang, median(380.0::DOUBLE + length(line) % 211 + (n - 1) % 10 / 10.0::DOUBLE) AS width, median((560 + length(line) % 223)::DOUBLE) AS height, median(CASE WHEN (n - 1) % 4 <> 0 THEN length(line) % 25 / 100.0::DOUBLE END) AS "left"
      FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY lang""",
    "folder_summary": OPERATIONS_SQL["ops_summary"].replace("FROM documents", f"FROM {_SUPPLIERS}"),
    "folder_kinds": f"SELECT {_KIND} AS kind, count(*) AS files, cast(sum(strlen(content)) AS bigint) AS bytes, cast(sum(CASE WHEN path LIKE '%.pdf' THEN 0 ELSE strlen(content) END) AS bigint) AS bytes_read FROM ({FILES.format(documents=_SUPPLIERS)}) GROUP BY 1",
    "report_files": f"SELECT 'out-' || s_suppkey || '/n_publish_report.json' AS path, {_REPORT} AS content FROM supplier",
    "constraint_audit": _with(_audits()),
    "cascade_delete": _with(f"SELECT name, key, count(*) AS rows FROM ({_LEFT}) GROUP BY ALL"),
    "search_index": CATALOG_SQL["search_tokens"],
    "search_index_rare": with_catalog(f"SELECT id, title FROM (SELECT *, {_TEXT} AS t FROM published) WHERE contains(t, '10.1000/1') AND contains(t, 'journal') AND contains(t, '3') AND contains(t, 'src')"),
}

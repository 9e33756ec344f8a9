"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Nulls count as empty texts. Texts of any length are judged whole. Repeated rows are judged one by one. Columns that
the rules don't know pass through, whatever their names; those named like a measure are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, let, table, word_array

#: Function words of the languages in the corpus, lower case.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on that the this to was with you have not "
    "aber auf aus das dem den der des die ein eine einer er es ich im ist mit nicht sie sich und von war wie zu "
    "au aux ce dans de des du elle en est et il je la le les mais ne pas pour que qui sur un une "
    "al como con del el los las lo mas no o para pero por se su sus una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure that must lie between low and high (None: open)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Ratios of an empty text are 0.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 1.5, 15),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
)


def _repeated(words: Column, width: int) -> Column:
    """Words covered by a window of `width` words found twice or more in the array. Windows are compared by 64-bit hashes.

    The hashes of most texts are all different, which a hash set tells; only other texts are sorted.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(width)]),
    )

    def starts(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: F.array_sort(F.array_distinct(F.flatten(F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(width)))
        return F.aggregate(gaps, F.lit(width), lambda s, g: s + g)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(some)


def measures(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """docs with what the rules judge: counts (long) and ratios (double)."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = let(word_array(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeated(w, 5).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
    ))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    of_words, of_lines = (f"_{uuid.uuid4().hex}" for _ in range(2))
    found = docs.withColumns({
        of_words: counts, of_lines: dup,
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
    })
    found = found.withColumns({c: F.col(f"{s}.{c}") for s, cs in ((of_words, ("n_words", "n_repeat_words", "n_stop_words")), (of_lines, ("n_lines", "n_dup_lines"))) for c in cs}).drop(of_words, of_lines)

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return found.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    })


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The table of thresholds as one boolean column over measures()."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.measure) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.measure) <= r.high)
    return ok


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with their measures, base_failed, kept, and failed (names of the rules that failed)."""
    m = measures(docs, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~compiled([r]), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull())
    return m.withColumns({"base_failed": base, "failed": failed, "kept": ~base & compiled(rules)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE word_chars / n_words >= 1.5 AND word_chars / n_words <= 15 AND n_symbols / n_words <= 0.1
    AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.4) END AS kept
FROM b
"""

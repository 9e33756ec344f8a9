"""Fill-in-middle documents: texts cut at two unit boundaries and put into another order around three marks.

A unit is a run of white space with the word behind it; white space that ends a text is a unit of its own. White space is
ASCII's, so units end at bytes that end code points, and a text is worked on as UTF-8, each set of bytes as one big integer
with a bit a byte: `bytes.translate` writes a class as digits, a shift and boolean operations mark the last byte of every
unit at once, `bit_count` gives their number, and the r-th of them is found by halving the integer.

Where a text is cut, and into which form it goes, follows from the sha256 of the seed and its id alone, so repeated ids are
cut by the same draws and reruns agree. A null id draws as the empty string. Null texts count as empty; these, and texts
that hold one of the marks, stay plain. Very long texts are cut whole. An empty table gives an empty result. Only the id
and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import lean, table
from foliant.llm.tokens import slices

MARKS = ("<P>", "<S>", "<M>")
_SPACE = b" \t\n\v\f\r"
#: A byte's digit in a mask: of white space, and of bytes that begin a code point.
_WHITE = bytes(b"01"[b in _SPACE] for b in range(256))
_FIRST = bytes(b"10"[b & 0xC0 == 0x80] for b in range(256))


def mask(text: bytes, digits: bytes) -> int:
    """The bytes of a class as a number: bit i stands for byte i."""
    return int(text.translate(digits)[::-1] or b"0", 2)


def unit_ends(text: bytes) -> int:
    """The last byte of every unit."""
    size = len(text)
    white = mask(text, _WHITE)
    word = ((1 << size) - 1) ^ white
    return (word & ~(word >> 1)) | (white & (1 << size >> 1))  # a word's byte before one of no word; white space at the end


def select(bits: int, rank: int) -> int:
    """The place of the rank-th one, counted from 1, by halving."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank <= n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that belong to an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[a : a + 8], 16) for a in range(0, 32, 8))


def cut(text: bytes, first: int, second: int) -> tuple[int, int, int]:
    """How many units a text has, and the bytes at which its prefix and its middle end, for two drawn numbers."""
    ends = unit_ends(text)
    n = ends.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, *(select(ends, r) + 1 if r else 0 for r in (a, b))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Sequence[str] = MARKS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    `rate` of a hundred texts are cut, `spm_rate` of a hundred of them suffix first.
    """
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)
    key = F.col(f"`{id_col}`").cast("long").alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def one(doc_id: int | None, t: bytes) -> tuple:
        first, second, third, fourth = draws(seed, doc_id)
        n, a, b = cut(t, first, second)
        if not t or any(m.encode() in t for m in marks) or third % 100 >= rate:
            return doc_id, n, "plain", None, None, t
        begins = mask(t, _FIRST)
        chars = (begins & ((1 << a) - 1)).bit_count(), (begins >> a & ((1 << (b - a)) - 1)).bit_count()
        p, m, s = t[:a], t[a:b], t[b:]
        if fourth % 100 < spm_rate:
            return doc_id, n, "spm", *chars, b"".join((suffix_mark, s, prefix_mark, p, middle_mark, m))
        return doc_id, n, "psm", *chars, b"".join((prefix_mark, p, suffix_mark, s, middle_mark, m))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in slices(texts):
                done = [one(i, t) for i, t in zip(ids[lo:hi], texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist())]
                columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names)

    return rows.mapInArrow(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output of a form was made of; no text that was cut holds a mark, and no mark overlaps itself."""
    p = F.split(output, "|".join(map(re.escape, marks)), -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS h1, ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS h2,
         ('0x' || digest[17:24])::BIGINT % 100 AS h3, ('0x' || digest[25:32])::BIGINT % 100 AS h4
  FROM units),
cut AS (
  SELECT doc_id, n, text, array_to_string(units[1:least(h1, h2)], '') AS p, array_to_string(units[least(h1, h2) + 1:greatest(h1, h2)], '') AS m,
         array_to_string(units[greatest(h1, h2) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

"""How many tokens texts have, by a BPE of the tokenizers library, mostly without merging.

Which strings of the vocabulary encode alone as one token is proved once, on the driver, by giving each to the model
(`whole_tokens`). The library's own normalizer and pre-tokenizer cut a text; a pre-token with a proof counts one, and only
the rest is merged. Where the tokenizer drops white space (`apart`), the pieces between it encode one by one, so each
distinct piece of a batch is cut once, and a worker keeps the counts of the short pieces that it met first.

Special strings inside a text are single tokens, as the library has it by default; a piece with one goes to the library
as it is, and so does one with white space other than ASCII's. Null texts count as empty, which have no token. Each row
keeps its own entry, whatever repeats or is null in it; very long texts are counted whole. An empty table gives an empty
result. Only the id columns and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import os
import sys
import types
from collections.abc import Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.llm.common import lean, table
from foliant.llm.tokens import slices

#: Tokens beyond which a text is over the limit.
LIMIT = 2048
#: A pattern whose matches never hold or look at white space (fixed values).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalizers that treat what stands between white space by itself.
_LOCAL = ("NFC", "NFD", "Lowercase", "Replace")
#: White space that the library may know, or Python, but that isn't ASCII's.
_OTHER_WHITE = r"[\x1c-\x1f\x85\p{Z}]"


def _load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, json.loads(tokenizer.to_str())


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens, as the pre-tokenizer writes them, that the model gives as exactly one token; each is tried."""
    tokenizer, spec = _load(path)
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        raise ValueError("the proofs hold for a BPE without dropout")
    end = spec["model"].get("end_of_word_suffix") or ""
    names = {t.removesuffix(end) for t in tokenizer.get_vocab(with_added_tokens=False) if t.endswith(end)}
    return frozenset(t for t in names if t and len(tokenizer.model.tokenize(t)) == 1)


def apart(spec: dict) -> bool:
    """Whether the pieces of a text between ASCII white space encode one by one, as a tokenizer's JSON tells."""
    normalizer, cut = spec["normalizer"] or {"type": "Sequence", "normalizers": []}, spec["pre_tokenizer"] or {}
    steps = normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    local = all(s["type"] in _LOCAL and (s["type"] != "Replace" or (s["pattern"], s["content"]) == ({"Regex": r"\s+"}, " ")) for s in steps)
    first, *rest = cut["pretokenizers"] if cut.get("type") == "Sequence" else [cut]
    words = first.get("type") == "Split" and first["pattern"] == {"Regex": _WORDS} and first["behavior"] == "Removed" and first["invert"]
    return local and words and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)


class Counter:
    """Counts the tokens of columns of texts; keeps the counts of `keep` pieces of at most `short` characters."""

    def __init__(self, path: str, whole: frozenset[str], keep: int = 500_000, short: int = 64) -> None:
        self.tokenizer, spec = _load(path)
        self.whole, self.keep, self.short, self.known = whole, keep, short, {"": 0}
        self.special, self.apart = [t["content"] for t in spec["added_tokens"]], apart(spec)

    def _library(self, texts: list[str]) -> np.ndarray:
        return np.fromiter((len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int64, len(texts))

    def _cut(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """The pre-tokens of a text without special strings, each with its place in the normalized one."""
        normalizer, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return cut.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)

    def _sizes(self, cuts: list[str]) -> np.ndarray:
        """Pre-tokens with a proof count one, the others are merged."""
        merge = self.tokenizer.model.tokenize
        return np.fromiter((1 if p in self.whole else len(merge(p)) for p in cuts), np.int64, len(cuts))

    def _together(self, pieces: list[str]) -> np.ndarray:
        """The counts of pieces without white space or special strings, cut in one go with a space between them."""
        cuts = self._cut(" ".join(pieces))
        lengths = np.fromiter(map(len, self.tokenizer.normalizer.normalize_str(" ".join(pieces)).split(" ") if self.tokenizer.normalizer else pieces), np.int64)
        if len(lengths) != len(pieces):  # something else became a space
            return self._library(pieces)
        begins = np.cumsum(lengths + 1) - lengths - 1
        owner = np.searchsorted(begins, np.fromiter((at for _, (at, _) in cuts), np.int64, len(cuts)), "right") - 1
        return np.bincount(owner, self._sizes([p for p, _ in cuts]), len(pieces)).astype(np.int64)

    def _pieces(self, pieces: pa.Array) -> np.ndarray:
        """The counts of distinct pieces."""
        words = pieces.to_pylist()
        found = list(map(self.known.get, words))
        new = [i for i, n in enumerate(found) if n is None]
        if new:
            some = pieces.take(pa.array(new))
            odd = pc.match_substring_regex(some, _OTHER_WHITE)
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(some, s))
            odd, counts, words = np.asarray(odd), np.zeros(len(new), np.int64), some.to_pylist()
            if odd.any():
                counts[odd] = self._library([w for w, x in zip(words, odd) if x])
            plain = np.flatnonzero(~odd)
            for a in range(0, len(plain), 1000):
                counts[plain[a : a + 1000]] = self._together([words[i] for i in plain[a : a + 1000]])
            for i, w, n in zip(new, words, counts.tolist()):
                found[i] = n
                if len(self.known) < self.keep and len(w) <= self.short:
                    self.known[w] = n
        return np.array(found, np.int64)

    def column(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; none is null."""
        if not len(texts):
            return np.zeros(0, np.int64)
        if not self.apart:
            whole = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts.to_pylist()):
                whole[i] = self._library([t])[0] if any(s in t for s in self.special) else self._sizes([p for p, _ in self._cut(t)]).sum()
            return whole
        split = pc.split_pattern(pc.replace_substring_regex(texts, r"[\t-\r]", " "), " ")
        pieces = split.flatten().dictionary_encode()
        until = np.concatenate([[0], np.cumsum(self._pieces(pieces.dictionary)[np.asarray(pieces.indices)])])
        ends = np.cumsum(np.asarray(pc.list_value_length(split)), dtype=np.int64)
        return np.diff(until[np.concatenate([[0], ends])])


def _counter(path: str, whole) -> Counter:
    """This worker process's counter of a tokenizer, kept in a module of its own beyond the task."""
    kept = sys.modules.setdefault("foliant_kept_counters", types.ModuleType("foliant_kept_counters")).__dict__
    if path not in kept:
        kept[path] = Counter(path, whole.value)
    return kept[path]


def count(docs: DataFrame, path: str, text: str = "text", ids: Sequence[str] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The id columns, and n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of each row's text."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary
    own = [f"_id{i}" for i in range(len(ids))]  # mapInArrow can't read names with dots
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(ids, own)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    result = StructType([*rows.schema.fields[:-1], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def run(batches):
        for b in batches:
            counter, texts = _counter(path, whole), b.column(len(ids))
            for lo, hi in slices(texts):
                some = texts.slice(lo, hi - lo)
                held = [b.column(i).slice(lo, hi - lo) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*held, pc.binary_length(some).cast(pa.int64()), pa.array(counter.column(some))], [*own, "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(lean(run), result)
    return counted.select(*[F.col(o).alias(c) for c, o in zip(ids, own)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

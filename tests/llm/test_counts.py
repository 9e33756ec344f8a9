"""Token counts against the library's own encoding."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliant.llm import common, counts

SF = "/root/testdata/sf0.01"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
#: Characters of every class that the tokenizer tells apart, white space of all kinds, marks, special strings.
PARTS = [
    "don't", "we'll", "I'VE", "'s", "''", "École", "École", "́x", "ﬁne", "İstanbul", "ΟΔΟΣ", "日本語テキスト", "한국어", "½", "12", "٣", "x2y", "!!", "…", "—", "😀", "👩‍👩‍👧", "a b", " ", "\x85",
    "\x1c", "\x1fz", "​", "﻿", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>y", "<|endoftext", "supercalifragilistic", "q" * 300, "\x00", "", "the", "of", ",", "Ġ", "</w>",
]


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(n=400):
    random.seed(11)
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "", "", " \n "]
    return ["", " ", "\n\n"] + ["".join(random.choice(PARTS) + random.choice(gaps) for _ in range(random.choice([1, 2, 5, 30]))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts_of_odd_texts(path):
    texts = odd_texts()
    counter = counts.Counter(path, counts.whole_tokens(path))
    assert counter.apart == (path == WORDS)
    for _ in range(2):  # the second time from what is kept
        assert counter.column(pa.array(texts)).tolist() == library(path, texts)
    few = counts.Counter(path, counts.whole_tokens(path), keep=3, short=2)
    assert few.column(pa.array(texts)).tolist() == library(path, texts)


def test_proofs_and_merges():
    whole, model = counts.whole_tokens(WORDS), Tokenizer.from_file(WORDS).model
    assert len(whole) > 20_000 and {"the", "hello"} <= whole and not any(t.endswith("</w>") for t in whole if len(t) > 4)
    assert all(len(model.tokenize(t)) == 1 for t in list(whole)[::50])
    counter, merged = counts.Counter(WORDS, whole), []

    class Spy:
        def tokenize(self, p):
            merged.append(p)
            return model.tokenize(p)

    class Tok:
        def __init__(self, t):
            self.normalizer, self.pre_tokenizer, self.model = t.normalizer, t.pre_tokenizer, Spy()

    counter.tokenizer = Tok(counter.tokenizer)
    assert counter.column(pa.array(["The hello the zzqxv, hello"])).tolist() == [5 - 1 + len(model.tokenize("zzqxv")) + 1]
    assert merged == ["zzqxv"]  # only what has no proof is merged


def test_query_equals_the_library(spark):
    docs = [(r.doc_id, r.text or "") for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = {d: (len(t.encode()), n, n > 2048) for (d, t), n in zip(docs, library(WORDS, [t for _, t in docs]))}
    got = counts.query(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want and any(x[2] for x in want.values())


def test_odd_rows(spark):
    long = "the word " * 200_000
    rows = [(1, None, 5), (1, None, 5), (None, "hello", None), (3, "", 1), (4, long, 1), (4, "hello there", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in counts.count(docs, WORDS).collect()), key=str)
    assert got == sorted([(1, 0, 0, False)] * 2 + [(None, 5, 1, False), (3, 0, 0, False), (4, len(long), 400_000, True), (4, 11, 2, False)], key=str)
    named = spark.createDataFrame([("a.b", "hello")], "`x.y` string, body string")
    assert [tuple(r) for r in counts.count(named, WORDS, "body", ["x.y"], limit=0).collect()] == [("a.b", 5, 1, True)]
    assert counts.count(docs.limit(0), WORDS).count() == 0

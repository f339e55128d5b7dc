import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from farebox.llm import boundaries as b
from farebox.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(b.VOCABULARY)
PLAIN, OWN = Tokenizer.from_file(PATH), b.Boundaries(PATH)
#: Contractions, white space of all widths, the added token and parts of it, marks, letters that no token joins.
PIECES = [*"ab '\t\n\r!?\"<|>123é中文ж　\xa0  ​﻿\x85\x1c\x00ÀŁ😀́", "<|endoftext|>", "<|endoftext", "'re", "'ll", " 's", "n't", "\n\n", "  ", "the ", " The"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(max_size=30)), max_size=8), st.sampled_from([16, 64, 1 << 20]))
def test_same_ids_as_the_library(texts, window):
    b.WINDOW, before = window, b.WINDOW
    try:
        got = OWN.encode(pa.array(texts, pa.string()))
    finally:
        b.WINDOW = before
    assert got.to_pylist() == [plain(t) for t in texts]
    assert OWN.decode(got).to_pylist() == [PLAIN.decode(plain(t), skip_special_tokens=False) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50_256), max_size=12), max_size=5))
def test_decodes_any_ids(ids):
    assert OWN.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [PLAIN.decode(x, skip_special_tokens=False) for x in ids]


def test_no_token_holds_a_certain_cut():
    byte = b.byte_of_character()
    for token, i in PLAIN.get_vocab().items():
        if i != 50_256:
            raw = bytes(byte[c] for c in token)
            assert not any(OWN.certain[x << 8 | y] for x, y in zip(raw, raw[1:], strict=False))


def test_long_texts_without_cuts():
    for text in ("a" * 100_000, "the quick brown fox " * 20_000, "中" * 50_000, " " * 70_000 + "x"):
        assert OWN.encode(pa.array(["x", text, ""])).to_pylist() == [plain("x"), plain(text), []]


def test_query_equals_the_library(spark):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = QUERIES["op12_forced_boundaries"](spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {d: (len(ids), digest(",".join(map(str, ids))), digest(PLAIN.decode(ids, skip_special_tokens=False))) for d, t in texts.items() for ids in [plain(t)]}


def test_odd_rows_and_other_columns(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (2, "it's", "z"), (2, "it's", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = docs.select("*", b.encode(F.col("text")).alias("numbers")).select("*", b.decode(F.col("numbers")).alias("back")).collect()
    assert [(r.doc_id, r.text, r.ids) for r in got] == rows and [r.back for r in got] == [r.text for r in got]
    assert [r.numbers for r in got] == [None if t is None else plain(t) for _, t, _ in rows]
    unknown = spark.createDataFrame([([64, -1, 1 << 20, None, 65],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in unknown.select(b.decode(F.col("ids"))).collect()] == ["ab", None, ""]
    assert docs.limit(0).select(b.encode(F.col("text"))).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        b.Boundaries(public_tokenizers.path("word_bpe_49k.json"))

import json

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import encode

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def whole(name, text):
    return encode.encoder(name).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=700, deadline=None)
@given(text=st.text(alphabet="aAé'sld1٣ \n\t.!- ́İßΣ漢\x1c\x85|<>", max_size=30))
def test_words_give_the_ids_of_the_text(name, text):
    assert encode.encoder(name).ids([text])[0].tolist() == whole(name, text)


@pytest.mark.parametrize("name", NAMES)
def test_real_texts(name):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += ["", " ", "\n", "a  b", " lead", "trail ", "x<|endoftext|> y", "a\n\nb", "a \n b", "don't we'll", "x" * 5000, "1234 5,6"]
    for t, got in zip(texts, encode.encoder(name).ids(texts), strict=True):
        assert got.tolist() == whole(name, t)


@pytest.mark.parametrize("name", NAMES)
def test_small_memory(name, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 50)
    texts = [f"word{i} other{i % 7}, and {i}" for i in range(600)]
    e = encode.Encoder(public_tokenizers.path(name))
    for t, got in zip(texts, e.ids(texts), strict=True):
        assert got.tolist() == whole(name, t)


@pytest.mark.parametrize("name", NAMES)
def test_long_and_many(name):
    texts = ["a" * 70_000, "ab1, " * 3_000, " ".join(f"Wörd{i}x" for i in range(70_000)), "漢字" * 40_000]
    for t, got in zip(texts, encode.encoder(name).ids(texts), strict=True):
        assert got.tolist() == whole(name, t)


def test_other_vocabularies_go_whole(tmp_path):
    with open(public_tokenizers.path(NAMES[0]), encoding="utf-8") as file:
        said = json.load(file)
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(said))
    e = encode.Encoder(str(tmp_path / "other.json"))
    assert e.spaced is None
    assert e.ids(["some words"])[0].tolist() == e.tokenizer.encode("some words", add_special_tokens=False).ids

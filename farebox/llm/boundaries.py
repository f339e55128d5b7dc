"""Byte-level BPE by forced boundaries: texts to ids and back.

A pair of adjacent bytes that stands inside no token of the vocabulary is a boundary that no merge can cross. So a text is cut at
such pairs, each distinct fragment is encoded by the library once, and the ids of the fragments, one after the other, are the text's.

The library also splits a text by a pattern before its merges, and a fragment has to be split as it is within its text. The pattern's
alternatives are runs of one class of characters with a blank before them, contractions, and runs of white space, of which the last
character goes with the word after it. So no cut is made after white space (a run's end would be taken for the text's end) nor before an
apostrophe (in the middle of a run it starts no contraction); a pair within a contraction is part of a token. Before white space, and
between two characters that aren't white space, a cut is safe. What libraries take for white space differs; all that any takes counts.
The strings of added tokens are fragments of their own.

Cutting, finding distinct fragments, joining ids and decoding are operations on the buffers of Arrow columns, in windows of WINDOW bytes:
a longer text is cut at the last boundary of each window. Both directions are functions of a column, so there is no shuffle, and a
frame's other columns stay as they are, whatever their names.

Edge cases: a null text has null ids, as decoded text too (the query takes null texts for empty ones); an empty text has no ids; texts
are encoded whole, however long; when decoding, ids outside of the vocabulary and null ids stand for nothing, and bytes that aren't UTF-8
become replacement characters; repeated rows are encoded each; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from farebox.llm.common import table, text_or_empty
from farebox.llm.encode import Memory

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are cut at once.
WINDOW = 1 << 20
#: Fragments that a generation of a worker's memory holds, each up to SHORT bytes.
REMEMBERED = 150_000
SHORT = 64
#: Single bytes that some library takes for white space: controls 9 to 13 and 28 to 31, and the blank.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, those from 256 on for the rest."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _after_wide_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white space character of two or three bytes ends before each place."""
    last, mid, first = data[at - 1], data[at - 2], data[at - 3]
    two = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
    general = (first == 0xE2) & ((mid == 0x80) | (mid == 0x81))
    ideographic = (first == 0xE3) & (mid == 0x80) & (last == 0x80)
    rare = (first == 0xE1) & ((mid == 0x9A) & (last == 0x80) | (mid == 0xA0) & (last == 0x8E)) | (first == 0xEF) & (mid == 0xBB) & (last == 0xBF)
    return two | general | ideographic | rare


class Boundaries:
    """A byte-level vocabulary with its certain cuts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before = said["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or said["normalizer"] or said["model"].get("ignore_merges"):
            raise ValueError("not a byte-level vocabulary with the usual split and no prefix")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError("added tokens that take in what stands beside them aren't supported")
        self.path = path
        self.added = [t["content"].encode() for t in said["added_tokens"]]
        byte, added = byte_of_character(), {t["id"]: t["content"].encode() for t in said["added_tokens"]}
        vocab = {i: t for t, i in said["model"]["vocab"].items()} | dict.fromkeys(added)
        raw = [added[i] if i in added else bytes(map(byte.__getitem__, vocab[i])) if i in vocab else b"" for i in range(max(vocab) + 1)]
        #: The bytes of each token, and at the end those of an unknown one.
        self.tokens = pa.array([*raw, b""], pa.large_binary())
        inside = np.zeros((256, 256), bool)
        for i, token in enumerate(raw):
            if i not in added:
                codes = np.frombuffer(token, np.uint8)
                inside[codes[:-1], codes[1:]] = True
        starts = np.ones(256, bool)
        starts[0x80:0xC0] = starts[ord("'")] = False
        #: By first byte and second byte: whether a text may be cut between them.
        self.certain = (~inside & ~_BLANK[:, None] & starts[None, :]).ravel()
        self.memory = Memory(REMEMBERED)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer; where ids are only decoded it isn't loaded."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """The places of the certain cuts within the bytes of a text."""
        at = np.flatnonzero(self.certain[data[:-1].astype(np.uint16) << 8 | data[1:]]) + 1
        wide = data[at - 1] >= 0x80
        if wide.any():
            keep = ~wide
            keep[wide] = ~_after_wide_blank(data, at[wide])
            at = at[keep]
        return at

    def _marked(self, data: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
        """Where the strings of added tokens stand, each within one text. texts: where texts start."""
        raw, found = data.tobytes(), []
        for mark in self.added:
            at = raw.find(mark)
            while at >= 0:
                whole = np.searchsorted(texts, at, "right") == np.searchsorted(texts, at + len(mark), "left")
                if whole:
                    found.append((at, at + len(mark)))
                at = raw.find(mark, at + (len(mark) if whole else 1))
        return sorted(found)

    def _window_end(self, data: np.ndarray, start: int, end: int) -> int:
        """The last certain cut of data[start:] up to WINDOW bytes (more, if there is none), or end."""
        size, longest = WINDOW, max(map(len, self.added), default=0)
        while start + size < end:
            found = self.cuts(data[start : start + size])
            for cut in found[::-1].tolist():
                near = data[max(start, start + cut - longest + 1) : start + cut + longest - 1].tobytes()
                if not any(mark in near for mark in self.added):
                    return start + cut
            size *= 2
        return end

    def _fragments(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where the fragments of data start, and its end. texts: where texts start, and the end."""
        here = np.zeros(data.size + 1, bool)
        if data.size > 1:
            here[self.cuts(data)] = True
        for start, end in self._marked(data, texts):
            here[start : end + 1] = False
            here[[start, end]] = True
        here[texts] = True
        return np.flatnonzero(here)

    def _ids_of(self, fragments: list[str]) -> list[bytes]:
        found = self.memory.get(fragments)
        missed = [i for i, x in enumerate(found) if x is None]
        if missed:
            got = self.tokenizer.encode_batch_fast([fragments[i] for i in missed], add_special_tokens=False)
            short_keys, short_ids = [], []
            for i, e in zip(missed, got, strict=True):
                found[i] = array("i", e.ids).tobytes()
                if len(fragments[i]) <= SHORT:
                    short_keys.append(fragments[i])
                    short_ids.append(found[i])
            self.memory.put(short_keys, short_ids)
        return found

    def _encoded(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data, and how many of them stand before each of texts (where texts start, and the end)."""
        at = self._fragments(data, texts)
        parts = pa.LargeStringArray.from_buffers(at.size - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self._ids_of(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        _, offsets, values = ids.buffers()
        before = np.frombuffer(offsets, np.int64, at.size) // 4
        return np.frombuffer(values, np.int32, int(before[-1])), before[np.searchsorted(at, texts)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text of an Arrow column."""
        texts = texts.cast(pa.large_string())
        _, offsets, values = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        first, last = int(ends[0]), int(ends[-1])
        data = np.frombuffer(values, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
        ends = ends - first
        counts, out, start, n = np.zeros(ends.size, np.int64), [], 0, 0
        while start < data.size:
            k = np.searchsorted(ends, start + WINDOW, "right") - 1
            stop = int(ends[k])
            if stop <= start:
                stop = self._window_end(data, start, int(ends[k + 1]))
            own = slice(*np.searchsorted(ends, [start, stop]))
            bounds = np.unique(np.concatenate([[0], ends[own] - start, [stop - start]]))
            ids, before = self._encoded(data[start:stop], bounds)
            counts[own] = n + before[np.searchsorted(bounds, ends[own] - start)]
            out.append(ids)
            n, start = n + ids.size, stop
        counts[ends >= data.size] = n
        flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int32))
        missing = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), flat, mask=missing)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids of an Arrow column."""
        lists = ids.cast(pa.large_list(pa.int64()))
        ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int64)
        unknown = len(self.tokens) - 1
        flat = lists.values.fill_null(unknown).to_numpy(zero_copy_only=False)[int(ends[0]) : int(ends[-1])]
        flat = np.where((flat < 0) | (flat >= unknown), unknown, flat)
        _, offsets, values = self.tokens.take(pa.array(flat)).buffers()
        at = (np.frombuffer(offsets, np.int64) if offsets else np.zeros(1, np.int64))[ends - ends[0]]
        missing = np.array(lists.is_null()) if lists.null_count else np.zeros(len(lists), bool)
        raw = np.frombuffer(values, np.uint8, int(at[-1])).tobytes() if values else b""
        try:
            whole = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at.tobytes()), pa.py_buffer(raw))
            whole.validate(full=True)
            return whole.cast(pa.string()) if not missing.any() else pa.array(np.where(missing, None, whole.to_numpy(zero_copy_only=False)), pa.string())
        except pa.ArrowInvalid:
            each = [None if lost else raw[a:b].decode("utf-8", "replace") for a, b, lost in zip(at[:-1].tolist(), at[1:].tolist(), missing, strict=True)]
            return pa.array(each, pa.string())


@lru_cache(maxsize=1)
def boundaries(name: str) -> Boundaries:
    """A file of the public tokenizers; a Python worker keeps the last one."""
    import public_tokenizers

    return Boundaries(public_tokenizers.path(name))


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The ids of a text, array<int>."""

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return boundaries(vocabulary).encode(texts)

    return ids(text)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of ids, special tokens included."""

    @arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return boundaries(vocabulary).decode(lists)

    return text(ids)


def op12_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", encode(text_or_empty()).alias("ids"))
    both = docs.select("doc_id", "ids", decode(F.col("ids")).alias("decoded"))
    line = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

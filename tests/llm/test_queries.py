"""The registered queries over their whole smallest tables, against plain computations from the contract."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from farebox.llm import pii
from farebox.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op3(spark, texts):
    def fingerprint(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return 0
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op3_golay_simhash")}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_op4(spark, texts):
    for r in rows(spark, "op4_anchor_pii"):
        text, base = texts[r.doc_id], []
        for k, kind in enumerate(pii.BASE):
            for m in re.finditer(pii.PATTERNS[kind], text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                    continue
                base.append((m.start(), k, m.end()))
        line = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_op5(spark, texts):
    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op5_bit_packing")}
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got.keys() == texts.keys()


def test_op9(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for d, x in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op9_lexical_packing"):
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length, r.doc_id))
        assert r.doc_tokens == ids[r.doc_id].size and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at and n > 0
            at += n
        assert at == ids[d].size
    for own in windows.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096

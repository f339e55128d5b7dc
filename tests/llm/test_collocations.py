import glob
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import collocations as co
from farebox.llm.queries import ORACLES, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def expected(rows, least=30, top=2000):
    words, phrases = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            phrases.update((lang, *ws[i : i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
    candidates = {p: f for p, f in phrases.items() if len(p) > 2 and f >= least}
    dropped, scored = set(), {}
    for p, a in candidates.items():
        lang, *ws = p
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inner = (lang, *ws[i : i + m])
                if 100 * a >= 80 * phrases[inner]:
                    dropped.add(inner)
        cuts = []
        for k in range(1, len(ws)):
            left, right = phrases[lang, *ws[:k]], phrases[lang, *ws[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        scored[p] = min(cuts)
    out = []
    for lang in words:
        own = sorted((-scored[p][0], -a, " ".join(p[1:]).encode(), p) for p, a in candidates.items() if p[0] == lang and p not in dropped)
        out += [(lang, k, " ".join(p[1:]), -a, scored[p][2], scored[p][3], words[lang], -s) for k, (s, a, _, p) in enumerate(own[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql_and_plain_computation(spark, sf):
    got = QUERIES["op11_collocations"](spark, sf)
    assert all(dict(got.dtypes)[c] == "bigint" for c in COLUMNS if c not in ("lang", "phrase"))
    got = rows_of(got)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{glob.glob(f'{sf}/documents.parquet')[0]}'")
        assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_collocations']})").fetchall())
    assert got == expected([(r.lang, r.text) for r in spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()])


def test_both_ways_and_many_ranges(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected([(r.lang, r.text) for r in docs.collect()], least=5, top=40)
    assert rows_of(co.collocations(docs, least=5, top=40)) == want
    monkeypatch.setattr(co, "RANGE", 1 << 10)
    assert rows_of(co.collocations(docs.repartition(5), least=5, top=40, held=0)) == want


def test_odd_rows(spark):
    rows = [(None, "New  york\tCITY, new york city! x"), ("und", "new york city"), ("en", None), ("en", ""), ("en", "a\x01 b. a b. a\x01 b a b")]
    rows += [("en", "ÀB c;" * 3), ("en", "z"), ("en", "z"), ("fr", "de " * 40_000)]
    docs = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, rank int, word string").repartition(3)
    for held in (0, co.HELD):
        assert rows_of(co.collocations(docs, least=2, held=held)) == expected(rows, 2)
    assert rows_of(co.collocations(docs, least=2, top=1)) == expected(rows, 2, 1)
    assert rows_of(co.collocations(docs, least=10**9)) == [] and rows_of(co.collocations(docs.limit(0))) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.data())
def test_keys_keep_ids_and_order(bits, data):
    most = (1 << bits) - 1
    ids = np.array(data.draw(st.lists(st.integers(0, most) | st.sampled_from([0, 1, most]), max_size=60)), np.uint32)
    high, low = co._keys(ids, bits)
    windows = []
    for i in range(ids.size):
        own = [*ids[i : i + 4].tolist(), 0, 0, 0][:4]
        if own[0]:
            windows.append(tuple(x if all(own[:j]) else 0 for j, x in enumerate(own)))
    assert list(zip(*(c.tolist() for c in co._unpacked(high, low, bits)), strict=True)) == windows
    if windows:
        got = co._run_lengths(high, low, None, bits)
        told = list(zip(*(c.tolist() for c in co._unpacked(*got[:2], bits)), strict=True))
        assert dict(zip(told, got[2].tolist(), strict=True)) == Counter(windows) and told == sorted(told)
        assert [tuple(c.tolist()) for c in co._whole(co._digits(high, low, bits))] == [tuple(high.tolist()), tuple(low.tolist())]
        assert co._bytes(*got[:2]).tolist() == sorted(co._bytes(*got[:2]).tolist())


def test_scores_beyond_64_bits(spark):
    huge = 9 * 10**18
    candidates = spark.createDataFrame([(1, 2, 0, 0, huge)], "w1 long, w2 long, w3 long, w4 long, f long")
    known = candidates.union(spark.createDataFrame([(1, 0, 0, 0, huge + 7), (2, 0, 0, 0, huge + 10**17)], candidates.schema))
    assert [r.score for r in co._scored(candidates, known).collect()] == [2_000_000 * huge // (2 * huge + 7 + 10**17)]

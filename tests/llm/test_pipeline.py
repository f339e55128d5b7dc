import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from farebox.llm import mixing
from farebox.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and of what each stage gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "_")))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_takes_toxic_documents_only(spark, stages):
    before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in stages[:2])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = before - after
    assert gone and after < before
    toxic, clean = ([d for d in before if labels.get(d) == t] for t in (1, 0))
    # some 40 toxic examples to learn from; test_toxicity holds a larger table to more
    assert sum(d in gone for d in toxic) >= 0.75 * len(toxic) and sum(d in gone for d in clean) <= 0.03 * len(clean)


def test_one_of_each_group_stays(stages):
    rows = stages[1].collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (x == y or len(x & y) >= 0.8 * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d in ids if find(d) == d)


def test_private_data_is_replaced(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    assert before.keys() == after.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(mail.search(r.text or "") for r in before.values()) and not any(mail.search(r.text or "") for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)


def test_mix_meets_its_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = {r.source: r.target for r in mixing.decide(mixing._sized(stages[3], "doc_id", "source", "text")).collect()}
    got, most = Counter(), defaultdict(int)
    for r in after:
        got[r.source] += size(r)
    for r in before:
        most[r.source] = max(most[r.source], size(r))
    assert all(abs(got[s] - t) <= most[s] / 2 + 1 for s, t in want.items())
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_packing_is_whole(stages):
    copies, pieces = Counter(r.doc_id for r in stages[4].collect()), stages[5].collect()
    sequences, covered = defaultdict(list), defaultdict(Counter)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id].update(range(p.start, p.start + p.length))
    assert covered.keys() == copies.keys()
    for d, c in covered.items():
        assert set(c.values()) == {copies[d]}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name.replace(" ", "_"))
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ties, and extra columns with names that the operators use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = ["count", "low", "more", "_k", "_n", "_c", "fp", "row", "toxicity", "_toxicity", "score", "leaf", "ids", "key"]
    plain = [(i, f"plain text number {i} about this and that, as it is {i * 7}", "en", "ab"[i % 2], 40) for i in range(60)]
    odd = [(None, "a text without a number", "en", "a", 1), (100, None, None, None, None), (101, "", "en", "a", 0), (102, "word and word again " * 12_000, "en", "b", 9), (103, "same words in the same row", "en", "a", 5), (103, "same words in the same row", "en", "a", 5), (104, "write to me@example.org or +1 (826) 555-4081", None, "c", 3)]
    rows = [(*r, *([1] * len(extra))) for r in plain + odd]
    found = spark.createDataFrame(rows, ", ".join([*(f"{c} {k}" for c, k in docs.dtypes), *(f"{c} int" for c in extra)]))
    stages = [found]
    for name, stage in corpus_pipeline.STAGES:
        stages.append(written(stage(spark, stages[-1], SF), name.replace(" ", "_")))
    for df in stages[1:-1]:
        assert df.dtypes == found.dtypes
    kept = [r.doc_id for r in stages[2].collect()]
    assert kept.count(103) == 1 and {None, 100, 102} <= set(kept)
    assert not any("example.org" in (r.text or "") for r in stages[3].collect())
    pieces = stages[5].collect()
    assert sum(p.length for p in pieces if p.start == 0) > 0 and {p.doc_id for p in pieces} == {r.doc_id for r in stages[4].collect()}


def test_windows_hold_a_document_once(stages):
    """A copy of a document goes to another window, unless a shard has nothing else."""
    windows = defaultdict(list)
    for p in stages[5].collect():
        windows[p.sequence_id].append(p)
    twice = sum(len({(p.doc_id, p.start) for p in w}) < len(w) for w in windows.values())
    assert twice <= 0.02 * len(windows)


def test_stages_compose_without_writing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lazily = corpus_pipeline.mixed(spark, corpus_pipeline.duplicates(spark, docs, "/root/testdata/sf0.001"), "/root/testdata/sf0.001")
    one = corpus_pipeline.duplicates(spark, docs, "/root/testdata/sf0.001")
    n = lazily.count()
    assert n > 0 and one.count() > 0

import numpy as np
import pytest
import pyarrow.parquet as pq

from farebox.llm import neighbours as nb


def brute(ids, vectors, k=20, every=20):
    """{query_id: [(vec_id, score)]} by inner product in double precision."""
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = (vectors * v).sum(axis=1)
            order = np.lexsort((ids, -scores))
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order if ids[j] != i][:k]
    return out


def recall(got, want):
    """The share of the answers whose score reaches the brute-force one of the last rank."""
    hits = sum(sum(s >= w[-1][1] - 1e-12 for _, s in got[q]) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def gathered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall_on_the_table(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist())
    got, want = gathered(nb.op10_pruned_graph(spark, "/root/testdata/sf0.1").collect()), brute(ids, vectors)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.97
    place = {int(i): v for i, v in zip(ids, vectors, strict=True)}
    assert all(abs(s - float(place[q] @ place[v])) < 1e-12 for q, g in got.items() for v, s in g)


def test_norms_copies_and_many_shards(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    vectors *= 10 ** rng.uniform(-2, 2, (3000, 1))
    vectors[1000:1900] = vectors[20]  # a hot group of equal vectors
    vectors[1900:2300] = vectors[40] + 1e-6 * rng.normal(size=(400, 16))
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    rows = nb.valid_vectors(df)
    got = gathered(nb.search(rows.where("vec_id % 20 = 0"), nb.build_index(rows, 300), block=50).collect())
    want = brute(ids, vectors)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    for q, g in got.items():
        assert all(v != q for v, _ in g) and g == sorted(g, key=lambda x: (-x[1], x[0]))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, []), (None, [1.0, 1.0]), (160, [1.0, 0.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    valid = nb.valid_vectors(df)
    got = gathered(nb.search(valid.where("vec_id % 20 = 0"), nb.build_index(valid)).collect())
    assert got == {0: [(1, 1.0), (2, 0.5), (20, 0.0), (3, -1.0)], 20: [(2, 0.5), (0, 0.0), (1, 0.0), (3, 0.0)]}
    empty = nb.valid_vectors(df.limit(0))
    assert nb.search(empty, nb.build_index(empty)).count() == 0


def test_pruning_keeps_the_nearest_and_diverse():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [-3, 0]], np.float32)
    out = nb.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 0, 1]]), 3, 1.2)
    assert out.tolist() == [[1, 3, 4]]


def test_an_index_knows_how_many_neighbours_it_is_for(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i // 40)]) for i in range(120)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id = 0")
    got = nb.search(asked, nb.build_index(rows, k=70), k=70).collect()
    scores = sorted((r.score for r in got), reverse=True)
    assert len(got) == 70 and scores == [1.0] * 70 and {r.vec_id for r in got} == set(range(1, 71))
    with pytest.raises(Exception, match="20 neighbours at most"):
        nb.search(asked, nb.build_index(rows), k=21).collect()

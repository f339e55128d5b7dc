"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Equal vectors are one node, with the smallest vec_ids that have it: one more than the k neighbours that an index is built for, as no answer needs more. Nodes are dealt out by the hash of
their vector to shards of about SHARD nodes, apart for each dimension and each octave of the norm. A shard's graph is built
in one task, in batches: a greedy search proposes neighbours for the new nodes, and relaxed distance pruning (ALPHA) keeps at most DEGREE
diverse edges, which are then also entered backwards. One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of
the shard, makes the largest inner product the smallest distance. Shards are written as one row each.

Queries come in blocks of about BLOCK. A shard goes to one task, once, and is followed there by all blocks of its dimension, which stream past it
in the order of a sort; so a task holds one shard and one block. A beam search of width BEAM proposes a
shard's nodes, their inner products are computed in double precision from the original vectors, and the best K of all
shards stay. A shard with at most BEAM nodes is searched whole.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id; of several
rows with one vec_id the one with the least vector counts; vectors meet those of their own dimension only; a query with fewer
than K candidates gets them all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.llm.common import table, written

K = 20
SHARD = 3072
BLOCK = 1024
#: Tasks of a search at most.
TASKS = 10_000
DEGREE = 28
BEAM = 64
BUILD_BEAM = 48
ALPHA = 1.2
#: Nodes that a search expands at once.
WIDE = 4
_BATCH = 256
_GRAPHS = "shard long, dim int, most int, ids array<array<long>>, vectors binary, edges binary"


def _closest(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own nodes."""
    apart = x[at]
    apart -= q[:, None, :]
    return np.einsum("qrd,qrd->qr", apart, apart)


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, beam: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes of its beam, nearest first, with their distances; -1 and infinity where there are fewer.

    x: the vectors of the nodes, of which the first n are in the graph; the search starts from the first beam of them.
    """
    n, many = len(x) if n is None else n, len(q)
    starts = min(n, beam)
    ids = np.full((many, beam), -1, np.int64)
    far = np.full((many, beam), np.inf, np.float32)
    ids[:, :starts] = np.arange(starts)
    far[:, :starts] = _closest(x, q, ids[:, :starts])
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    done = ids < 0
    seen = np.zeros((many, n + 1), bool)  # the last column stands for no node
    seen[:, :starts] = seen[:, n] = True
    going = np.arange(many)
    while going.size:
        open_ = ~done[going]
        going = going[open_.any(axis=1)]
        if not going.size:
            break
        open_ = ~done[going]
        first = open_ & (np.cumsum(open_, axis=1) <= WIDE)
        done[going] |= first
        order = np.argsort(~first, axis=1, kind="stable")[:, :WIDE]
        nodes = np.where(np.take_along_axis(first, order, 1), np.take_along_axis(ids[going], order, 1), -1)
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(going.size, -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        rows = going[:, None]
        old = seen[rows, near]
        seen[rows, near] = True
        near = np.where(old, n, near)
        fresh = ~old
        width = int(fresh.sum(axis=1).max(initial=0))
        if not width:
            continue
        order = np.argsort(old, axis=1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        away = np.where(fresh, _closest(x, q[going], np.where(fresh, near, 0)), np.inf)
        all_far = np.concatenate([far[going], away], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, 1), axis=1, kind="stable"), 1)
        far[going] = np.take_along_axis(all_far, best, 1)
        ids[going] = np.take_along_axis(np.concatenate([ids[going], np.where(fresh, near, -1)], axis=1), best, 1)
        done[going] = np.take_along_axis(np.concatenate([done[going], ~fresh], axis=1), best, 1)
    return ids, far


def robust_prune(x: np.ndarray, at: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of at up to degree of its found candidates (-1: none): the nearest one stays, then whatever it is not alpha times
    nearer to than the node is goes on."""
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found[found == at[:, None]] = -1
    here = found >= 0
    away = np.where(here, _closest(x, x[at], np.where(here, found, 0)), np.inf)
    order = np.argsort(away, axis=1, kind="stable")
    order = order[:, : max(1, int(here.sum(axis=1).max(initial=0)))]
    found, away = np.take_along_axis(found, order, 1), np.take_along_axis(away, order, 1)
    alive = np.take_along_axis(here, order, 1)
    out = np.full((len(at), degree), -1, np.int64)
    rows, place = np.arange(len(at)), x[np.where(found >= 0, found, 0)]
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = found[rows, pick][some]
        apart = place - place[rows, pick][:, None, :]
        alive &= alpha * alpha * np.einsum("pcd,pcd->pc", apart, apart) > away
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> np.ndarray:
    """The edges of each node, as a table with -1 where it has fewer."""
    total = len(x)
    edges = np.full((total, degree), -1, np.int64)
    n = min(total, 1)
    while n < total:
        new = np.arange(n, min(total, 2 * n, n + _BATCH))
        found, _ = beam_search(x, edges, x[new], beam, n)
        if n < beam:  # the new nodes of a small graph are candidates of one another
            found = np.concatenate([found, np.broadcast_to(new, (new.size, new.size))], axis=1)
        edges[new] = robust_prune(x, new, found, degree, alpha)
        n = int(new[-1]) + 1
        to = edges[new].ravel()
        of = np.repeat(new, degree)[to >= 0]
        to = to[to >= 0]
        apart = x[of] - x[to]
        order = np.lexsort((np.einsum("ed,ed->e", apart, apart), to))
        of, to = of[order], to[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(to.size) - np.repeat(first, counts)
        back = np.full((nodes.size, degree), -1, np.int64)
        kept = place < degree
        back[np.repeat(np.arange(nodes.size), counts)[kept], place[kept]] = of[kept]
        for i in range(0, nodes.size, _BATCH):
            at = nodes[i : i + _BATCH]
            edges[at] = robust_prune(x, at, np.concatenate([edges[at], back[i : i + _BATCH]], axis=1), degree, alpha)
    return edges


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Scaled to the largest norm and with the coordinate that makes all norms equal."""
    x = vectors / np.abs(vectors).max()
    norms = np.einsum("nd,nd->n", x, x)
    most = norms.max()
    return np.hstack([x, np.sqrt(np.maximum(most - norms, 0))[:, None]]).astype(np.float32) / np.float32(np.sqrt(most))


def _queries_of(vectors: np.ndarray) -> np.ndarray:
    q = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    q /= np.sqrt(np.einsum("nd,nd->n", q, q))[:, None]
    return np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)


def _search_shard(ids: list[list[int]], vectors: np.ndarray, x: np.ndarray, edges: np.ndarray, names: np.ndarray, q: np.ndarray, k: int, beam: int):
    """For each query the k best (vec_id, score) of a shard, its own vec_id left out."""
    width = max(map(len, ids))
    own = np.full((len(ids), width), -1, np.int64)
    real = np.zeros((len(ids), width), bool)
    for i, some in enumerate(ids):
        own[i, : len(some)], real[i, : len(some)] = some, True
    for i in range(0, len(q), _BATCH):
        part, who = q[i : i + _BATCH], names[i : i + _BATCH]
        found, _ = beam_search(x, edges, _queries_of(part), beam)
        node = np.maximum(found, 0)
        score = (vectors[node] * part[:, None, :]).sum(axis=2)
        ok = ((found >= 0)[:, :, None] & real[node]).reshape(len(part), -1)
        near = own[node].reshape(len(part), -1)
        ok &= near != who[:, None]
        score = np.repeat(score, width, axis=1)
        order = np.lexsort((near, np.where(ok, -score, np.inf)), axis=1)[:, :k]
        for w, n, s, o in zip(who.tolist(), np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1), np.take_along_axis(ok, order, 1), strict=True):
            yield w, n[o].tolist(), s[o].tolist()


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each vec_id."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists("embedding", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _octave(embedding: str = "embedding"):
    """The octave of the norm; its borders lie between the powers of two, so that vectors of length one stay together."""
    most = F.array_max(F.transform(embedding, F.abs))
    square = F.aggregate(embedding, F.lit(0.0), lambda a, v: a + (v / most) * (v / most))
    return F.floor(F.log2(most) + F.log2(square) / 2 + 0.5).cast("int")


def build_index(rows: DataFrame, shard: int = SHARD, k: int = K) -> DataFrame:
    """The shards of rows (vec_id, embedding), each one row with its nodes' vec_ids, vectors and edges, for searches of up to k neighbours."""
    nodes = rows.withColumn("turn", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("turn") <= k + 1)
    nodes = nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.select("ids", "embedding", F.size("embedding").alias("dim"), _octave().alias("octave")), "nodes")
    sizes = nodes.groupBy("dim", "octave").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"))
    sizes = sizes.withColumn("base", F.sum("shards").over(Window.orderBy("dim", "octave")) - F.col("shards"))
    h = F.xxhash64("embedding")
    dealt = nodes.join(sizes, ["dim", "octave"]).select((F.col("base") + F.pmod(h, F.col("shards"))).alias("shard"), h.alias("h"), "dim", "ids", "embedding")

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("ids0", "ascending")])
        dim = rows.column("dim")[0].as_py()
        vectors = rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        edges = build_graph(lifted(vectors))
        return pa.table(
            [pa.array([rows.column("shard")[0].as_py()], pa.int64()), pa.array([dim], pa.int32()), pa.array([k], pa.int32()), pa.array([rows.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([vectors.astype("<f8").tobytes()]), pa.array([edges.astype("<i4").tobytes()])],
            names=["shard", "dim", "most", "ids", "vectors", "edges"],
        )

    return dealt.withColumn("ids0", F.element_at("ids", 1)).groupBy("shard").applyInArrow(build, _GRAPHS)


def search(queries: DataFrame, index: DataFrame, k: int = K, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id, embedding), one for each vec_id, in an index. A beam is as wide as k at least; an index that
    was built for fewer than k neighbours is an error."""
    beam = max(beam, k + 1)
    queries = written(queries.select("vec_id", "embedding", F.size("embedding").alias("dim")), "queries")
    ranges = index.groupBy("dim").agg(F.min("shard").alias("first"), F.max("shard").alias("last"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")).join(ranges, "dim")
    dealt = queries.join(blocks, "dim").groupBy("dim", "first", "last", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"))
    dealt = dealt.agg(F.collect_list("vec_id").alias("names"), F.flatten(F.collect_list("embedding")).alias("q"))
    asked = dealt.select(F.explode(F.sequence("first", "last")).alias("shard"), F.lit(True).alias("asks"), "names", "q")
    shards = index.withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    tasks = max(1, min(index.count(), TASKS))
    met = shards.repartition(tasks, "shard").sortWithinPartitions("shard", "asks")

    def find(batches):
        here = None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, asks, names, q, ids, vectors, edges, dim, most = (batch.column(c)[i] for c in ("shard", "asks", "names", "q", "ids", "vectors", "edges", "dim", "most"))
                if not asks.as_py():
                    if most.as_py() < k:
                        raise ValueError(f"the index is for {most.as_py()} neighbours at most, not {k}")
                    own = np.frombuffer(vectors.as_buffer(), "<f8").reshape(-1, dim.as_py())
                    here = shard.as_py(), ids.as_py(), own, lifted(own), np.frombuffer(edges.as_buffer(), "<i4").reshape(len(own), -1).astype(np.int64)
                elif here and here[0] == shard.as_py():
                    got = [*_search_shard(*here[1:], names.values.to_numpy(), q.values.to_numpy().reshape(len(names), -1), k, beam)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                        names=["query_id", "ids", "scores"],
                    )

    found = met.mapInArrow(find, "query_id long, ids array<long>, scores array<double>")
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(valid_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    index = written(build_index(rows), "graphs")
    return search(rows.where(F.col("vec_id") % 20 == 0), index)

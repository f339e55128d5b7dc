"""Packing by lexical retrieval: each window of ids is a seed document and the unused documents that are nearest to it.

Documents are encoded and routed by content, so that lexical neighbours meet in one shard: a tree of ROUTED sampled documents (two means,
again and again, on random projections of their BM25 weights) gives each document a leaf and a place in it. Documents are
dealt out by range of (leaf, place), a hash splits what is alike, and consecutive ones form shards of up to SHARD_DOCS documents
and SHARD_IDS ids. Only the routing is fitted on a sample; the number of documents, their mean length and the document frequencies of BM25
are those of the whole table, and every document is scored with all terms of its seed.

In a shard the first unused document is the seed of a window. Its nearest unused documents fill it greedily; the one that the end of
the window cuts is the next seed. A window takes a text once, and the same text again only when nothing else is left in the shard.
What a shard can't fill goes on with the next one; what a task leaves is cut into sequences whose lengths are
powers of two, which need no padding. Ties: the first document in the order of (leaf, place, hash).

Frequent terms are scored as a matrix product for some seeds at a time, the others by their postings. Work grows with the documents, and
with the documents of a shard, of which the size is bounded. A task holds one shard.

Edge cases: a null text is empty, so its ids are the end id; a document longer than a window fills windows of its own and
its rest is packed like any other; repeated rows are separate documents; other columns don't count; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm.common import new_path, table, text_or_empty
from farebox.llm.encode import encoder

WINDOW = 4096
VOCABULARY = "word_bpe_49k.json"
END = 2
SHARD_DOCS = 2048
SHARD_IDS = 1 << 22
K1, B = 1.2, 0.75
#: Terms scored as a matrix: the most frequent ones, in over one of RARE documents.
DENSE = 512
RARE = 64
#: Documents that the routing is fitted on, those of them in a leaf, and the dimensions of their projections.
ROUTED = 4096
LEAF = 16
DIMENSIONS = 32


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and how often each occurs."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    ends = np.empty_like(first)
    ends[:-1], ends[-1] = first[1:], ids.size
    return ids[first], ends - first


class Corpus:
    """What BM25 knows of all documents: their number, mean length and the idf of each id."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.n, self.mean, self.df = n, mean, df
        self.idf = np.log1p(np.maximum(n - df + 0.5, 0) / (df + 0.5))

    def weights(self, terms: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / self.mean))

    def columns(self) -> np.ndarray:
        """For each term its column of the matrix of frequent terms, -1: none."""
        common = np.argsort(-self.df, kind="stable")[:DENSE]
        common = common[self.df[common] * RARE > self.n]
        columns = np.full(self.df.size, -1, np.int64)
        columns[common] = np.arange(common.size)
        return columns


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """The sequences of a shard, each a list of pieces (document, start, length)."""
    sequences, left = fill_windows(docs, window, corpus)
    return sequences + cut_rest(left, window)


def fill_windows(docs: list[np.ndarray], window: int, corpus: Corpus | None) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of a shard's documents, and the pieces of those that couldn't be filled."""
    lengths = np.array([d.size for d in docs])
    index = Shard(docs, corpus)
    kinds: dict[bytes, int] = {}
    same = np.array([kinds.setdefault(d.tobytes(), len(kinds)) for d in docs])
    sequences: list[list[tuple[int, int, int]]] = []
    left: list[tuple[int, int, int]] = []
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int]] = []
    room = window

    def place(doc: int, start: int) -> int:
        """Puts the document from start on into the window as far as there is room; the place where it was cut."""
        nonlocal pieces, room
        n = min(room, int(lengths[doc]) - start)
        pieces.append((doc, start, n))
        room -= n
        if not room:
            sequences.append(pieces)
            pieces, room = [], window
        return start + n

    def fill(seed: int) -> tuple[int, int] | None:
        """Puts the nearest unused documents into the window; the one that was cut, and where."""
        near = index.scores(seed)
        held = np.zeros(len(kinds), bool)
        held[[same[d] for d, *_ in pieces]] = True
        near[held[same]] = -0.5
        near[~unused] = -1.0
        again = []
        for doc in _by_score(near, int(unused.sum())):
            if near[doc] >= 0 and held[same[doc]]:
                again.append(doc)
                continue
            held[same[doc]] = True
            unused[doc] = False
            cut = place(doc, 0)
            if not pieces:
                return (doc, cut) if cut < lengths[doc] else None
        for doc in again:
            unused[doc] = False
            cut = place(doc, 0)
            if not pieces:
                return (doc, cut) if cut < lengths[doc] else None
        return None

    first = 0
    while True:
        while first < len(docs) and not unused[first]:
            first += 1
        if first == len(docs):
            break
        seed, at = first, 0
        while True:
            unused[seed] = False
            while lengths[seed] - at >= window:
                at = place(seed, at)
            if at == lengths[seed]:
                break
            place(seed, at)
            next_ = fill(seed)
            if next_ is None:
                break
            seed, at = next_
        left += pieces
        pieces, room = [], window
    return sequences, left


def cut_rest(left: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Pieces put one after the other into full windows, and the last ones into sequences whose lengths are powers of two."""
    sequences: list[list[tuple[int, int, int]]] = []
    pieces: list[tuple[int, int, int]] = []
    room = window
    for doc, start, n in left:
        while n:
            m = min(n, room)
            pieces.append((doc, start, m))
            start, n, room = start + m, n - m, room - m
            if not room:
                sequences.append(pieces)
                pieces, room = [], window
    return sequences + _powers_of_two(pieces) if pieces else sequences


def _by_score(near: np.ndarray, n: int):
    """The n best documents, best first; most windows need only the first few."""
    few = 32
    if n > few:
        bar = np.partition(near, near.size - few)[near.size - few]
        top = np.flatnonzero(near > bar)
        yield from top[np.argsort(-near[top], kind="stable")].tolist()
        near = near.copy()
        near[top] = -1.0
        n -= top.size
    yield from np.argsort(-near, kind="stable")[:n].tolist()


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    total = sum(n for *_, n in pieces)
    rooms = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out: list[list[tuple[int, int, int]]] = [[]]
    room = rooms.pop(0)
    for doc, start, n in pieces:
        while n:
            if not room:
                out.append([])
                room = rooms.pop(0)
            m = min(n, room)
            out[-1].append((doc, start, m))
            start, n, room = start + m, n - m, room - m
    return out


class _Scored:
    """BM25 weights of some documents: frequent terms as a matrix, the others as postings."""

    def __init__(self, corpus: Corpus, columns: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray) -> None:
        self.n, self.columns = len(terms), columns
        owner = np.repeat(np.arange(self.n), [t.size for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.float64)
        weight = corpus.weights(term, tf, lengths[owner].astype(np.float64))
        at = columns[term]
        dense = at >= 0
        self.matrix = np.zeros((self.n, columns.max(initial=-1) + 1), np.float32)
        self.matrix[owner[dense], at[dense]] = weight[dense]
        term, owner, weight = term[~dense], owner[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.owners, self.posted = owner[order], weight[order]
        self.counts = np.bincount(term, minlength=columns.size)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])

    def rare(self, terms: np.ndarray) -> np.ndarray:
        """The score of each document for the infrequent ones of some terms."""
        terms = terms[(self.columns[terms] < 0) & (self.counts[terms] > 0)]
        if not terms.size:
            return np.zeros(self.n, np.float32)
        at, counts = self.starts[terms], self.counts[terms]
        picked = np.arange(counts.sum()) + np.repeat(at - np.cumsum(counts) + counts, counts)
        return np.bincount(self.owners[picked], self.posted[picked], self.n).astype(np.float32)

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """The score of each document for each set of terms."""
        asked = np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        for i, terms in enumerate(queries):
            at = self.columns[terms]
            asked[i, at[at >= 0]] = 1
        return np.round(asked @ self.matrix.T + np.stack([self.rare(terms) for terms in queries]), 3)


class Shard:
    """The scores of a shard's documents for each of them: of frequent terms in one product, of the others when they are asked for.

    Without a corpus the statistics are the shard's own.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None) -> None:
        each = [counted(d) for d in docs]
        lengths = np.array([d.size for d in docs])
        self.terms = [t.astype(np.int64) for t, _ in each]
        corpus = corpus or Corpus(len(docs), lengths.mean(), np.bincount(np.concatenate(self.terms)))
        self.scored = _Scored(corpus, corpus.columns(), self.terms, [n for _, n in each], lengths)
        self.frequent = (self.scored.matrix > 0).astype(np.float32) @ self.scored.matrix.T

    def scores(self, seed: int) -> np.ndarray:
        """The score of each document for all terms of one."""
        return np.round(self.frequent[seed] + self.scored.rare(self.terms[seed]), 3)


@lru_cache(maxsize=1)
def _directions(n: int) -> np.ndarray:
    """A fixed random direction for each term."""
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (n, DIMENSIONS))


class Router:
    """A tree of two means over projected documents: inner nodes have two centres, leaves the mean of their documents."""

    def __init__(self, corpus: Corpus, sample: np.ndarray) -> None:
        self.corpus = corpus
        self.centres: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        self.means: list[np.ndarray] = []
        self._grow(sample)

    def _grow(self, rows: np.ndarray) -> int:
        """The number of a new node; leaves are negative, in their order."""
        if len(rows) > LEAF:
            a = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
            b = rows[np.argmax(((rows - a) ** 2).sum(1))]
            for _ in range(10):
                to_a = ((rows - a) ** 2).sum(1) <= ((rows - b) ** 2).sum(1)
                if to_a.all():
                    break
                a, b = rows[to_a].mean(0), rows[~to_a].mean(0)
            to_a = ((rows - a) ** 2).sum(1) <= ((rows - b) ** 2).sum(1)
            if to_a.any() and not to_a.all():
                node = len(self.centres)
                self.centres.append(np.stack([a, b]))
                self.children.append((0, 0))
                self.children[node] = (self._grow(rows[to_a]), self._grow(rows[~to_a]))
                return node
        self.means.append(rows.mean(0) if len(rows) else np.zeros(DIMENSIONS))
        return -len(self.means)

    def route(self, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each document and its place there: how far it lies in the direction of the leaf's mean."""
        leaf, stack = np.zeros(len(projected), np.int32), [(0 if self.centres else -1, np.arange(len(projected)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                leaf[rows] = -1 - node
            elif rows.size:
                a, b = self.centres[node]
                to_a = ((projected[rows] - a) ** 2).sum(1) <= ((projected[rows] - b) ** 2).sum(1)
                stack += [(self.children[node][0], rows[to_a]), (self.children[node][1], rows[~to_a])]
        return leaf, np.round(np.einsum("ij,ij->i", projected, np.stack(self.means)[leaf]), 6)


def _projected(corpus: Corpus, each: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray) -> np.ndarray:
    """Each document's BM25 weights, scaled to length one, in few dimensions."""
    out = np.zeros((len(each), DIMENSIONS), np.float32)
    for at in range(0, len(each), 128):
        some = each[at : at + 128]
        sizes = np.array([t.size for t, _ in some])
        terms = np.concatenate([t for t, _ in some]).astype(np.int64)
        weights = corpus.weights(terms, np.concatenate([n for _, n in some]), np.repeat(lengths[at : at + 128], sizes))
        firsts = np.cumsum(sizes) - sizes
        weights /= np.repeat(np.sqrt(np.add.reduceat(weights * weights, firsts)), sizes)
        out[at : at + 128] = np.add.reduceat(_directions(corpus.df.size)[terms] * weights[:, None].astype(np.float32), firsts)
    return out


_ROWS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.int32()), ("place", pa.float64()), ("hash", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("df", pa.list_(pa.int64()))])
_ROWS_DDL = "doc_id long, leaf int, place double, hash long, size long, ids binary, df array<long>"


def _encoded(df: DataFrame, vocabulary: str, end: int, router) -> DataFrame:
    """Each document (doc_id, text) with its ids and its route, if there is a router; the last row of a task has its document frequencies."""

    def run(batches):
        import xxhash

        coder, tail = encoder(vocabulary), np.array([end], np.uint32)
        total = np.zeros(max(coder.tokenizer.get_vocab_size(), end + 1), np.int64)
        kind = _kind(total.size)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                own = some.column(0).to_pylist()
                ids = [np.concatenate([x, tail]).astype(kind) for x in coder.ids(some.column(1).to_pylist())]
                each = [counted(x) for x in ids]
                total += np.bincount(np.concatenate([t for t, _ in each]), minlength=total.size)
                sizes = np.array([x.size for x in ids])
                if router is not None:
                    leaf, place = router.value.route(_projected(router.value.corpus, each, sizes))
                else:
                    leaf, place = np.zeros(len(ids), np.int32), np.zeros(len(ids))
                raw = [x.tobytes() for x in ids]
                hashes = [xxhash.xxh64_intdigest(x, d or 0) >> 1 for d, x in zip(own, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((own, leaf, place, hashes, sizes, raw, [None] * len(ids)), _ROWS, strict=True)], schema=_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, None, None, None, total), _ROWS, strict=True)], schema=_ROWS)

    return df.mapInArrow(run, _ROWS_DDL)


def _kind(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df, written with a strong compression (ids are most of it) and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(_ROWS_DDL).parquet(path)


def _corpus(rows: DataFrame) -> Corpus:
    """What BM25 needs of all documents, summed up from the tasks' frequencies; the vocabulary bounds its size."""
    n, total = rows.where("df is null").agg(F.count("*"), F.sum("size")).first()
    found = rows.where("df is not null").select(F.posexplode("df").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(found.num_rows, np.int64)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return Corpus(n, (total or 0) / max(n, 1), df)


def _fitted(docs: DataFrame, vocabulary: str, end: int) -> Router:
    """The routing, from about ROUTED documents: those with the least hashes."""
    n = docs.count()
    bound = ROUTED * (1 << 31) // max(n, ROUTED)
    rows = _stored(_encoded(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) < bound).limit(2 * ROUTED), vocabulary, end, None), "routed")
    corpus = _corpus(rows)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)  # a number for each id of the vocabulary
    kind = _kind(corpus.df.size)

    def project(batches):
        for batch in batches:
            ids = [np.frombuffer(x, kind) for x in batch.column(0).to_pylist()]
            found = _projected(shared.value, [counted(x) for x in ids], np.array([x.size for x in ids])) if ids else np.zeros((0, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(float).tolist(), pa.list_(pa.float64()))], names=["x"])

    found = rows.where("df is null").orderBy("hash", "doc_id").select("ids").mapInArrow(project, "x array<double>").toArrow()["x"].to_pylist()
    shared.destroy()
    return Router(corpus, np.array(found).reshape(-1, DIMENSIONS))


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack(df: DataFrame, vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of the sequences: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids (little-endian unsigned 32 bits)."""
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = _stored(_encoded(docs, vocabulary, end, sc.broadcast(_fitted(docs, vocabulary, end))), "ids")
    corpus = sc.broadcast(_corpus(rows))
    kind = _kind(corpus.value.df.size)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        left: list[tuple] = []
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def rows_of(sequences: list[list[tuple]]):
            """Pieces as ((doc_id, its ids), start, length)."""
            nonlocal number
            out = []
            for pieces in sequences:
                offset = 0
                for (d, ids), start, n in pieces:
                    out.append((d, start, n, ids.size, number, offset, ids[start : start + n].astype("<u4").tobytes()))
                    offset += n
                number += 1
            for at in range(0, len(out), 1024):
                columns = zip(*out[at : at + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        def shard():
            nonlocal left
            sequences, rest = fill_windows([ids for _, ids in held], window, corpus.value)
            left += [(held[d], start, n) for d, start, n in rest]
            yield from rows_of([[(held[d], start, n) for d, start, n in pieces] for pieces in sequences])
            if sum(n for *_, n in left) >= 64 * window:
                whole = cut_rest(left, window)
                while whole and sum(n for *_, n in whole[-1]) < window:
                    whole.pop()
                yield from rows_of(whole)
                left = _after(left, window * len(whole))

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((d, np.frombuffer(raw, kind)))
                size += len(raw) // held[-1][1].itemsize
                if len(held) >= SHARD_DOCS or size >= SHARD_IDS:
                    yield from shard()
                    held, size = [], 0
        if held:
            yield from shard()
        yield from rows_of(cut_rest(left, window))

    key = ["leaf", "place", "hash"]
    dealt = rows.where("df is null").select("doc_id", "ids", *key).repartitionByRange(*key).sortWithinPartitions(*key, "doc_id").select("doc_id", "ids")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _after(left: list[tuple], n: int) -> list[tuple]:
    """The pieces without their first n ids."""
    out = []
    for doc, start, length in left:
        m = min(n, length)
        n -= m
        if m < length:
            out.append((doc, start + m, length - m))
    return out


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))

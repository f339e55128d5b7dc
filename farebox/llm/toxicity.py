"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples: of the labelled documents whose crc32(doc_id as text) isn't divisible by 5, up to PER_CLASS of each class, in order of the
hash of their doc_id, of texts up to LONGEST characters. They are the only bounded sample; it fits the classifier.

Terms: runs of letters and digits, lower case; every term counts. Weights: sqrt(tf / words of the text) * idf * relevance, where idf counts
every document of the table, and relevance, from FLOOR to 1, grows with the root of the term's chi-square against the labels of the
examples. Terms that no example has match none; in the length of a text's vector they count with the idf of one document, and FLOOR.

Search: an inverted index in blocks of BLOCK examples, which are ordered by their heaviest terms so that a block's examples are alike. It
holds the largest weight of each term in each block. The bounds that these give for a text order the blocks, and a block is left
out only if its bound is below the K-th best cosine found, so the K nearest are exact. Votes weigh with the square of the cosine
and the share that the example's class has in all training labels. A logistic curve fitted to the votes of the examples themselves, each
left out of its own search, turns votes into probabilities. The neighbours are kept as evidence.

Edge cases: null and empty texts, and those without a term of any example, get the classes' shares as their vote; without usable labels every
score is 0; of several rows with one labelled doc_id the text with the least hash is the example; a doc_id with contradicting labels
counts as toxic; a null doc_id is never an example; very long texts are scored whole; a column of the input that has the name of the
output column is replaced, other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm.common import table
from farebox.llm.encode import encoder

PER_CLASS = 1024
LONGEST = 1 << 15
FLOOR = 0.01
K = 15
BLOCK = 32
_WORD = re.compile(r"[^\W_]+")
_SCORED = "struct<score:double,evidence:array<struct<example:bigint,toxic:int,cosine:double>>>"


def terms_of(text: str | None) -> Counter:
    """The terms of a text with how often they occur."""
    return Counter(_WORD.findall(text.lower()) if text else ())


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among sparse vectors of length one."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        # by their heaviest terms, so that blocks hold what is alike
        heaviest = [tuple(t[np.argsort(-w, kind="stable")[:3]].tolist()) for t, w in vectors]
        self.order = np.array(sorted(range(self.n), key=lambda i: (heaviest[i], i)), np.int64)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        owner = np.repeat(place, [t.size for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        order = np.lexsort((owner, term))
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        # one entry for each term and block that meet: its block, largest weight and postings
        key = term[order] * max(self.blocks, 1) + self.owner // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.empty(0, np.int64)
        self.block, self.most = (key[first] % max(self.blocks, 1)).astype(np.int32), np.maximum.reduceat(self.weight, first) if key.size else np.empty(0)
        self.firsts = np.concatenate([first, [key.size]])
        self.starts = np.searchsorted(key[first] // max(self.blocks, 1), np.arange(terms + 1))
        self.visited = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k vectors with the largest positive cosine and those that are as near as the k-th, best first, ties by their order."""
        entry, of = _ranges(self.starts[terms], self.starts[terms + 1])
        block, own = self.block[entry], weights[of]
        bounds = np.bincount(block, self.most[entry] * own, self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        scores, bar, at, step = np.zeros(self.n), 0.0, 0, 2
        while at < order.size:
            taken = order[at : at + step]
            taken = taken[bounds[taken] >= bar - 1e-9]
            if not taken.size:
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[taken] = True
            some = np.flatnonzero(chosen[block])
            picked, by = _ranges(self.firsts[entry[some]], self.firsts[entry[some] + 1])
            scores += np.bincount(self.owner[picked], self.weight[picked] * own[some][by], self.n)
            self.visited += taken.size
            at, step = at + step, 2 * step
            if self.n > k:
                seen = scores if without < 0 else np.where(self.order == without, 0.0, scores)
                bar = np.partition(seen, self.n - k)[self.n - k]
        if without >= 0:
            scores[self.order == without] = 0.0
        found = np.flatnonzero(scores >= max(bar - 1e-9, 1e-12))
        found = found[np.lexsort((self.order[found], -scores[found]))]
        return self.order[found], scores[found]


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, and the range of each."""
    sizes = end - first
    of = np.repeat(np.arange(sizes.size), sizes)
    return np.arange(of.size) + (first - np.cumsum(sizes) + sizes)[of], of


class Model:
    """What the scoring of a document needs; its size is bounded by the examples and their lengths."""

    def __init__(self, vocabulary: list[str], df: np.ndarray, documents: int, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: tuple[float, float]) -> None:
        """examples: their doc_id and label, the numbers of their terms in the vocabulary, and how often each occurs."""
        self.vocabulary = vocabulary
        self.names = [e[0] for e in examples]
        self.toxic = np.array([e[1] for e in examples], np.int64)
        own = np.bincount(self.toxic, minlength=2)[:2]
        self.share = np.array(share) / np.maximum(own, 1)
        self.prior = share[1] / max(sum(share), 1)
        met = np.zeros((2, len(vocabulary)))
        for _, toxic, terms, _ in examples:
            met[toxic, terms] += 1
        self.rate = _idf(df, documents) * np.maximum(FLOOR, _relevance(met, own))
        self.strange = float(_idf(np.ones(1), documents)[0]) * FLOOR
        vectors = [self.vector(terms, n) for _, _, terms, n in examples]
        self.index = BlockMaxIndex(vectors, len(vocabulary))
        votes = np.array([self.vote(*self.index.nearest(*v, K, without=i)) for i, v in enumerate(vectors)])
        self.curve = _logistic(votes, self.toxic, self.share[self.toxic] if examples else votes)

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that examples have and their weights, of a vector of length one over all terms; at: their numbers, -1 for those that none has."""
        tf = n / max(n.sum(), 1)
        known = at >= 0
        terms, weights = at[known], np.sqrt(tf[known]) * self.rate[at[known]]
        length = np.sqrt(weights @ weights + self.strange**2 * tf[~known].sum())
        return terms, weights / length if length else weights

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        if not found.size:
            return self.prior
        weight = cosine**2 * self.share[self.toxic[found]]
        return float(weight @ self.toxic[found] / weight.sum())

    def nearest(self, text: str | None, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        counts = terms_of(text)
        at = np.fromiter((ids.get(t, -1) for t in counts), np.int64, len(counts))
        return self.index.nearest(*self.vector(at, np.fromiter(counts.values(), np.int64, len(counts))), K)

    def score(self, found: np.ndarray, cosine: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.vote(found, cosine) + b))))


def _idf(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log((1 + documents) / (1 + df)) + 1


def _relevance(met: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The root of each term's chi-square against the labels, 1 for the largest. met: examples of class 0 and 1 with each term."""
    n, (b, a), (n0, n1) = own.sum(), met, own
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(n1 * n0 * (a + b) * (n - a - b), 1e-9)
    return np.sqrt(chi2 / max(chi2.max(initial=0), 1e-9))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float] | None:
    """Slope and intercept by Newton steps under a small penalty; None without both classes."""
    if not x.size or y.min() == y.max():
        return None
    design, beta, weight = np.stack([x - 0.5, np.ones_like(x)], 1), np.zeros(2), weight / weight.sum() * x.size
    for _ in range(200):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (y - p)) - np.array([0.05, 0.0]) * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.05, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] - beta[0] / 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model for docs (doc_id, text) from labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    first = known.where("toxic = 0").orderBy(order).limit(per_class).union(known.where("toxic = 1").orderBy(order).limit(per_class))
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).select("doc_id", "text")
    met = short.join(F.broadcast(first), "doc_id")  # 2 * per_class rows at most
    rows = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    # terms become numbers text by text: counters of all examples at once are most of what the driver would hold
    number: dict[str, int] = {}
    examples = []
    for r in sorted(rows, key=lambda r: r.doc_id):
        counts = terms_of(r.text)
        terms = np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int64, len(counts))
        examples.append((r.doc_id, r.toxic, terms, np.fromiter(counts.values(), np.int64, len(counts))))
    del rows
    if len({e[1] for e in examples}) < 2:
        return Model([], np.empty(0), 0, [], (0.0, 0.0))
    vocabulary = sorted(number)
    place = np.empty(len(vocabulary), np.int64)
    place[[number[t] for t in vocabulary]] = np.arange(len(vocabulary))
    examples = [(name, toxic, place[terms], n) for name, toxic, terms, n in examples]
    del number
    df, documents = _frequencies(docs, vocabulary)
    return Model(vocabulary, df, documents, examples, (share.get(0, 0), share.get(1, 0)))


def _frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        encoder.cache_clear()
        ids = {t: i for i, t in enumerate(shared.value)}
        df = np.zeros(len(ids) + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    found = [i for t in set(_WORD.findall(text.lower())) if (i := ids.get(t)) is not None]
                    df[found] += 1
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(df[terms])], names=["term", "n"])

    found = np.zeros(len(vocabulary) + 1, np.int64)
    got = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
    found[got["term"].to_numpy()] = got["n"].to_numpy()
    shared.destroy()
    return found[:-1], int(found[-1])


def _scorer(docs: DataFrame, labels: DataFrame, text: str, per_class: int, evidence: bool):
    """A function from an array of texts to scores, or to structs of score and evidence."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", F.col(text).alias("text")), labels, per_class))
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("example", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))])

    def scored(batches):
        encoder.cache_clear()  # of a stage before: this worker may live on
        m = model.value
        ids = {t: i for i, t in enumerate(m.vocabulary)}
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 256):
                out = []
                for t in texts.slice(at, 256):
                    if m.curve is None:
                        found, cosine, score = np.empty(0, np.int64), np.empty(0), 0.0
                    else:
                        found, cosine = m.nearest(t.as_py(), ids)
                        score = m.score(found, cosine)
                    if evidence:
                        near = [{"example": m.names[i], "toxic": int(m.toxic[i]), "cosine": float(c)} for i, c in zip(found[:K], cosine[:K], strict=True)]
                        out.append({"score": score, "evidence": near})
                    else:
                        out.append(score)
                parts.append(pa.array(out, kind if evidence else pa.float64()))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind if evidence else pa.float64())

    return scored


def score(docs: DataFrame, labels: DataFrame, text: str = "text", out: str = "toxicity", per_class: int = PER_CLASS) -> DataFrame:
    """docs with a struct (score, evidence); evidence: the nearest examples with label and cosine."""
    scored = _scorer(docs, labels, text, per_class, True)
    return docs.withColumn(out, F.arrow_udf(scored, _SCORED, F.ArrowUDFType.SCALAR_ITER)(F.col(text)))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose score is below 0.5, with their columns as they are."""
    return docs.where(F.arrow_udf(_scorer(docs, labels, text, PER_CLASS, False), "double", F.ArrowUDFType.SCALAR_ITER)(F.col(text)) < 0.5)


def op7_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, table(spark, sf_dir, "labels"))
    evidence = F.concat_ws(",", F.transform("toxicity.evidence", lambda e: F.concat_ws(":", e.example.cast("string"), e.toxic.cast("string"))))
    return found.select("doc_id", held_out().alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), evidence.alias("evidence"))

"""Near duplicates: SimHash fingerprints linked through Golay-code keys.

Fingerprint: lower-case A-Z, words are runs of anything but [\\x20\\x09-\\x0D], shingles are three words joined by a
space, repeats included (fewer words: the whole sequence). A bit is 1 if it is set in over half of the shingles'
XXH64 hashes (seed 42). A text without words, or a null one, has fingerprint 0 and is linked like any other.

Links: fingerprints that differ in at most two of the 64 bits. The 64 bits are three segments of 21, 21 and 22.
Two errors leave one segment whole (pigeonhole), and any other segment has two errors at most. The binary Golay
code of 23 bits is perfect with distance 7: a word lies within distance 4 of one codeword, or of six if the nearest
is at distance 3, and two words that differ in at most two bits always have one of these codewords in common. So a
key is (segment, its exact bits, index of a nearby codeword of the next segment), at most 18 for each distinct
fingerprint, and linked fingerprints meet in one key. Candidates of a key are verified by their distance.

Skew: equal fingerprints are one node, joined before anything is paired. A key with over PAIRED fingerprints isn't
paired at all: its fingerprints go the exact way of their balls of radius one (65 words each), since two words
differ in at most two bits just if these balls meet. Rows grow with the fingerprints, never with their pairs.

With a similarity, near_duplicates and keep_one verify the pairs that fingerprints link, and add others: links are then pairs of texts whose sets of
shingles (of any width) have an exact Jaccard similarity of at least that. Fingerprints alone don't find them all: texts as near as 0.8 differ in some 10
bits of 64, and segments with so many errors have no codeword in common but by keys so short that all texts meet. So further candidates share
one of BANDS keys of ROWS minimal hashes each (a pair at 0.8 shares none with a probability of 7 in 100,000, at 0.9 below one in 10 ** 9), and
every candidate, of either kind, is verified on the whole sets. Keys of up to PAIRED sets pair all of theirs. In a larger one, such as of a text with thousands of near copies,
each set is compared with one centre, the set that meets most others. Between the components that this leaves, candidates are those members of
large keys that share one of their rarest shingles (a prefix of |x| - ceil(similarity |x|) + 1 in one order of all, from the rarest on), which
similar sets always do; so work grows with the members and not with their pairs, and nothing is lost.

Edge cases: repeated rows and equal texts have one fingerprint and one component; a null doc_id takes part, and is
never the smallest one unless all of a component are null; very long texts are hashed whole; texts without words have one set; other
columns stay as they are; an empty table gives an empty result.

Texts move once, when their rows are dealt by number; what is asked of them later (the texts of candidates, the rows that stay) comes to where they are.

The driver's memory grows with the exchanges of a plan, which Spark plans anew after each of them: so what a step gathers from several joins is
written join by join.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.llm.common import dealt, delete, noted, table, written
from farebox.llm.graph import connected_components

#: Keys with more fingerprints than this take the linear way.
PAIRED = 64
#: Parities that stand for a set of shingles where candidates are sifted.
BITS = 512
#: Numbers of the table of frequencies, and blocks in which it is summed up.
CELLS, CELL_BLOCKS = 1 << 20, 256
#: Keys of a set of shingles, and the minimal hashes in each.
BANDS, ROWS = 24, 5
#: Pairs that one copy of a text meets in one task.
MET = 64
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_STEP = 1 << 14


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < 3:
        starts, ends = [0], None
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        after = np.cumsum(sizes + 1)
        starts, ends = (after - sizes - 1)[:-2].tolist(), (after - 1)[2:].tolist()
    line = b" ".join(words)
    ends = ends or [len(line)]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _STEP):
        h = np.array([hashed(line[a:b], 42) for a, b in zip(starts[i : i + _STEP], ends[i : i + _STEP], strict=True)], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


@lru_cache(maxsize=1)
def nearby_errors() -> np.ndarray:
    """For each syndrome of the Golay code the errors of weight up to 4 that have it, as a 2048 x 6 table.

    A syndrome has one error of weight up to 3; if that one has weight 3, five of weight 4 besides. Others repeat theirs.
    """
    from itertools import combinations

    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    one = []
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= generator << (k - 11)
        one.append(r)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for b in at:
                s ^= one[b]
            if weight < 4 or len(found[s]) and bin(found[s][0]).count("1") == 3:
                found[s].append(sum(1 << b for b in at))
    return np.array([x + x[:1] * (6 - len(x)) for x in found], np.int64)


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of the low 12 and of the high 11 bits."""
    generator = 0b110001110101
    out = []
    for shift, n in ((0, 12), (12, 11)):
        r = np.arange(1 << n, dtype=np.int64) << shift
        for k in range(22, 10, -1):
            r = np.where(r >> k & 1, r ^ (generator << (k - 11)), r)
        out.append(r)
    return tuple(out)


def codewords(words: np.ndarray) -> np.ndarray:
    """The indices (12 bits) of the codewords near each 23-bit word, six columns with repeats."""
    low, high = _syndromes()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ nearby_errors()[s]) >> 11


def keys_of(prints: np.ndarray) -> np.ndarray:
    """18 keys of each fingerprint, with repeats."""
    u = prints.astype(np.int64).view(np.uint64)
    parts = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    return np.hstack([(p << 40) | (parts[p][:, None] << 12) | codewords(parts[(p + 1) % 3]) for p in range(3)])


def _keys(prints: pa.Array) -> pa.Array:
    k = np.sort(keys_of(prints.to_numpy(zero_copy_only=False)), axis=1)
    new = np.ones(k.shape, bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    offsets = np.concatenate([[0], np.cumsum(new.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(k[new], pa.int64()))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    return df.withColumn(out, F.arrow_udf(_fingerprints, "long")(F.col(text)))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect just the fingerprints (column fp, distinct) which a path of links connects."""
    keyed = written(prints.select("fp", F.explode(F.arrow_udf(_keys, "array<long>")("fp")).alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(sizes, "key"), "shared")
    small = met.where(F.col("n") <= PAIRED).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("u")).join(small.select("key", F.col("fp").alias("v")), "key")
    pairs = pairs.where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    hot = met.where(F.col("n") > PAIRED).select("fp").distinct()
    ball = [F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64))]
    balls = hot.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(x) for x in ball))).alias("word"))
    centres = balls.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(centres, "word").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, in order; words as in the fingerprint."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set of hashes; sets of one similarity share each key with its ROWS-th power as probability."""
    import xxhash

    if not hashes.size:
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, hashes.size, 2048):
        least = np.minimum(least, (hashes[at : at + 2048].view(np.uint64)[:, None] * _multipliers()).min(axis=0))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) - (1 << 63) for k in range(BANDS)]


def with_bands(df: DataFrame, width: int, text: str = "text", out: str = "set") -> DataFrame:
    """df with a struct of the set of shingles: fp, its hash, n, its size, and its keys; and print, the text's fingerprint."""

    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        rows = []
        for t in texts:
            x = shingles(t.as_py(), width)
            rows.append({"fp": xxhash.xxh64_intdigest(x.tobytes(), 42) - (1 << 63), "n": x.size, "keys": bands(x), "print": fingerprint(t.as_py())})
        return pa.array(rows, pa.struct([("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("print", pa.int64())]))

    return df.withColumn(out, F.arrow_udf(run, "struct<fp:bigint,n:bigint,keys:array<bigint>,print:bigint>")(F.col(text)))


def _printed(docs: DataFrame) -> DataFrame:
    """Candidates (u, v) among the sets of docs (fp, print): the sets of one fingerprint with the least of them, and the least sets of linked fingerprints."""
    sets = written(docs.select("fp", "print").distinct(), "prints")
    least = written(sets.groupBy("print").agg(F.min("fp").alias("least")), "least")
    same = sets.join(least, "print").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    end = lambda x, y: least.select(F.col("print").alias(x), F.col("least").alias(y))
    linked = written(links(least.select(F.col("print").alias("fp"))), "linked").join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    return same.union(linked).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) that are similar enough; texts: fp and text. A text that many pairs meet goes out in several copies."""
    asked = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).groupBy("fp").agg(F.count("*").alias("n"))
    own = texts.join(asked, "fp")
    copies = own.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / MET))))

    def side(found: DataFrame, x: str) -> DataFrame:
        dealt = found.join(asked.select(F.col("fp").alias(x), F.floor(F.col("n") / MET).alias("more")), x)
        dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("u", "v"), F.col("more") + 1)).drop("more")
        return dealt.join(copies.select(F.col("fp").alias(x), "copy", F.col("text").alias(f"text_{x}")), [x, "copy"]).drop("copy")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(a, b, strict=True):
            x, y = shingles(s.as_py(), width), shingles(t.as_py(), width)
            both = np.intersect1d(x, y, assume_unique=True).size
            out.append(both >= (x.size + y.size - both) * similarity - 1e-9)
        return pa.array(out, pa.bool_())

    return side(side(pairs, "u"), "v").where(F.arrow_udf(run, "boolean")("text_u", "text_v")).select("u", "v")


def _near(similarity: float) -> Column:
    return (F.col("n_u") >= F.col("n_v") * similarity - 1e-9) & (F.col("n_v") >= F.col("n_u") * similarity - 1e-9)


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles occur in texts, by the last bits of their hash: at least their number, and exact for those that share theirs with no other.

    A task adds its shingles up in one table, and gives a row for each block of it that isn't empty; blocks are summed up block by block. The table
    has CELLS numbers whatever the input, so it may come to the driver and go to every task.
    """
    size = CELLS // CELL_BLOCKS

    def counted(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(cells, shingles(t.as_py(), width) & (CELLS - 1), 1)
        some = np.flatnonzero(cells.reshape(CELL_BLOCKS, size).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([cells[i * size : (i + 1) * size].tobytes() for i in some], pa.binary())], names=["block", "cells"])

    def summed(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in rows.column("cells").to_pylist())
        return pa.table({"block": rows.column("block").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((CELL_BLOCKS, size), np.int64)
    for r in texts.select("text").mapInArrow(counted, "block long, cells binary").groupBy("block").applyInArrow(summed, "block long, cells binary").collect():
        out[r.block] = np.frombuffer(bytes(r.cells), np.int64)
    return np.minimum(out.ravel(), (1 << 32) - 1).astype(np.uint32)


def _across(members: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Candidates (u, v) between different components: members (fp, n, root) that share a shingle of their prefixes.

    A prefix is the rarest shingles of a set, so many that two similar sets share one. What order they are in doesn't matter, as long as it is one for
    all; by their frequencies few sets meet. So only prefixes become rows.
    """
    own = texts.join(members, "fp")
    frequency = _frequencies(own, width)

    def run(found: pa.Array) -> pa.Array:
        out = []
        for t in found:
            x = shingles(t.as_py(), width)
            often = frequency[x & (CELLS - 1)]
            order = np.lexsort((x, often))[: x.size - int(np.ceil(x.size * similarity - 1e-9)) + 1]
            met = order[often[order] > 1]
            parity = np.bincount(x & (BITS - 1), minlength=BITS).astype(np.uint8) & 1
            turn = (np.flatnonzero(often[order] > 1) + 1).tolist()
            out.append({"bits": np.packbits(parity).view(np.int64).tolist(), "prefix": [{"h": h, "turn": i} for h, i in zip(x[met].tolist(), turn, strict=True)]})
        return pa.array(out, pa.struct([("bits", pa.list_(pa.int64())), ("prefix", pa.list_(pa.struct([("h", pa.int64()), ("turn", pa.int64())])))]))

    told = F.arrow_udf(run, "struct<bits:array<bigint>,prefix:array<struct<h:bigint,turn:bigint>>>")("text")
    each = own.select("fp", "n", "root", told.alias("x")).select("fp", "n", "root", "x.bits", F.explode("x.prefix").alias("p"))
    prefix = written(each.select("fp", "n", "root", "p.h", "p.turn", "bits"), "prefixes")
    # a shingle's most frequent component only meets the others, not itself
    shared = prefix.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", "c").alias("top"), F.count("*").alias("roots")).where("roots > 1")
    u = prefix.join(shared, "h").where("root <> top").select("h", *(F.col(c).alias(f"{x}_u" if x else "u") for c, x in (("fp", ""), ("n", "n"), ("root", "root"), ("turn", "turn"), ("bits", "bits"))))
    v = prefix.select("h", *(F.col(c).alias(f"{x}_v" if x else "v") for c, x in (("fp", ""), ("n", "n"), ("root", "root"), ("turn", "turn"), ("bits", "bits"))))
    # what follows the first shingle that two sets share has to hold the rest of what they need in common
    most = 1 + F.least(F.col("n_u") - F.col("turn_u"), F.col("n_v") - F.col("turn_v"))
    enough = most >= (F.col("n_u") + F.col("n_v")) * (similarity / (1 + similarity)) - 1e-9
    # a set as BITS parities: sets that differ in x shingles differ in x of them at most
    apart = sum((F.bit_count(F.col("bits_u")[i].bitwiseXOR(F.col("bits_v")[i])) for i in range(BITS // 64)), F.lit(0))
    alike = apart <= (F.col("n_u") + F.col("n_v")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    met = u.join(v, "h").where(_near(similarity) & enough & alike & (F.col("root_u") != F.col("root_v")))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect just the sets which links connect, written. docs: fp, n, keys, print, text and row, a number by which they are dealt."""
    scratch: list[str] = []
    with noted(scratch):
        found = _similar(docs, width, similarity)
    edges = written(found, "links")
    delete(docs.sparkSession, scratch)
    return edges


def _similar(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    sets = docs.groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    keyed = written(sets.select("fp", "n", F.explode("keys").alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    met = written(keyed.join(sizes, "key"), "met")
    small, large = met.where(F.col("met") <= PAIRED), met.where(F.col("met") > PAIRED)
    u, v = (small.select("key", F.col("fp").alias(x), F.col("n").alias(f"n_{x}")) for x in "uv")
    pairs = written(u.join(v, "key").where(_near(similarity) & (F.col("u") < F.col("v"))).select("u", "v").distinct(), "pairs")
    members = written(large.groupBy("fp").agg(F.any_value("n").alias("n"), F.sum("met").alias("meets")), "large")
    placed = large.select("key", "fp").join(members, "fp")
    centres = placed.groupBy("key").agg(F.max_by("fp", F.struct("meets", "fp")).alias("v"))
    stars = written(placed.join(centres, "key").where("fp <> v").select(F.least("fp", "v").alias("u"), F.greatest("fp", "v").alias("v")).distinct(), "stars")
    printed = written(_printed(docs), "printed")
    candidates = written(pairs.union(stars).union(printed).distinct(), "candidates")
    wanted = candidates.select(F.col("u").alias("fp")).union(candidates.select("v")).union(members.select("fp")).distinct()
    # one row of each set that is asked for: texts stay in the buckets of their rows
    places = written(docs.groupBy("fp").agg(F.min("row").alias("row")).join(wanted, "fp").select("row"), "places")
    texts = written(docs.select("row", "fp", "text").join(places, "row", "left_semi").select("fp", "text"), "texts")
    edges = written(_verified(candidates, texts, width, similarity), "similar")
    if members.isEmpty():
        return edges
    roots = connected_components(edges)
    rooted = members.join(roots, members.fp == roots.node, "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    across = written(_across(rooted, texts, width, similarity), "across")
    # a component stands for its edges from here on
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(_verified(across, texts, width, similarity))


def _components(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """docs (doc_id, fp) with root, the least fp that edges reach, and component_id, the smallest doc_id there."""
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(edges)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(placed.select("fp", "root").join(least, "root"), "fp")


def _linked(df: DataFrame, doc_id: str, text: str, width: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """The rows of df (row, a number; all, their columns; doc_id; fp), written, and the edges between fps."""
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("all"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    in_all = F.col("all")[text].alias("text")  # written once
    if similarity is None:
        if width != 3:
            raise ValueError("fingerprints are of three-word shingles; another width needs a similarity")
        rows = written(with_fingerprint(rows).drop("text").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
        return rows, links(rows.select("fp").distinct())
    if not 0 < similarity <= 1 or width < 1:
        raise ValueError("similarity is over 0 and at most 1, width at least 1")
    found = with_bands(rows, width).select("all", "doc_id", "set.*").withColumn("row", F.monotonically_increasing_id())
    rows = dealt(found, "shingles", "row")
    return rows, similar(rows.select("fp", "n", "keys", "print", "row", in_all), width, similarity)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row of df; component_id: the smallest doc_id that links reach, its own included.

    Without a similarity, fingerprints (of three-word shingles) are linked; with one, sets of shingles of width words that are as similar,
    and fp is the set's hash.
    """
    rows, edges = _linked(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", width, similarity)
    return _components(rows.select("doc_id", "fp"), edges).select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component, that with the smallest doc_id (nulls last; ties: the least fp, then the first row). width and similarity as in
    near_duplicates."""
    rows, edges = _linked(df, doc_id, text, width, similarity)
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")).alias("first"))
    roots = connected_components(edges)
    placed = least.join(roots, least.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = written(placed.select("first.row"), "kept")
    return rows.join(kept, "row", "left_semi").select("all.*")


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Collocations: phrases of two to four words whose parts seldom stand apart, language by language.

Words: a task counts the words of its texts in one table and passes on a row for each; their sums give the dictionary of the frequent
words, numbered by language and word. A phrase is as frequent as LEAST only if its words are, so every other word breaks a piece as the marks do.

Ids: texts become rows of ids with 0 for each break. A dictionary of up to HELD words goes to every task; a larger one is joined, on a row for
each word and window of text, so that no task holds it.

Keys: each place gives one key, the ids of the window of four words that starts there, packed into the fewest bits and followed by zeros after a
break. Keys of a task are sorted by radix, equal ones become one with a count, and each range of keys becomes one block of digit planes. The
ranges follow a sample of keys, which only decides where they end: about RANGE places each, so a range is what one task can sort, however many
there are. Merged and sorted again, the runs of a key's first two, three and four ids are the occurrences of those phrases. A run at the
edge of its range may go on in the next one; such runs are passed on whatever their count, and summed up.

Scores and embedded phrases are joins on the ids. All products are decimals of 38 digits. The best of a language are ranked in SALTS shares of it
first, with all ties, and only these are spelt out.

Edge cases: a null text is empty, a null language is `und`; texts are read whole, in windows of whole texts; repeated rows count each; ties of
score and count go by the bytes of the phrase; no phrase, or an empty table: an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.llm.common import new_path, table, text_or_empty, written
from farebox.operators.ordinals import numbered

LEAST = 30
LONGEST = 4
TOP = 2000
#: Words of a dictionary, and its bytes, that go to every task; a larger one is joined.
HELD, HELD_BYTES = 1 << 20, 1 << 26
#: Bytes of text that are taken apart at once; ids that are sorted at once; entries of a task's table of words.
WINDOW, BATCH, TABLE = 1 << 21, 1 << 20, 1 << 19
#: Places of a range, and keys that are sampled for each.
RANGE, SAMPLED = 1 << 21, 64
SALTS = 64
#: A piece ends at . , ; : ! ? and at 0A to 0D; a word at a blank or tab as well.
_BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
_WORD = ~_BREAK & ~np.isin(np.arange(256), [9, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IDS = ["w1", "w2", "w3", "w4"]


# Words


def _windows(batch: pa.RecordBatch):
    """For windows of the (lang, text) of a batch: distinct words, the place of each word among them, each word's language, which words start a piece."""
    texts = batch.column(1).cast(pa.large_string())
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    langs = batch.column(0).dictionary_encode()
    names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    data, k = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8), 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + WINDOW, "right")) - 1)
        own, part = ends[k : stop + 1] - ends[k], _LOWER[data[int(ends[k]) : int(ends[stop])]]
        is_word = _WORD[part]
        before, after = np.zeros_like(is_word), np.zeros_like(is_word)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        before[own[own < part.size]] = False
        after[own[own > 0] - 1] = False
        first, last = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        if first.size:
            marks, text = np.cumsum(_BREAK[part])[first], np.searchsorted(own, first, "right") - 1
            starts = np.concatenate([[True], (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])])
            places = np.stack([first, last], 1).ravel().astype(np.int64)
            spans = pa.LargeStringArray.from_buffers(places.size - 1, pa.py_buffer(places), pa.py_buffer(part))
            found = spans.take(pa.array(np.arange(0, places.size - 1, 2))).dictionary_encode()
            yield found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64), names, lang[k + text].astype(np.int64), starts
        k = stop


def _read(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n) of all words, and a row with a null word for each language's total."""

    def rows(counts):
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    def counted(batches):
        counts: dict = {}
        for batch in batches:
            for words, at, names, lang, _ in _windows(batch):
                keys, n = np.unique(lang * len(words) + at, return_counts=True)
                for key, x in zip(keys.tolist(), n.tolist(), strict=True):
                    entry = names[key // len(words)], words[key % len(words)]
                    counts[entry] = counts.get(entry, 0) + x
                for code, x in zip(*(u.tolist() for u in np.unique(lang, return_counts=True)), strict=True):
                    counts[names[code], None] = counts.get((names[code], None), 0) + x
                if len(counts) > TABLE:
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)

    return _read(docs, lang, text).mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# Ids


def _laid_out(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Ids with a 0 before each piece."""
    out = np.zeros(ids.size + int(starts.sum()), np.uint32)
    out[np.arange(ids.size) + np.cumsum(starts)] = ids
    return out.tobytes()


@lru_cache(maxsize=1)
def _held(shared) -> dict:
    found: dict = {}
    with pa.ipc.open_stream(shared.value) as stream:
        for batch in stream:
            for lang, word, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(lang, {})[word] = i
    return found


def _encoded_with(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    rows, sink = dictionary.select("lang", "word", "id").toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def encoded(batches):
        for batch in batches:
            for words, at, names, lang, starts in _windows(batch):
                keys, back = np.unique(lang * len(words) + at, return_inverse=True)
                ids = np.zeros(keys.size, np.uint32)
                for code, name in enumerate(names):
                    own = np.flatnonzero(keys // len(words) == code)
                    get = _held(shared).get(name, {}).get
                    ids[own] = [get(words[k], 0) for k in (keys[own] % len(words)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([_laid_out(ids[back], starts)], pa.binary())], names=["ids"])

    return docs.mapInArrow(encoded, "ids binary")


def _encoded_by_join(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same rows with the dictionary joined: a row for each word of a window with its places, put together again by window."""

    def spelt(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for words, at, names, lang, starts in _windows(batch):
                keys, back, n = np.unique(lang * len(words) + at, return_inverse=True, return_counts=True)
                places = np.split(np.argsort(back, kind="stable").astype(np.uint32), np.cumsum(n)[:-1])
                told = [names[k // len(words)] for k in keys.tolist()], [words[k % len(words)] for k in keys.tolist()]
                blobs = [p.tobytes() for p in places] + [starts.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(blobs)), pa.array([*told[0], None], pa.string()), pa.array([*told[1], None], pa.string()), pa.array(blobs, pa.binary())], names=["chunk", "lang", "word", "places"])
                chunk += 1

    def joined(rows: pa.Table) -> pa.Table:
        ids, starts = [], np.empty(0, bool)
        for i, places in zip(rows.column("id").to_pylist(), rows.column("places").to_pylist(), strict=True):
            if i is None:
                starts = np.frombuffer(places, bool)
            else:
                ids.append((i, places))
        out = np.zeros(starts.size, np.uint32)
        for i, places in ids:
            out[np.frombuffer(places, np.uint32)] = i
        return pa.table({"ids": pa.array([_laid_out(out, starts)], pa.binary())})

    rows = docs.mapInArrow(spelt, "chunk long, lang string, word string, places binary")
    met = rows.join(dictionary.select("lang", "word", "id"), ["lang", "word"], "left").where("id is not null or word is null")
    return met.select("chunk", "id", "places").groupBy("chunk").applyInArrow(joined, "ids binary")


# Keys


def _keys(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each place with a word, as its high and low 64 bits."""
    at = np.flatnonzero(ids)
    padded = np.concatenate([ids, np.zeros(LONGEST - 1, np.uint32)])
    each = [padded[at].astype(np.uint64)]
    for k in range(1, LONGEST):
        each.append(np.where(each[-1] > 0, padded[at + k], 0).astype(np.uint64))
    two = np.uint64(2 * bits)
    left, right = each[0] << np.uint64(bits) | each[1], each[2] << np.uint64(bits) | each[3]
    return left >> (np.uint64(64) - two), left << two | right


def _unpacked(high: np.ndarray, low: np.ndarray, bits: int) -> list[np.ndarray]:
    two, one = np.uint64(2 * bits), np.uint64(bits)
    left, right = high << (np.uint64(64) - two) | low >> two, low & np.uint64((1 << 2 * bits) - 1)
    mask = np.uint64((1 << bits) - 1)
    return [left >> one & mask, left & mask, right >> one & mask, right & mask]


def _digits(high: np.ndarray, low: np.ndarray, bits: int) -> list[np.ndarray]:
    """The key's digits of 16 bits, most significant first; as many as a key needs."""
    n = -(-LONGEST * bits // 16)
    return [((low if d < 4 else high) >> np.uint64(16 * (d % 4))).astype(np.uint16) for d in range(n - 1, -1, -1)]


def _whole(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    high, low = np.zeros(digits[0].size, np.uint64), np.zeros(digits[0].size, np.uint64)
    for d, digit in enumerate(reversed(digits)):
        if d < 4:
            low |= digit.astype(np.uint64) << np.uint64(16 * d)
        else:
            high |= digit.astype(np.uint64) << np.uint64(16 * (d - 4))
    return high, low


def _radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The order of keys by their digits, least significant first; numpy sorts 16 bits stably by radix."""
    order = np.argsort(digits[-1], kind="stable")
    for digit in digits[-2::-1]:
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def _run_lengths(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts (None: 1 each)."""
    order = _radix_order(_digits(high, low, bits))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    n = np.diff(np.append(first, high.size)) if counts is None else np.add.reduceat(counts[order], first)
    return high[first], low[first], n


def _bytes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys as bytes that compare as the keys do."""
    return np.stack([high, low], 1).astype(">u8").view("S16").ravel()


def _splits(encoded: DataFrame, places: int, bits: int) -> np.ndarray:
    """Where ranges of about RANGE places start, from a sample of keys at even distances."""
    stride = max(1, RANGE // SAMPLED)

    def sampled(batches):
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), np.uint32)
                high, low = _keys(ids, bits)
                at = slice((ids.size + int(low[:1].sum()) * 7919) % stride, None, stride)
                yield pa.RecordBatch.from_arrays([pa.array(_bytes(high[at], low[at]).tolist(), pa.binary())], names=["key"])

    if places <= RANGE:
        return np.empty(0, "S16")
    keys = numbered(encoded.mapInArrow(sampled, "key binary"), "key").where(F.col("ordinal") % SAMPLED == SAMPLED - 1).select("key").distinct().collect()
    return np.array(sorted(bytes(r.key) for r in keys), "S16")


def _blocks(encoded: DataFrame, splits: np.ndarray, bits: int) -> DataFrame:
    """(range, block): the distinct keys of a task in each range with their counts, compressed."""

    def blocks(held):
        high, low, n = _run_lengths(*map(np.concatenate, zip(*held, strict=True)), None, bits)
        ends = np.concatenate([[0], np.searchsorted(_bytes(high, low), splits), [high.size]])
        some = np.flatnonzero(np.diff(ends))
        planes = [*_digits(high, low, bits), n.astype(np.uint32)]
        out = []
        for r in some.tolist():
            own = slice(ends[r], ends[r + 1])
            raw = b"".join(p[own].tobytes() for p in planes)
            out.append(int(ends[r + 1] - ends[r]).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(out, pa.binary())], names=["range", "block"])

    def dealt(batches):
        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0):
                held.append(_keys(np.frombuffer(raw.as_buffer(), np.uint32), bits))
                size += held[-1][0].size
                if size >= BATCH:
                    yield blocks(held)
                    held, size = [], 0
        if size:
            yield blocks(held)

    return encoded.mapInArrow(dealt, "range long, block binary")


def _phrases(blocks: DataFrame, bits: int, least: int) -> DataFrame:
    """(w1 to w4, f) of the phrases of two to four words with least occurrences."""
    digits = -(-LONGEST * bits // 16)

    def merged(rows: pa.Table) -> pa.Table:
        keys, counts = [], []
        for block in rows.column("block").to_pylist():
            n = int.from_bytes(block[:4], "little")
            raw = pa.decompress(block[4:], n * (2 * digits + 4), "zstd", asbytes=True)
            keys.append(_whole([np.frombuffer(raw, np.uint16, n, 2 * n * d) for d in range(digits)]))
            counts.append(np.frombuffer(raw, np.uint32, n, 2 * n * digits).astype(np.int64))
        high, low, n = _run_lengths(*map(np.concatenate, zip(*keys, strict=True)), np.concatenate(counts), bits)
        ids, out = _unpacked(high, low, bits), []
        new = np.zeros(high.size, bool)
        new[0] = True
        new[1:] = ids[0][1:] != ids[0][:-1]
        for k in range(1, LONGEST):
            new[1:] |= ids[k][1:] != ids[k][:-1]
            first = np.flatnonzero(new)
            f = np.add.reduceat(n, first)
            edge = np.zeros(first.size, bool)
            edge[[0, -1]] = True
            at = np.flatnonzero((ids[k][first] > 0) & ((f >= least) | edge))
            out.append([*(ids[j][first[at]] if j <= k else np.zeros(at.size, np.uint64) for j in range(LONGEST)), f[at]])
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table(dict(zip([*_IDS, "f"], columns, strict=True)))

    runs = blocks.groupBy("range").applyInArrow(merged, ", ".join(f"{c} long" for c in [*_IDS, "f"]))
    return runs.groupBy(*_IDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


# Scores


def _part(first: int, last: int):
    """The ids of the words from first to last, as a struct of four."""
    return F.struct(*((F.col(_IDS[first + j]) if first + j <= last else F.lit(0).cast("long")).alias(_IDS[j]) for j in range(LONGEST)))


def _times(factor: int, c: str):
    return F.lit(factor).cast("decimal(10,0)") * F.col(c).cast("decimal(19,0)")


def _scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates with l, r and score of their lowest cut."""
    length = sum((F.col(c) > 0).cast("int") for c in _IDS)
    cuts = [F.when(length == n, F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _part(*span).alias("part")) for k in range(1, n) for side, span in (("l", (0, k - 1)), ("r", (k, n - 1)))))) for n in range(2, LONGEST + 1)]
    asked = candidates.select(*_IDS, "f", F.explode(F.coalesce(*cuts)).alias("c")).select(F.struct(*_IDS).alias("phrase"), "f", "c.k", "c.side", "c.part.*")
    met = asked.join(known.withColumnRenamed("f", "of_part"), _IDS)
    sides = met.groupBy("phrase", "k").agg(F.first("f").alias("f"), F.max(F.when(F.col("side") == "l", F.col("of_part"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("of_part"))).alias("r"))
    whole = F.expr("(cast(2000000 as decimal(10,0)) * cast(f as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cut = sides.withColumn("score", whole)
    return cut.groupBy("phrase").agg(F.first("f").alias("f"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("phrase.*", "f", "c.score", "c.l", "c.r")


def _standing_alone(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """The scored candidates that no longer candidate with 80 % of their occurrences holds."""
    length = sum((F.col(c) > 0).cast("int") for c in _IDS)
    inner = [F.when(length == n, F.array(*(_part(i, i + m - 1) for m in range(2, n) for i in range(n - m + 1)))) for n in range(3, LONGEST + 1)]
    holding = candidates.where("w3 > 0").select(F.explode(F.coalesce(*inner)).alias("p"), F.col("f").alias("longer")).select("p.*", "longer")
    most = holding.groupBy(*_IDS).agg(F.max("longer").alias("longer"))
    return scored.join(most, _IDS, "left").where(F.col("longer").isNull() | (_times(100, "longer") < _times(80, "f"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, held: int = HELD, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the top phrases of each language."""
    counts = written(word_counts(docs, lang, text).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    dictionary = written(numbered(counts.where("word is not null"), "lang", "word", name="id", first=1), "dictionary")
    size = dictionary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + 16), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("places")).first()
    bits = max(1, int(size.n).bit_length())
    if bits > 31:
        raise ValueError("a dictionary of more than 31 bits")
    encode = _encoded_with if size.n <= held and size.bytes <= HELD_BYTES else _encoded_by_join
    path = new_path(docs.sparkSession, "ids")
    encode(_read(docs, lang, text), dictionary).write.option("compression", "zstd").parquet(path)
    encoded = docs.sparkSession.read.schema("ids binary").parquet(path)
    candidates = written(_phrases(_blocks(encoded, _splits(encoded, size.places, bits), bits), bits, least), "phrases")
    none = F.lit(0).cast("long")
    single = dictionary.select(F.col("id").cast("long").alias("w1"), none.alias("w2"), none.alias("w3"), none.alias("w4"), F.col("n").alias("f"))
    kept = written(_standing_alone(candidates, _scored(candidates, candidates.unionByName(single))), "kept")

    # ids are numbered by language, so a phrase's first id tells its language; one row for each language
    spans = dictionary.groupBy("lang").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    langs = spans.join(counts.where("word is null").select("lang", F.col("n").alias("all")), "lang")
    named = kept.join(F.broadcast(langs), (F.col("w1") >= F.col("first")) & (F.col("w1") <= F.col("last"))).drop("first", "last")
    best = [F.desc("score"), F.desc("f")]
    for shares in (["lang", (F.xxhash64(*_IDS) % SALTS)], ["lang"]):
        named = named.withColumn("_rank", F.rank().over(Window.partitionBy(*shares).orderBy(*best))).where(F.col("_rank") <= top)
    told = written(named.drop("_rank").withColumn("_at", F.monotonically_increasing_id()), "best")
    spelt = told.select("_at", F.posexplode(F.filter(F.array(*_IDS), lambda i: i > 0)).alias("pos", "id")).join(dictionary.select("id", "word"), "id")
    phrase = spelt.groupBy("_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(*best, "phrase")
    ranked = told.join(phrase, "_at").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("all").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_CUT = "[.,;:!?\\x0A-\\x0D]"
_PHRASES = " UNION ALL ".join(f"SELECT lang, {m} AS m, list_slice(ws, i, i + {m - 1}) AS p FROM spots WHERE i + {m - 1} <= len(ws)" for m in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, m, p, f, {k} AS k, p[1:{k}] AS first, p[{k + 1}:m] AS rest FROM c WHERE m > {k}" for k in range(1, LONGEST))
_INNER = " UNION ALL ".join(f"SELECT lang, p[{i}:{i + m - 1}] AS p, f FROM c WHERE m > {m} AND m >= {i + m - 1}" for m in range(2, LONGEST) for i in range(1, LONGEST - m + 2))
ORACLE = f"""WITH pieces AS (
  SELECT lang, unnest(string_split_regex(text, '{_CUT}')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS MATERIALIZED (SELECT lang, m, p, count(*) AS f FROM ({_PHRASES}) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT * FROM g WHERE m > 1),
cut AS (SELECT c.lang, c.m, c.p, c.f, k, a.f AS l, b.f AS r, CAST(2000000::HUGEINT * c.f // (a.f + b.f) AS BIGINT) AS score
  FROM ({_CUTS}) c JOIN g a ON a.lang = c.lang AND a.p = c.first JOIN g b ON b.lang = c.lang AND b.p = c.rest),
scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, p, max(f) AS longer FROM ({_INNER}) GROUP BY 1, 2),
kept AS (SELECT s.* FROM scored s LEFT JOIN held i ON i.lang = s.lang AND i.p = s.p WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.f),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

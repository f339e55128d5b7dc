"""Importance resampling towards a target distribution, over hashed n-grams whose CRCs are composed and never spelt out.

Words are runs of letters, digits and all that isn't ASCII, after A-Z are lower-cased. Features are the runs of up to LONGEST words, joined
by one blank, repeats counted; a feature's bucket is its CRC-32 modulo BUCKETS. Only the CRC of each distinct word is computed from bytes. That
of a longer run follows from the algebra of CRCs: crc(a + b) is crc(a), shifted by the length of b, plus crc(b), where the shift by 2^k bytes
is a matrix over GF(2), the square of the one before, and a length is a sum of powers. Matrices are applied to whole columns, as tables of
256 entries for each byte.

A task counts its features into one array of BUCKETS numbers, so one row for each bucket and task is shuffled. The gains of the buckets (a
bounded number) go to all tasks; a document's weight is the floored mean of the gains of its features. The draw adds Gumbel noise from the
hash of the doc_id, which makes it a draw without replacement, and takes the highest sums through a numbering by ranges.

Edge cases: a null text has no words; texts are read whole, in windows of columns, so memory grows with the longest text only; documents without
features weigh 0; repeated rows are weighed and drawn each; ties go to the smaller doc_id, a null one first (its noise is that of an empty
text); with an empty target every gain follows from T = 0; an empty table gives an empty result. Other columns of the input stay; those
with the names of the results are replaced.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from farebox.llm.common import table, text_or_empty, written
from farebox.operators.ordinals import numbered

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
SHARE = 25
#: Bytes of text whose words are found at once; a longer text is taken alone.
WINDOW = 1 << 20
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BLANK = zlib.crc32(b" ")


def _one_zero_byte() -> list[int]:
    """The matrix that appends a zero byte to what a CRC has seen: where each of its 32 bits goes."""
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        columns.append(c)
    return columns


def _times(columns: list[int], c: int) -> int:
    out = 0
    for bit in range(32):
        if c >> bit & 1:
            out ^= columns[bit]
    return out


def _tables(columns: list[int]) -> np.ndarray:
    """The matrix as four tables, one for each byte of a CRC."""
    out = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for value in range(1, 256):
            low = value & -value
            out[part, value] = out[part, value ^ low] ^ np.uint32(columns[8 * part + low.bit_length() - 1])
    return out


class Shifts:
    """Shifts of CRCs by any number of bytes, by powers of the matrix of one."""

    def __init__(self) -> None:
        self.columns = _one_zero_byte()
        self.powers = [_tables(self.columns)]

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            self.columns = [_times(self.columns, c) for c in self.columns]
            self.powers.append(_tables(self.columns))
        return self.powers[k]

    def shifted(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC after as many zero bytes as its length says."""
        out, k = crcs.astype(np.uint32), 0
        while (lengths >> k).any():
            at = np.flatnonzero(lengths >> k & 1)
            c, t = out[at], self._power(k)
            out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
            k += 1
        return out

    def combined(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The CRCs of left parts followed by right parts of the given lengths."""
        return self.shifted(left, lengths) ^ right


_shifts = Shifts()


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that stand one after the other: (CRC, length, text) of each. ends: where each text starts, and the end."""
    data = _LOWER[data]
    word = _IN_WORD[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[:1], before[1:], after[-1:], after[:-1] = False, word[:-1], False, word[1:]
    before[ends[ends < data.size]] = False
    after[ends[ends > 0] - 1] = False
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not first.size:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.stack([first, last], 1).ravel().astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), places.size - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])
    distinct = spans.take(pa.array(np.arange(0, places.size - 1, 2))).dictionary_encode()
    each = distinct.dictionary.to_pylist()
    at = distinct.indices.to_numpy()
    crcs = np.fromiter(map(zlib.crc32, each), np.uint32, len(each))[at]
    return crcs, last - first, np.searchsorted(ends, first, "right") - 1


def features(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS):
    """For the texts of an Arrow column, window by window: (first text, words of each text, bucket of each feature, text of each feature)."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, k = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8), 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + WINDOW, "right")) - 1)
        own = ends[k : stop + 1] - ends[k]
        crcs, lengths, of = _words(data[int(ends[k]) : int(ends[stop])], own)
        found, owners, run = [crcs.astype(np.int64) % buckets], [of], crcs
        for n in range(2, longest + 1):
            spaced = _shifts.combined(run[:-1], np.uint32(_BLANK), np.ones(max(run.size - 1, 0), np.int64))
            run = _shifts.combined(spaced, crcs[n - 1 :], lengths[n - 1 :])
            same = of[n - 1 :] == of[: max(of.size - n + 1, 0)]
            found.append(run[same].astype(np.int64) % buckets)
            owners.append(of[n - 1 :][same])
        yield k, np.bincount(of, minlength=stop - k), np.concatenate(found), np.concatenate(owners)
        k = stop


def bucket_counts(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def counted(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _ in features(batch.column(0), longest, buckets):
                n += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    return df.select(text_or_empty(text).alias("text")).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The floored 1000-fold logarithm of how much more frequent each bucket is in the target, with one feature added to every bucket."""
    all_own, all_target = float(sum(own.values()) + buckets), float(sum(target.values()) + buckets)
    ratios = (float(target.get(b, 0) + 1) * all_own / (float(own.get(b, 0) + 1) * all_target) for b in range(buckets))
    return [math.floor(1000 * math.log(r)) for r in ratios]


def weighed(text: Column, gain: list[int], longest: int = LONGEST) -> Column:
    """A struct of a text's words, features and weight."""
    table_of = np.array(gain, np.int64)

    @arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weigh(texts: pa.Array) -> pa.Array:
        words, number, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for k, n, found, of in features(texts, longest, table_of.size):
            own = slice(k, k + n.size)
            words[own], number[own] = n, np.bincount(of, minlength=n.size)
            total[own] = np.bincount(of, table_of[found], n.size).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(words), pa.array(number), pa.array(total // np.maximum(number, 1))], names=["n_words", "n_features", "weight"])

    return weigh(text)


def noise(doc_id: str = "doc_id", seed: int = 7) -> Column:
    """Gumbel noise in thousandths, floored, from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", least_words: int = LEAST_WORDS, share: int = SHARE, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 7, columns: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank: of the documents with enough words, share percent with the highest scores have ranks from 1 on.

    columns: those of docs that the result keeps, doc_id among them (None: all). What is kept is written and put in order with the scores.
    """
    both = [{r.bucket: r.n for r in bucket_counts(df, c, longest, buckets).collect()} for df, c in ((docs, text), (target, target_text))]
    kept = [c for c in columns or docs.columns if c.lower() not in ("n_words", "n_features", "weight", "score", "rank", "_w")]
    rows = docs.select(*kept, weighed(text_or_empty(text), gains(*both, buckets), longest).alias("_w")).select(*kept, "_w.*")
    scored = written(rows.withColumn("score", F.col("weight") + noise(doc_id, seed)), "weights")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = F.lit(enough.count() * share // 100)
    ranked = numbered(enough, F.desc("score"), F.asc(doc_id), name="rank", first=1).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark"), columns=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")

"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data is redacted, the sources are mixed
to their target weights, and the copies that are left are packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. A stage first deletes the intermediate tables of the stages before it that this thread has applied, except
those that its docs still read: so stages that are composed without writing work too, and threads leave one another's tables alone. run() deletes
all of its tables but the last at its end. The stages run the classifier, the hash functions, a random mix and a
tokenizer, none of which SQL can express: ORACLE_SQL is None, and tests hold the stages against brute force.

Edge cases: null and empty texts pass toxicity, one of each group of them stays, and they take part in the mix with no words; a null doc_id is
kept like any other; repeated rows are near duplicates of one another; very long texts are read whole; extra columns pass all stages but the
last, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import mixing, packing, pii, simhash, toxicity
from farebox.llm.common import delete, noted, table, written

#: The intermediate tables of the stages that this thread or task has applied, by the stage's function.
_scratch: ContextVar[dict[str, list[str]] | None] = ContextVar("scratch", default=None)


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch = _scratch.get()
        if scratch is None:
            _scratch.set(scratch := {})
        names = [own.__name__ for _, own in STAGES]
        for before in names[: names.index(f.__name__)]:
            delete(spark, scratch.get(before, []), read_by=docs)
        with noted(scratch.setdefault(f.__name__, [])):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below 0.5."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@_stage
def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id: candidates are those that op3's fingerprints link by Golay keys, and
    those that minimal hashes add; all are verified (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return simhash.keep_one(docs, width=5, similarity=0.8)


@_stage
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the kind in brackets; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", toxic), ("near duplicates", duplicates), ("personal data", private), ("mix", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages, one after the other. Only the last stage's table is left in the shared folder."""
    docs, token, before = table(spark, sf_dir, "documents"), _scratch.set({}), []
    try:
        for k, (_, stage) in enumerate(STAGES):
            done = []
            with noted(done):
                docs = stage(spark, docs, sf_dir)
            out = []
            with noted(out):
                docs = written(docs, f"stage{k}")
            delete(spark, before + done)
            before = out
    finally:
        _scratch.reset(token)
    return docs

"""What the corpus operators share: reading tables, the shared work folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session on one machine that names none (a test) gets a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="farebox-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Lists that take note of the tables written meanwhile, by this thread or task alone.
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _noted.get():
        paths.append(path)
    return path


@contextmanager
def noted(paths: list[str]):
    """Adds the paths of what is written in this block to a list, so that it can be deleted once nothing reads it."""
    token = _noted.set((*_noted.get(), paths))
    try:
        yield
    finally:
        _noted.reset(token)


def delete(spark: SparkSession, paths: list[str], read_by: DataFrame | None = None) -> None:
    """Deletes written tables and takes them off the list; those that read_by still reads stay."""
    files = read_by.inputFiles() if read_by is not None and paths else []
    still = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in files)]
    for path in set(paths) - set(still):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths[:] = still


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: later jobs don't compute them anew, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """As written(), but the rows are dealt once by a key and stored in buckets of it: later joins on the key read them where they are, unshuffled.

    The session's catalogue knows the table only until it is read; what is left are the files.
    """
    spark = df.sparkSession
    path, parts = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.repartition(parts, key).write.option("path", path).bucketBy(parts, key).saveAsTable(own, format="parquet")
    try:
        return spark.table(own)
    finally:
        spark.sql(f"DROP TABLE {own}")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))

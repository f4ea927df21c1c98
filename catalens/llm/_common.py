"""Scratch tables, table readers and small shared expressions of the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters, the only ones that the word operators fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: How much of a partition Python tasks are handed at once: with long texts the default's 10 000 rows are tens of MB on both sides.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Settings while a scratch table is written: what was shuffled for it goes as soon as it stands.
WRITING = {**ARROW_BATCHES, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="catalens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths of the scratch tables of each open scope of this thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scratch scopes", default=())


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the scratch folders that this thread makes inside, at its end. What it yields writes a result that stays."""
    paths: list[str] = []
    outer = _scopes.get()
    token = _scopes.set((*outer, paths))

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        kept = paths.pop()
        if outer:  # the enclosing scope's, as any table made there
            outer[-1].append(kept)
        return out

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in paths:
            _delete(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed to ``values`` inside, and as before at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts lineage as ``checkpoint()`` does, survives lost executors, and keeps column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    with settings(spark, WRITING):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nobody reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus

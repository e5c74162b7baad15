"""What the training-data operators share: loading, durable cuts of lineage, bounded driver reads."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import rounds
from lanewise.operators.rounds import shared_dir

#: White space of the quality and near-duplicate word rule.
SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back; survives lost executors.

    Its shuffle files go as soon as the copy is whole, so a loop of cuts holds one round's files at a time.
    """
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return rounds.durable(df.select("*"))


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside, so that long texts fit a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, str(rows if before <= 0 else min(before, rows))):
        yield


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table below the shared folder: columnar, so later passes read only what they use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanewise-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that written() made."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in used:
        k += 1
        name = f"{stem}_{k}"
    return name


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length of a string, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

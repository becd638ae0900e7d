"""Shared plumbing of the corpus operators: the shared folder, materialised stages, size-checked broadcasts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, NullType, StringType

from siltstone.sources.folder import shared_dir

#: Rows and bytes that a side may have to be broadcast. Beyond either the plan shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, so a lost executor costs
    no more than the stage that runs."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    for held in _recording:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


_recording: list[list[str]] = []


@contextmanager
def recorded(held: list[str]) -> Iterator[None]:
    """Within, folders that :func:`stage` writes are noted in ``held``."""
    _recording.append(held)
    try:
        yield
    finally:
        _recording[:] = [x for x in _recording if x is not held]


def release(spark: SparkSession, held: list[str]) -> None:
    """Deletes the folders noted, which nothing must read any more."""
    while held:
        path = spark._jvm.org.apache.hadoop.fs.Path(held.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is staged by now: its cleaner deletes them, on all executors, when the
    driver's collector finds that nothing refers to them, which by itself may take as long as all that follows. What still
    reports the last job refers to them too, so that is waited for a moment."""
    time.sleep(0.5)
    spark._jvm.java.lang.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, what runs exchanges at most so many rows at once with Python: texts are large, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to have at most ``rows`` rows of at most ``size`` bytes; otherwise
    as it is, and the join shuffles. Call it on a staged table: counting then reads Parquet footers, and columns of
    varying width only where the rows are few."""
    n = df.count()
    if n > rows:
        return df
    wide = [f.name for f in df.schema if not isinstance(f.dataType, (AtomicType, NullType)) or isinstance(f.dataType, (StringType, BinaryType))]
    held = n * 16 * len(df.columns)
    if wide and n:
        held += df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0]
    return F.broadcast(df) if held <= size else df


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with only the needed columns under their names, so that no other clashes with what an operator adds, and
    the way back to all columns as they were."""
    names = [c if c in needed else f"__c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; a null doc_id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)

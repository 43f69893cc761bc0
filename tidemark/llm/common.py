"""Helpers shared by the corpus operators: the shared work folder, written tables, row locators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that identify a row of a stored table: the file it came from and its place in it.
LOCATOR = ("__located_file", "__located_row")


#: Let Spark drop texts that cannot hit by a Bloom filter of bounded size before they are shuffled.
BLOOM_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "4000000",
}


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """Session settings for what runs inside the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; a new temporary folder
    stands in for it only where that is unset and driver and tasks are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder (not created yet)."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it back: lineage ends at the shared files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared one that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What a Python worker keeps from task to task for one operator; what it kept for another is let go."""
    if others := [name for name in _KEPT if name != operator]:
        for name in others:
            _KEPT.pop(name).clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _KEPT.setdefault(operator, {})


def give_back() -> None:
    """Return to the system what a Python worker has freed: it stays beside its executor while later stages run without it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def located(docs: DataFrame, label: str = "located") -> DataFrame:
    """``docs`` with LOCATOR columns naming each row's file and index in that file.

    A plain scan of Parquet files offers these as metadata. Anything else is
    first written to the shared folder, so that the locator is stable when a
    lost executor's work is done again. Rows that have a locator keep it.
    """
    if all(c in docs.columns for c in LOCATOR):
        return docs
    try:
        meta = docs.metadataColumn("_metadata")
        out = docs.select("*", meta["file_path"].alias(LOCATOR[0]), meta["row_index"].alias(LOCATOR[1]))
        out.schema  # analysis happens here
        return out
    except (AnalysisException, AttributeError, TypeError):
        spark = docs.sparkSession
        copy = stored(docs, work_dir(spark, label))
        meta = copy.metadataColumn("_metadata")
        return copy.select("*", meta["file_path"].alias(LOCATOR[0]), meta["row_index"].alias(LOCATOR[1]))


def whole_text(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))

"""A table of parts that a batch rewrites only where its keys fall, safe to repeat.

Layout: ``bucket=B/batch=K`` holds all rows of a part as of batch K, and an empty file
``_commits/K`` says that batch K is whole. A batch reads the last committed version of
the parts that its keys touch, writes their next version beside it and commits; then
older versions of these parts go. Before the commit nothing that readers use changes,
so a batch that stops anywhere is simply run again, and one that is committed already
is skipped. No version is ever written over while it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, files = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def last_commit(spark: SparkSession, target: str) -> int:
    """The number of the last whole batch; -1 before the first."""
    return max((int(n) for n in _names(spark, f"{target}/_commits") if n.isdigit()), default=-1)


def versions(spark: SparkSession, target: str, until: int) -> dict[int, list[int]]:
    """Batches up to ``until`` that wrote each part, oldest first; as many entries as parts."""
    parts = sorted(int(n.removeprefix("bucket=")) for n in _names(spark, target) if n.startswith("bucket="))
    found = {b: sorted(int(n.removeprefix("batch=")) for n in _names(spark, f"{target}/bucket={b}") if n.startswith("batch=")) for b in parts}
    return {b: [k for k in ks if k <= until] for b, ks in found.items() if any(k <= until for k in ks)}


def _read(spark: SparkSession, target: str, parts: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/bucket={b}/batch={k}" for b, k in parts.items()]
    return spark.read.parquet(*paths) if paths else None


def parted_table(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of the last committed version of every part; None before the first commit."""
    now = versions(spark, target, last_commit(spark, target))
    return _read(spark, target, {b: ks[-1] for b, ks in now.items()})


def parted_merge(batch: DataFrame, number: int, target: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], parts: int = 64) -> list[int]:
    """Put batch ``number`` into the table: ``merge(old, batch)`` of the parts that its keys touch. Returns those parts.

    ``merge`` gets the rows of the touched parts (None if there are none yet) and gives their new rows; ``parts`` stays the
    same from batch to batch.
    """
    spark = batch.sparkSession
    done = last_commit(spark, target)
    if number <= done:
        return []
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(parts)).cast("int")
    batch = batch.persist()
    try:
        touched = sorted(r.b for r in batch.select(bucket.alias("b")).distinct().collect())  # at most ``parts`` numbers
        before = versions(spark, target, done)
        old = _read(spark, target, {b: before[b][-1] for b in touched if b in before})
        merged = merge(old, batch).withColumns({"bucket": bucket, "batch": F.lit(number)})
        if touched:
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)
    finally:
        batch.unpersist()
    at, files = _files(spark, f"{target}/_commits/{number}")
    files.create(at, True).close()
    for b in touched:
        for k in before.get(b, []):
            at, files = _files(spark, f"{target}/bucket={b}/batch={k}")
            files.delete(at, True)
    return touched

"""Structured Streaming twins of batch operators, run over the files that are there.

A job writes every micro-batch's changed rows to a folder that driver and
executors share, one subfolder a batch, so that a batch that is run again
replaces what it wrote.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.timeseries import distinct_in_reach
from tidemark.streaming.tables import parted_merge, parted_table


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; a temporary one only where that is unset and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over Parquet files with the schema that they have."""
    # as a pattern, a path may name a file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, mode: str, keys: list[str], label: str) -> DataFrame:
    """Run a stream over what is there; the last version of each key."""
    spark = stream.sparkSession
    work = work_path(spark, label)
    done: list[int] = []

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/batch_number={number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(publish).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{work}/out").drop("batch_number")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return last.select(*keys, "v.*")


def purchases(events: DataFrame) -> DataFrame:
    """Purchases as dealings: director, ticker, ts, value."""
    return events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("director"), F.concat(F.lit("Brand#"), F.col("user_id") % 25 + 1).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )


def seen_counts(events: DataFrame) -> DataFrame:
    """first_seen, last_seen and seen_count of each key."""
    return events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))


def ingest(events: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Rows once each: copies that come within ``late`` of the first one are dropped, and state is let go after that."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def seen_merge(old: DataFrame | None, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """first_seen, last_seen and seen_count of each key of ``batch``, on top of those of ``old``."""
    new = batch.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))
    if old is None:
        return new
    both = old.select(*new.columns).unionByName(new)
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))


def ingest_and_upsert(events: DataFrame, row_keys: list[str], keys: list[str], at: str, target: str, checkpoint: str, parts: int = 64) -> DataFrame:
    """Incremental ingest to the end of what is there: each micro-batch is deduplicated and merged into the table at ``target``.

    ``target`` and ``checkpoint`` are named by the caller and go on from call to call: a later call reads new files only,
    and rewrites only the parts of the table whose keys come up in them. A batch that is run again, after a stop at any
    point, gives the same table. Returns the table as it is then.
    """

    def merge(batch: DataFrame, number: int) -> None:
        parted_merge(batch, number, target, keys, lambda old, new: seen_merge(old, new, keys, at), parts)

    query = ingest(events, row_keys, at).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    table = parted_table(events.sparkSession, target)
    if table is None:
        empty = events.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))
        return events.sparkSession.createDataFrame([], empty.schema)
    return table


def daily_activity(events: DataFrame, late: str = "7 days", buy: str = "purchase", sell: str = "sale") -> DataFrame:
    """Daily number and value of buys and sells; filings may be late by the watermark."""
    kind = F.when(F.col("event_type") == buy, "BUY").when(F.col("event_type") == sell, "SELL")
    rows = events.withColumn("type", kind).where("type IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "1 day"), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "type", "n", "total")


def by_month(daily: DataFrame) -> DataFrame:
    """Monthly buys and sells from the days of the stream."""
    return daily.groupBy(F.trunc(F.to_date("start"), "month").alias("month"), "type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def first_purchases(events: DataFrame) -> DataFrame:
    """First-time state: the earliest purchase of each director in each ticker, without expiry."""
    return purchases(events).groupBy("director", "ticker").agg(F.min("ts").alias("first_ts"))


def first_time_events(events: DataFrame) -> DataFrame:
    """An event for each purchase that is the first of its director in its ticker when it arrives; state holds the earliest time seen."""
    import pandas as pd

    def step(key, batches, state):
        rows = pd.concat(list(batches))
        earliest = rows["ts"].min()
        first = not state.exists
        if first or earliest < state.get[0]:
            state.update((earliest,))
        if first:
            yield pd.DataFrame({"director": [key[0]], "ticker": [key[1]], "first_ts": [earliest]})

    return purchases(events).groupBy("director", "ticker").applyInPandasWithState(step, "director long, ticker string, first_ts timestamp", "first_ts timestamp", "append", "NoTimeout")


def buyer_sessions(events: DataFrame, gap: str = "30 days") -> DataFrame:
    """Sessions of purchases per ticker, ended by a gap, with their buyers."""
    out = purchases(events).groupBy(F.session_window("ts", gap), "ticker").agg(F.count(F.lit(1)).alias("n"), F.collect_set("director").alias("directors"))
    return out.select(F.col("session_window.start").alias("start"), "ticker", "n", F.sort_array("directors").alias("directors"))


def buying_days(events: DataFrame) -> DataFrame:
    """The days on which each director bought each ticker, once each."""
    return purchases(events).groupBy(F.to_date("ts").alias("day"), "ticker", "director").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(days: DataFrame, span: int = 30) -> DataFrame:
    """Rows (start, ticker, n_buyers): distinct buyers in windows of ``span`` days, a day apart, from the days of ``buying_days``; windows without buyers are left out."""
    epoch = F.lit("1970-01-01").cast("date")
    counts = distinct_in_reach(days.withColumn("_day", F.datediff("day", epoch)), ["ticker"], "director", "_day", 1 - span, 0)
    until = F.lead("day").over(Window.partitionBy("ticker").orderBy("day"))
    runs = counts.withColumn("_until", until).where("n > 0")
    return runs.select(F.explode(F.sequence("day", F.col("_until") - 1)).alias("_d"), "ticker", "n").select(F.date_add(epoch, F.col("_d")).alias("start"), "ticker", F.col("n").cast("int").alias("n_buyers"))


def sliding_buyers(events: DataFrame, span: str = "30 days") -> DataFrame:
    """Distinct buyers per ticker in sliding windows a day apart, counted by a sketch of fixed size; ``sliding_counts`` counts exactly."""
    out = purchases(events).groupBy(F.window("ts", span, "1 day"), "ticker").agg(F.approx_count_distinct("director").cast("int").alias("n_buyers"))
    return out.select(F.col("window.start").alias("start"), "ticker", "n_buyers")

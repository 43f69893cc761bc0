"""Exact deduplication with stateful streaming.

A digest table (digest, stable identifier, content locator) is derived from the
documents and streamed through a keyed aggregation without watermark, so that
its state never expires. The state store is RocksDB: keys live on disk and are
uploaded to the shared checkpoint folder, from where a replacement executor
restores them. For each digest the state holds the identifier and locator of
the document to keep and the number of rows seen.

Every hit (a digest seen more than once) is then checked on full bytes: the
text of each member is compared with the text found by the keeper's locator.
Members that differ, which takes a digest collision, are grouped by their text
itself.

Defined results: null text counts as empty text; a null identifier sorts below
all others; repeated rows with one identifier are kept once; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLOOM_CONF, LOCATOR, configured, located, stored, whole_text, work_dir

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # many small stores: without space set aside in advance for each one's logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # executors close the stores of a stream that has ended soon after
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def _digest(text: Column, hex_digits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, hex_digits)


def _stream_classes(digests: DataFrame, path: str, work: str, trigger: dict[str, str]) -> DataFrame:
    """Run the keyed stream over the stored digest table; one row per digest."""
    spark = digests.sparkSession
    stream = spark.readStream.schema(digests.schema).options(**trigger).parquet(path)
    state = stream.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("id", *LOCATOR)).alias("keep"),
    )
    done: list[int] = []

    def publish(batch: DataFrame, number: int) -> None:
        # one folder per micro-batch, overwritten if the batch is run again
        batch.write.mode("overwrite").parquet(f"{work}/updates/batch={number}")
        done.append(number)

    with configured(spark, _STATE_CONF):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(publish)
            .start()
        )
        query.awaitTermination()
    if not done:
        return spark.createDataFrame([], state.schema)
    updates = spark.read.schema(state.schema).parquet(f"{work}/updates")
    # counts only grow, so the update with the largest count is the last one of its key
    last = updates.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s"))
    return last.select("digest", "s.group_size", "s.keep")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_hex: int = 64,
    trigger: dict[str, str] | None = None,
) -> DataFrame:
    """Group rows of equal text; one row per input row.

    Returns id, text_sha256, keep_id, group_size, kept and the LOCATOR columns.
    ``digest_hex`` shortens the state's key (tests force collisions with it);
    ``trigger`` holds the file-source options that bound a micro-batch.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "exact-dedup")
    trigger = trigger or {"maxBytesPerTrigger": str(64 << 30)}
    rows = located(docs).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *LOCATOR)
    keyed = rows.withColumn("digest", _digest(F.col("text"), digest_hex))
    digests = stored(
        keyed.select("id", "digest", F.sha2("text", 256).alias("text_sha256"), *LOCATOR), f"{work}/digests"
    )
    classes = stored(_stream_classes(digests, f"{work}/digests", work, trigger), f"{work}/classes")

    hits = classes.where("group_size > 1")
    at_keeper = [F.col(c) == F.col(f"keep.{c}") for c in LOCATOR]
    with configured(spark, BLOOM_CONF):
        keepers = stored(
            keyed.withColumnRenamed("digest", "d")
            .join(hits, [F.col("d") == F.col("digest"), *at_keeper])
            .select("digest", "group_size", F.col("text").alias("keeper_text")),
            f"{work}/keepers",
        )
        differing = stored(
            keyed.join(keepers.where("group_size > 1"), "digest").where("text <> keeper_text").select("digest", *LOCATOR),
            f"{work}/differing",
        )
    matched = digests.join(classes, "digest")
    if not differing.isEmpty():
        matched = _split_collisions(keyed, digests, matched, differing, work)
    same_place = F.lit(True)
    for c in at_keeper:
        same_place = same_place & c
    return matched.select(
        F.col("id").alias(id_col),
        "text_sha256",
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        same_place.alias("kept"),
        *LOCATOR,
    )


def _split_collisions(keyed: DataFrame, digests: DataFrame, matched: DataFrame, differing: DataFrame, work: str) -> DataFrame:
    """Classes by full text for the digests under which texts differ."""
    collided = differing.select("digest").distinct()
    members = stored(keyed.join(collided, "digest"), f"{work}/collided")
    by_text = members.groupBy("digest", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", *LOCATOR)).alias("keep")
    )
    fixed = members.join(by_text, ["digest", "text"]).select(
        *LOCATOR, F.col("group_size").alias("fixed_size"), F.col("keep").alias("fixed_keep")
    )
    return matched.join(fixed, list(LOCATOR), "left").select(
        "id",
        "text_sha256",
        *LOCATOR,
        F.coalesce("fixed_size", "group_size").alias("group_size"),
        F.coalesce("fixed_keep", "keep").alias("keep"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact_dedup() does not keep; columns as given."""
    rows = located(docs)
    dropped = exact_dedup(rows, id_col, text_col).where("NOT kept").select(*LOCATOR)
    return rows.join(dropped, list(LOCATOR), "left_anti").select(*docs.columns)

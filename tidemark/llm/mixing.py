"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source's target is its weight's share of the wanted total. Targets stop at
``max_epochs`` times the source's size and what they exceed goes to the other
sources by weight, until none is above. The fixed point has a closed form: in
order of size per weight, the first k sources are full and the others share
the rest at one level, which windows over the table of sources find.

A source is then taken ``target / size`` times: whole repetitions of all its
documents, and a seeded sample of the fraction. The sample is a prefix of the
source in the order of a seeded hash, cut where the running size is nearest the
fraction; the running size comes from fixed hash buckets (totals per bucket,
prefix sums of those, and a running sum inside the bucket), so that no task
holds more than one bucket of a source.

Rows of one hash and size go by where they are, so the same ones are taken if a
task runs again.

Defined results: null text has size 0; null is a source of its own, ordered
last; a source of size 0 has target 0; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOCATOR, located, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that name a bucket: 16 ** 3 buckets in each source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size) with a column target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(order) - 1) % F.lit(len(weights))
    weighed = sizes.withColumn("weight", F.element_at(cycle, place.cast("int") + 1)).withColumn(
        "cap", F.lit(float(max_epochs)) * F.col("source_size")
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("full_caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_caps")) / F.col("open_weight"))
        # if the level of "all before me are full" leaves me open, it is the level of all from me on
        .withColumn("open_level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("shared_level", F.first("open_level", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("shared_level", F.lit(float("inf"))))
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats (whole copies taken), taken; LOCATOR too with ``carry``."""
    rows = located(docs)
    # rows without an identifier are dealt out by where they are
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.col(LOCATOR[1]).cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(seed), name, F.lit("mix")).cast("binary"))
    sized = rows.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(whole_text(text_col)).alias("size"), key.alias("k"), *LOCATOR
    ).withColumn("bucket", F.substring("k", 1, BUCKET_DIGITS))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(per_source, weights, share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    starts = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(starts), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "bucket", "bucket_start", "source_size", "target", F.floor(rate).alias("whole"))
        # words still wanted after the whole repetitions
        .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("k", "id", "size", *LOCATOR).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("through", F.sum("size").over(inside)).alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))
    )
    middle = F.col("bucket_start") + F.col("through") - F.col("size") / F.lit(2.0)
    repeats = F.col("whole") + F.when(middle < F.col("wanted"), F.lit(1)).otherwise(F.lit(0))
    return placed.select(
        F.col("id").alias(id_col), F.col("d.source").alias(source_col), "size", "source_size", "target", repeats.cast("long").alias("repeats"), *(LOCATOR if carry else ())
    ).withColumn("taken", F.col("repeats") * F.col("size"))


def take_mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as given."""
    rows = located(docs)
    taken = mix_sources(rows, weights, share, max_epochs, seed, carry=True).where("repeats > 0")
    copies = taken.select(*LOCATOR, F.array_repeat(F.lit(1), F.col("repeats").cast("int")).alias("__copies"))
    return rows.join(copies, list(LOCATOR)).select(*docs.columns, F.explode("__copies").alias("__copy")).drop("__copy")

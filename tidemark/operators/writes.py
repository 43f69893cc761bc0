"""Upserts, inserts and overlays as DataFrame merges, for stores without row updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.checks import parity
from tidemark.operators.ranking import kept
from tidemark.streaming.tables import parted_merge


def fold_edits(edits: DataFrame, key: str, fields: list[str], at: str) -> DataFrame:
    """One edit per key: the last action and, of each field, the last value that was given since the last rejection or addition.

    ``given`` (an array of field names) tells which fields an edit sets, so that a field can be set to null; without that
    column the fields that are not null are given.
    """
    given = F.col("given") if "given" in edits.columns else F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]))
    rows = edits.withColumn("given", given)
    # an update after a rejection or an addition rests on it; what came before is void
    start = F.max(F.when(F.col("action") != "update", F.col(at))).over(Window.partitionBy(key))
    live = rows.withColumn("_start", start).where(F.col("_start").isNull() | (F.col(at) >= F.col("_start")))
    last = lambda c: F.max_by(F.when(F.array_contains("given", c), F.struct(F.col(c).alias("v"))), F.when(F.array_contains("given", c), F.col(at)))
    folded = live.groupBy(key).agg(F.min_by("action", at).alias("action"), F.max("_start").alias("_start"), *[last(c).alias(f"_{c}") for c in fields])
    # no rejection or addition: an update; else what the first of the live edits is
    return folded.select(key, F.when(F.col("_start").isNull(), "update").otherwise(F.col("action")).alias("action"), *[f"_{c}" for c in fields])


def apply_edits(rows: DataFrame, edits: DataFrame, key: str, at: str | None = None, rekey: Callable[..., Column] | None = None) -> DataFrame:
    """Edits (key, action, fields, time ``at``): update sets the fields given, add appends, reject removes.

    Edits of one key are folded in order of time, so each row comes out once. With ``rekey`` (the key of a row by its
    fields) an edit that changes the key is a removal under the old one and an addition under the new one; if a row of that
    key is there already, the edited one replaces it.
    """
    fields = [c for c in rows.columns if c != key]
    timed = edits if at else edits.withColumn("_at", F.monotonically_increasing_id())
    folded = fold_edits(timed, key, fields, at or "_at")
    changes = folded.where("action <> 'add'")
    merged = rows.join(changes, key, "left").where("action IS NULL OR action <> 'reject'")
    set_to = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c)
    kept = merged.select(key, *[set_to(c) for c in fields], F.col("action").isNotNull().alias("_edited"))
    added = folded.where("action = 'add'").select(key, *[F.col(f"_{c}.v").alias(c) for c in fields], F.lit(True).alias("_edited"))
    out = kept.join(added.select(key), key, "left_anti").unionByName(added)
    if rekey is None:
        return out.drop("_edited")
    moved = out.where("_edited").withColumn("_old", F.col(key)).withColumn(key, rekey(*[F.col(c) for c in fields]))
    # of several rows that come under one key the latest by old key stays; untouched ones of that key give way
    last = moved.groupBy(key).agg(F.max_by(F.struct(*fields), "_old").alias("_v")).select(key, "_v.*")
    return out.where("NOT _edited").drop("_edited").join(last.select(key), key, "left_anti").unionByName(last)


def refresh_dependents(before: DataFrame, after: DataFrame, dependents: DataFrame, key: str, part: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``dependents`` of rows, derived anew only for the parts (such as tickers) in which a row was added, removed or changed.

    ``derive`` gives the dependents of whole parts; those of other parts stay as they are.
    """
    columns = [c for c in before.columns if c not in (key, part)]
    digest = lambda df: df.select(key, part, F.xxhash64(*columns).alias("_h"))
    a, b = digest(before), digest(after)
    same = [key, part, "_h"]
    touched = a.join(b, same, "left_anti").select(part).unionByName(b.join(a, same, "left_anti").select(part)).distinct()
    fresh = derive(after.join(touched, part, "left_semi"))
    return dependents.join(touched, part, "left_anti").unionByName(fresh.select(*dependents.columns))


def upsert_seen(old: DataFrame, new: DataFrame, key: str, seen_at: str) -> DataFrame:
    """Rows with first_seen, last_seen, seen_count: a known key keeps first_seen and counts up; null fields take the new value."""
    fields = [c for c in new.columns if c != key]
    o = old.select(key, F.lit(1).alias("_o"), "first_seen", "seen_count", "last_seen", *[F.col(c).alias(f"_o_{c}") for c in fields])
    n = new.select(key, F.lit(1).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    both = o.join(n, key, "full")
    at = F.lit(seen_at).cast("date")
    return both.select(
        key,
        *[F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in fields],
        F.coalesce("first_seen", at).alias("first_seen"),
        F.when(F.col("_n").isNotNull(), at).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("seen_count"),
    )


def upsert_into(new: DataFrame, number: int, target: str, key: str, seen_at: str, parts: int = 64) -> list[int]:
    """``upsert_seen`` into the parted table at ``target``, rewriting only the parts that ``new`` touches; number ``number`` counts once."""

    def merge(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c != key]
        empty = rows.limit(0).select(key, *fields, F.lit(None).cast("date").alias("first_seen"), F.lit(None).cast("date").alias("last_seen"), F.lit(0).alias("seen_count"))
        return upsert_seen(empty if old is None else old, rows, key, seen_at)

    return parted_merge(new, number, target, [key], merge, parts)


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it has not got."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def backfill_starts(held: DataFrame, wanted: DataFrame, full: int = 250) -> DataFrame:
    """Rows (ticker, start): from which day on each wanted ticker's prices are to be fetched; null is from the beginning.

    Tickers with ``full`` days or more are left out; others go on the day after their last one.
    """
    days = held.groupBy("ticker").agg(F.countDistinct("dt").alias("_n"), F.max("dt").alias("_last"))
    return wanted.select("ticker").distinct().join(days, "ticker", "left").where(F.col("_n").isNull() | (F.col("_n") < full)).select("ticker", F.date_add("_last", 1).alias("start"))


def backfill(held: DataFrame, fetched: DataFrame, full: int = 250) -> DataFrame:
    """``held`` with the fetched prices of the days that ``backfill_starts`` asks for; a day that is there already stays as it is."""
    starts = backfill_starts(held, fetched, full)
    new = fetched.join(starts, "ticker").where(F.col("start").isNull() | (F.col("dt") >= F.col("start"))).select(*held.columns)
    return insert_new(held, new.dropDuplicates(["ticker", "dt"]), ["ticker", "dt"])


def latest_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` with the rows of ``old`` whose key it has not got."""
    return insert_new(new, old, key)


def replace_slice(old: DataFrame, new: DataFrame, inside) -> DataFrame:
    """``old`` without the rows where ``inside`` holds, and ``new``."""
    return old.where(~F.coalesce(inside, F.lit(False))).unionByName(new)


def result_file(rows: DataFrame, path: str, header: list[str], fmt: str = "csv") -> DataFrame:
    """Write the columns of a pinned header anew at ``path`` (Spark commits all files at once) and read them back."""
    out = rows.select(*header)
    out.write.mode("overwrite").option("header", "true").format(fmt).save(path)
    return rows.sparkSession.read.schema(out.schema).option("header", "true").format(fmt).load(path)


def nested_export(rows: DataFrame, path: str, outer: str, inner: str, key: str, measures: list[str]) -> DataFrame:
    """Write one JSON document per ``outer`` value, a tree inner -> key -> measures, and read the text back."""
    leaf = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.struct(*measures)))))
    level = rows.groupBy(outer, inner).agg(leaf.alias("_leaf"))
    tree = level.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(inner).cast("string"), F.to_json("_leaf"))))).alias("tree"))
    tree.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(f"{outer} string, tree map<string,string>").json(path)


def reload(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Copy tables (name -> rows and key) to ``path`` and compare copy and source by key and content: one row per table.

    A source is worked out once and written down: sums of doubles come out otherwise in another order, so a second working out
    would differ from the copy.
    """
    out = None
    for name, (source, key) in tables.items():
        rows = kept(source, "source")
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        copy = spark.read.parquet(f"{path}/{name}")
        digest = lambda df: df.groupBy(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns) % 1_000_003).alias("h"))  # noqa: B023, E731
        state = parity(digest(rows), digest(copy), "k", ["n", "h"])
        one = state.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("parity") == "same").alias("n_same"), F.count_if(F.col("parity") != "same").alias("n_other"))
        out = one if out is None else out.unionByName(one)
    return out


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Write a table as text (CSV with a header) and read it back by its schema."""
    rows.write.mode("overwrite").option("header", "true").csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", "true").csv(path)


def serving_views(dealings: DataFrame, prices: DataFrame, scores: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Temporary views for readers: per company, recent days, conviction, monthly capital."""
    day = F.lit(as_of).cast("date")
    seen = dealings.where(F.col("announced") <= day)
    latest = prices.where(F.col("dt") <= day).groupBy("ticker").agg(F.max_by("close", "dt").alias("last_close"))
    company = seen.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("announced").alias("last_announced")).join(latest, "ticker", "left")
    recent = seen.where(F.col("announced") >= F.date_sub(day, 14)).select("fingerprint", "ticker", "type", "value", "announced")
    capital = seen.where("type = 'BUY'").groupBy(F.trunc("announced", "month").alias("month")).agg(F.round(F.sum("value"), 2).alias("capital"))
    views = {"public_company_v": company, "public_recent_v": recent, "public_conviction_v": scores.select("fingerprint", "score", "band"), "public_capital_monthly_v": capital}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views

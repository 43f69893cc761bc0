"""Trading-day index, as-of joins and day offsets over price series.

The flavours of as-of join have names of their own: strictly after, on or after,
on or before, strictly before. What is found depends on the key and the day only,
so distinct (key, day) pairs of the events and the series are united and a running
``last`` carries the series row along: a key has at most two rows a day in that
window, however many events it has. Events then look their pair up by an equi-join
on key and day, which Spark broadcasts where the pairs are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trade_index(prices: DataFrame) -> DataFrame:
    """Column idx: the place of each row in its own series, from 1."""
    return prices.withColumn("idx", F.row_number().over(Window.partitionBy("ticker").orderBy("dt")))


def _asof(events: DataFrame, series: DataFrame, key: str, at: str, when: str, take: list[str], forward: bool, same_day: bool) -> DataFrame:
    """Add struct column ``found`` (when, *take) of the nearest series row; null if there is none, or no key or date."""
    row = F.struct(F.col(when), *[F.col(c) for c in take])
    kind = series.select(row.alias("s")).schema["s"].dataType
    asked = events.select(F.col(key).alias("_key"), F.col(at).alias("_at")).where("_key IS NOT NULL AND _at IS NOT NULL").distinct()
    left = asked.select("_key", "_at", F.lit(None).cast(kind).alias("_row"))
    right = series.select(F.col(key).alias("_key"), F.col(when).alias("_at"), row.alias("_row"))
    # on a shared day the series row comes first if it may be found
    first = F.col("_row").isNotNull() if same_day else F.col("_row").isNull()
    time = F.col("_at").desc() if forward else F.col("_at").asc()
    run = Window.partitionBy("_key").orderBy(time, first.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = left.unionByName(right).withColumn("found", F.last("_row", ignorenulls=True).over(run)).where(F.col("_row").isNull())
    return events.join(filled.select("_key", "_at", "found"), (events[key] == F.col("_key")) & (events[at] == F.col("_at")), "left").drop("_key", "_at")


def first_after(events: DataFrame, series: DataFrame, at: str, when: str = "dt", take: list[str] | None = None, key: str = "ticker") -> DataFrame:
    """The first series row strictly after the event's date."""
    return _asof(events, series, key, at, when, take or [], True, False)


def first_from(events: DataFrame, series: DataFrame, at: str, when: str = "dt", take: list[str] | None = None, key: str = "ticker") -> DataFrame:
    """The first series row on or after the event's date."""
    return _asof(events, series, key, at, when, take or [], True, True)


def last_until(events: DataFrame, series: DataFrame, at: str, when: str = "dt", take: list[str] | None = None, key: str = "ticker") -> DataFrame:
    """The last series row on or before the event's date."""
    return _asof(events, series, key, at, when, take or [], False, True)


def last_before(events: DataFrame, series: DataFrame, at: str, when: str = "dt", take: list[str] | None = None, key: str = "ticker") -> DataFrame:
    """The last series row strictly before the event's date."""
    return _asof(events, series, key, at, when, take or [], False, False)


def last_of_each(events: DataFrame, at: str, sources: dict[str, tuple[DataFrame, str, list[str]]], key: str = "ticker") -> DataFrame:
    """``last_until`` of several series (name -> rows, date column, columns to take) in one window: a struct column per name."""
    asked = events.select(F.col(key).alias("_key"), F.col(at).alias("_at")).where("_key IS NOT NULL AND _at IS NOT NULL").distinct()
    rows = {n: F.struct(F.col(when), *[F.col(c) for c in take]) for n, (_, when, take) in sources.items()}
    kinds = {n: sources[n][0].select(row.alias("s")).schema["s"].dataType for n, row in rows.items()}
    every = asked.select("_key", "_at", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()], F.lit(True).alias("_asked"))
    for n, (series, when, _) in sources.items():
        every = every.unionByName(series.select(F.col(key).alias("_key"), F.col(when).alias("_at"), *[(rows[n] if m == n else F.lit(None).cast(k)).alias(m) for m, k in kinds.items()], F.lit(False).alias("_asked")))
    run = Window.partitionBy("_key").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = every.withColumns({n: F.last(n, ignorenulls=True).over(run) for n in sources}).where("_asked").drop("_asked")
    return events.join(filled, (events[key] == F.col("_key")) & (events[at] == F.col("_at")), "left").drop("_key", "_at")


def at_offsets(entries: DataFrame, indexed: DataFrame, horizons: dict[str, int], idx: str = "entry_idx", key: str = "ticker") -> DataFrame:
    """One row per entry and horizon with the close that many trading days on (null where the series ends)."""
    steps = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("days")) for h, n in horizons.items()])
    wide = entries.withColumn("_s", F.explode(steps)).select("*", F.col("_s.horizon").alias("horizon"), F.col("_s.days").alias("days")).drop("_s")
    later = indexed.select(F.col("ticker").alias("_ticker"), F.col("idx").alias("_idx"), F.col("close").alias("later_close"), F.col("dt").alias("later_dt"))
    on = (F.col(key) == F.col("_ticker")) & (F.col(idx) + F.col("days") == F.col("_idx"))
    return wide.join(later, on, "left").drop("_ticker", "_idx")


def rolling(prices: DataFrame, column: Column, rows: int, own: bool = True) -> Column:
    """``column`` (an aggregate) over the last ``rows`` trading days, with or without the own row."""
    return column.over(Window.partitionBy("ticker").orderBy("dt").rowsBetween(-rows, 0 if own else -1))


def distinct_in_reach(rows: DataFrame, keys: list[str], member: str, day: str, back: int, ahead: int) -> DataFrame:
    """Rows (keys, day, n): on how many members' days, moved by ``back`` to ``ahead`` days, each day lies.

    A member's day D reaches from D + back to D + ahead; where its days overlap, the later one starts after the earlier
    one ends, so a member counts once. A running sum of starts and ends gives the count; it changes only on the days
    given, and the members' own days are among them. Windows hold one row a day: of a member, then of a key.
    """
    own = rows.where(F.col(day).isNotNull() & F.col(member).isNotNull()).select(*keys, member, F.col(day).alias("_at")).distinct()
    before = F.lag("_at").over(Window.partitionBy(*keys, member).orderBy("_at"))
    spans = own.withColumn("_from", F.greatest(F.col("_at") + back, F.coalesce(before + ahead + 1, F.col("_at") + back)))
    turn = lambda at, by: F.struct(at.alias("day"), F.lit(by).alias("_by"))
    turns = spans.select(*keys, F.explode(F.array(turn(F.col("_from"), 1), turn(F.col("_at"), 0), turn(F.col("_at") + ahead + 1, -1))).alias("_t")).select(*keys, "_t.*")
    daily = turns.groupBy(*keys, "day").agg(F.sum("_by").alias("_by"))
    run = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, "day", F.sum("_by").over(run).alias("n"))


def with_markers(prices: DataFrame, events: DataFrame, fields: list[str]) -> DataFrame:
    """Column markers: the events of each ticker and day as an array of structs of ``fields``, in their order; empty without any.

    Events are gathered before the join, so a price row comes out once.
    """
    marks = events.groupBy(F.col("ticker").alias("_t"), F.col("dt").alias("_d")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("markers"))
    out = prices.join(marks, (F.col("ticker") == F.col("_t")) & (F.col("dt") == F.col("_d")), "left").drop("_t", "_d")
    return out.withColumn("markers", F.coalesce("markers", F.array().cast(marks.schema["markers"].dataType)))


def extremes_ahead(prices: DataFrame, column: str, rows: int) -> DataFrame:
    """Columns least_ahead and most_ahead: over the row itself and the ``rows`` rows after it in its series, or what there is of these.

    Extremes of 1, 2, 4, ... rows are put together by ``lead``, two spans that overlap giving any length: a row's work
    grows with the logarithm of ``rows``.
    """
    order = Window.partitionBy("ticker").orderBy("dt")
    out, span, wanted = prices.withColumns({"least_ahead": F.col(column), "most_ahead": F.col(column)}), 1, rows + 1
    while span < wanted:
        step = min(span, wanted - span)
        # greatest and least leave out what is null, beyond the end of the series
        out = out.withColumns({"least_ahead": F.least("least_ahead", F.lead("least_ahead", step).over(order)), "most_ahead": F.greatest("most_ahead", F.lead("most_ahead", step).over(order))})
        span += step
    return out

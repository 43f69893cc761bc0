"""Buy signals, each a DataFrame transformation registered under its id, and their evaluation.

Every rule is walk-forward: a dealing only sees what was announced by its own
announcement. A signal returns (fingerprint, signal, confidence, fired_at).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import SENIOR, TIERS, lookup, role_tier
from tidemark.operators.timeseries import distinct_in_reach, last_until

KEEP = ["fingerprint", "ticker", "director", "dt", "announced", "role", "shares", "value"]


@dataclass(frozen=True)
class Context:
    """What signals may look at: strict buys to fire on, all buys to compare with, and prices."""

    buys: DataFrame
    prices: DataFrame

    @property
    def strict(self) -> DataFrame:
        return self.buys.where("buy_strictness = 'STRICT_BUY'")


def context(dealings: DataFrame, prices: DataFrame) -> Context:
    buys = dealings.where("type = 'BUY' AND announced IS NOT NULL")
    return Context(buys.withColumn("tier", role_tier(F.col("role"))), prices)


def _fired(df: DataFrame, signal, confidence) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("fingerprint", "ticker", lit(signal).alias("signal"), lit(confidence).alias("confidence"), F.col("announced").alias("fired_at"))


def with_tier_signal(ctx: Context) -> DataFrame:
    """The strict buys of at least their tier's threshold, with signal and confidence."""
    of = lambda place: lookup(F.col("tier"), {t: v[place] for t, v in TIERS.items()})
    return ctx.strict.where(F.col("value") >= of(0)).withColumns({"signal": of(3), "confidence": of(1)})


def tier_signals(ctx: Context) -> DataFrame:
    """The role tiers' signals: a buy of at least its tier's threshold."""
    return _fired(with_tier_signal(ctx), F.col("signal"), F.col("confidence"))


def tier_signal(tier: str) -> Callable[[Context], DataFrame]:
    least, confidence, _, signal = TIERS[tier]
    return lambda ctx: _fired(ctx.strict.where((F.col("tier") == tier) & (F.col("value") >= least)), signal, confidence)


def tier_sweep(ctx: Context, factors: list[float]) -> DataFrame:
    """Tier firings with every tier's threshold times each factor, in one pass: rows (fingerprint, ticker, tier, signal, factor, fired_at)."""
    of = lambda place: lookup(F.col("tier"), {t: v[place] for t, v in TIERS.items()})
    grid = F.explode(F.filter(F.array(*[F.lit(float(f)) for f in factors]), lambda f: F.col("value") >= of(0) * f))
    return ctx.strict.where(of(0).isNotNull()).select("fingerprint", "ticker", "tier", of(3).alias("signal"), grid.alias("factor"), F.col("announced").alias("fired_at"))


def other_buyers(buys: DataFrame, of: DataFrame, days: int = 30) -> DataFrame:
    """Pairs (fingerprint, other_fp, other_director): another director's buy of the ticker within ``days``, visible at announcement.

    Dates are dealt into buckets of ``days``; a buy meets the own and the two
    neighbouring buckets only, so a ticker's history is not paired with itself.
    """
    day = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    left = of.select("fingerprint", "ticker", "director", "dt", "announced", F.explode(F.array(*[F.floor(day / days) + k for k in (-1, 0, 1)])).alias("b"))
    right = buys.select(
        "ticker", F.floor(day / days).alias("b"), F.col("fingerprint").alias("other_fp"), F.col("director").alias("other_director"),
        F.col("dt").alias("other_dt"), F.col("announced").alias("other_announced"),
    )
    near = (F.abs(F.datediff("dt", "other_dt")) <= days) & (F.col("other_announced") <= F.col("announced")) & (F.col("director") != F.col("other_director"))
    return left.join(right, ["ticker", "b"]).where(near).select("fingerprint", "ticker", "other_fp", "other_director", "other_dt")


def _first_seen(buys: DataFrame) -> DataFrame:
    """Rows (ticker, director, day, seen): when each day's buying by a director was first announced."""
    whole = buys.where("ticker IS NOT NULL AND director IS NOT NULL AND dt IS NOT NULL AND announced IS NOT NULL")
    return whole.groupBy("ticker", "director", F.datediff("dt", F.lit("1970-01-01").cast("date")).alias("day")).agg(F.min("announced").alias("seen"))


def _asked(of: DataFrame) -> DataFrame:
    """Rows (ticker, dt, announced, day): what buys with a director see depends on nothing else, so a ticker asks as often as the calendar allows at most."""
    day = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    return of.where("director IS NOT NULL AND dt IS NOT NULL").select("ticker", "dt", "announced").distinct().withColumn("day", day)


def other_counts(buys: DataFrame, of: DataFrame, days: int = 30) -> DataFrame:
    """Rows (ticker, dt, announced, others) for the buys ``of``, which are among ``buys``: how many other directors bought within ``days``, visible at announcement.

    No pairs of buys: around a director's days there are spans in which the first announcement within reach is the same.
    Equal spans are counted, then brought down to a count per ticker, day and first announcement; a running sum over the
    announcements gives the directors visible. Windows hold a director's days in a ticker, then a day's announcements.
    """
    turn = lambda at, seen: F.struct(at.alias("day"), seen.alias("seen"), seen.isNull().alias("turn"))
    none = F.lit(None).cast("date")
    own = _first_seen(buys).withColumn("seen", F.col("seen").cast("date"))
    points = own.select("ticker", "director", F.explode(F.array(turn(F.col("day") - days, none), turn(F.col("day"), F.col("seen")), turn(F.col("day") + days + 1, none))).alias("p")).select("ticker", "director", "p.*")
    order = Window.partitionBy("ticker", "director").orderBy("day")
    points = points.withColumn("seen", F.min("seen").over(order.rangeBetween(-days, days))).where("turn")
    spans = points.withColumn("stop", F.lead("day").over(order)).where("seen IS NOT NULL AND stop > day")
    spans = spans.groupBy("ticker", "day", "stop", "seen").agg(F.count(F.lit(1)).alias("n"))
    daily = spans.select("ticker", F.explode(F.sequence(F.col("day"), F.col("stop") - 1)).alias("day"), "seen", "n").groupBy("ticker", "day", "seen").agg(F.sum("n").alias("n"))
    asked = _asked(of)
    kinds = dict(asked.dtypes)
    both = daily.select("ticker", "day", "seen", "n", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("dt", "announced")]).unionByName(
        asked.select("ticker", "day", F.col("announced").cast("date").alias("seen"), F.lit(0).cast("long").alias("n"), "dt", "announced")
    )
    upto = Window.partitionBy("ticker", "day").orderBy("seen").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("others", F.sum("n").over(upto) - 1).where("dt IS NOT NULL").select("ticker", "dt", "announced", "others")


def nearest_other(buys: DataFrame, of: DataFrame, days: int) -> DataFrame:
    """Rows (ticker, dt, announced, gap) for the buys ``of``, which are among ``buys``: days to the nearest buy of another director within ``days``, visible at announcement.

    No pairs of buys: of each ticker and day the first announcement, its director and the first of any other director tell
    whether there is another. If a buy's own day shows one director only, that is its own; so days meet days.
    """
    first = F.row_number().over(Window.partitionBy("ticker", "day").orderBy("seen", "director"))
    two = _first_seen(buys).withColumn("place", first).where("place <= 2")
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    daily = two.groupBy("ticker", "day").agg(at(1, "director").alias("who"), at(1, "seen").alias("seen"), at(2, "seen").alias("next_seen"))
    asked = _asked(of).join(daily.select("ticker", "day", F.col("who").alias("own")), ["ticker", "day"])
    left = asked.withColumn("b", F.explode(F.array(*[F.floor(F.col("day") / days) + k for k in (-1, 0, 1)])))
    right = daily.select("ticker", F.floor(F.col("day") / days).alias("b"), F.col("day").alias("other_day"), "who", "seen", "next_seen")
    gap = F.abs(F.col("day") - F.col("other_day"))
    visible = F.when(F.col("who") == F.col("own"), F.col("next_seen")).otherwise(F.col("seen")) <= F.col("announced")
    return left.join(right, ["ticker", "b"]).where((gap <= days) & visible).groupBy("ticker", "dt", "announced").agg(F.min(gap).alias("gap"))


def cluster_buy(ctx: Context) -> DataFrame:
    pairs = other_buyers(ctx.buys, ctx.strict).select("fingerprint").distinct()
    return _fired(ctx.strict.join(pairs, "fingerprint", "left_semi"), "s1_cluster_buy", "high")


def first_time_buy(ctx: Context) -> DataFrame:
    """No buy by the director in the ticker announced before."""
    first = ctx.buys.groupBy("director", "ticker").agg(F.min("announced").alias("announced"))
    return _fired(ctx.strict.join(first, ["director", "ticker", "announced"], "left_semi"), "f1_first_time_buy", "med")


def lone_conviction(ctx: Context, least: float = 200_000, days: int = 30, back: int = 60) -> DataFrame:
    """A large buy that no other director shares, unless the price has just slipped."""
    big = ctx.strict.where(F.col("value") >= least)
    order = Window.partitionBy("ticker").orderBy("dt")
    trail = ctx.prices.withColumn("ret", F.col("close") / F.lag("close", back).over(order) - 1)
    ret = F.col("found.ret")
    seen = last_until(big, trail, "announced", take=["ret"]).where(ret.isNotNull() & ~ret.between(-0.10, -0.02))
    alone = seen.join(other_buyers(ctx.buys, big, days).select("fingerprint").distinct(), "fingerprint", "left_anti")
    return _fired(alone, "b1_lone_conviction_buy", "high")


def lone_sweep(ctx: Context, leasts: list[float], windows: list[int], back: int = 60) -> DataFrame:
    """Lone large buys under every threshold and window, in one pass: rows (fingerprint, ticker, least, days, fired_at).

    How far the nearest other buyer is settles all windows at once.
    """
    big = ctx.strict.where(F.col("value") >= min(leasts))
    gaps = nearest_other(ctx.buys, big, max(windows))
    order = Window.partitionBy("ticker").orderBy("dt")
    trail = ctx.prices.withColumn("ret", F.col("close") / F.lag("close", back).over(order) - 1)
    ret = F.col("found.ret")
    seen = last_until(big, trail, "announced", take=["ret"]).where(ret.isNotNull() & ~ret.between(-0.10, -0.02)).join(gaps, ["ticker", "dt", "announced"], "left")
    seen = seen.withColumn("gap", F.when(F.col("director").isNotNull(), F.col("gap")))
    grid = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("least"), F.lit(d).alias("days")) for v in leasts for d in windows]))
    fits = (F.col("value") >= F.col("g.least")) & (F.col("gap").isNull() | (F.col("gap") > F.col("g.days")))
    return seen.withColumn("g", grid).where(fits).select("fingerprint", "ticker", "g.least", "g.days", F.col("announced").alias("fired_at"))


def crowd_windows(buys: DataFrame, least: int = 4, days: int = 30, hold: int = 60) -> DataFrame:
    """Merged suppression windows (ticker, start, stop): ``least`` distinct directors within ``days`` suppress for ``hold`` days."""
    day = F.datediff("announced", F.lit("1970-01-01").cast("date"))
    rows = buys.withColumn("day", day)
    counts = distinct_in_reach(rows, ["ticker"], "director", "day", 0, days).where(F.col("n") >= least)
    # one row a day; between buys the count only falls, so days without one start nothing
    starts = counts.join(rows.select("ticker", "day").distinct(), ["ticker", "day"], "left_semi").select("ticker", "day")
    ordered = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    merged = starts.withColumn("new", F.when(F.col("day") <= F.max("day").over(ordered) + hold, 0).otherwise(1))
    merged = merged.withColumn("island", F.sum("new").over(Window.partitionBy("ticker").orderBy("day")))
    epoch = F.lit("1970-01-01").cast("date")
    return merged.groupBy("ticker", "island").agg(F.min("day").alias("a"), (F.max("day") + hold).alias("b")).select(
        "ticker", F.date_add(epoch, F.col("a")).alias("start"), F.date_add(epoch, F.col("b")).alias("stop")
    )


def split_by_crowds(fired: DataFrame, windows: DataFrame) -> DataFrame:
    """Column suppressed: whether the firing lies in a suppression window of its ticker."""
    w = windows.select(F.col("ticker").alias("wt"), "start", "stop")
    hit = fired.join(w, (F.col("ticker") == F.col("wt")) & F.col("fired_at").between(F.col("start"), F.col("stop")), "left_semi")
    return fired.join(hit.select("fingerprint", "signal", F.lit(True).alias("suppressed")).distinct(), ["fingerprint", "signal"], "left").withColumn(
        "suppressed", F.coalesce("suppressed", F.lit(False))
    )


def combo(fired: DataFrame) -> DataFrame:
    """Cluster and senior executive on the same dealing."""
    senior = [TIERS[t][3] for t in SENIOR]
    both = fired.groupBy("fingerprint", "ticker", "fired_at").agg(
        F.max((F.col("signal") == "s1_cluster_buy").cast("int")).alias("s"), F.max(F.col("signal").isin(senior).cast("int")).alias("t")
    )
    return both.where("s = 1 AND t = 1").select("fingerprint", "ticker", F.lit("t0_cluster_combo").alias("signal"), F.lit("high").alias("confidence"), "fired_at")


#: Signals in the order of evaluation; the combination comes last.
REGISTRY: dict[str, Callable[[Context], DataFrame]] = {
    **{v[3]: tier_signal(t) for t, v in TIERS.items()},
    "s1_cluster_buy": cluster_buy,
    "f1_first_time_buy": first_time_buy,
    "b1_lone_conviction_buy": lone_conviction,
}


def best_tier(fired: DataFrame) -> DataFrame:
    """Of the tier signals on a dealing only the best stays; others stay."""
    rank = lookup(F.col("signal"), {v[3]: v[2] for v in TIERS.values()})
    ranked = fired.withColumn("rank", rank)
    best = Window.partitionBy("fingerprint", F.col("rank").isNotNull()).orderBy("rank")
    return ranked.withColumn("rn", F.row_number().over(best)).where("rank IS NULL OR rn = 1").drop("rank", "rn")


def evaluate(dealings: DataFrame, prices: DataFrame) -> DataFrame:
    """All signals: suppression by crowds, best tier per dealing, then the combination."""
    ctx = context(dealings, prices)
    others = cluster_buy(ctx).unionByName(first_time_buy(ctx)).unionByName(lone_conviction(ctx))
    fired = split_by_crowds(tier_signals(ctx).unionByName(others), crowd_windows(ctx.buys)).where("NOT suppressed").drop("suppressed")
    kept = best_tier(fired)
    return kept.unionByName(combo(kept))

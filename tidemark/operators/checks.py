"""Data-quality operators: each returns the rows, counts or classes that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parity(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: left_only, right_only, differs or same."""
    a = left.select(F.col(key), F.lit(1).alias("_a"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    b = right.select(F.col(key), F.lit(1).alias("_b"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))
    state = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(same, "same").otherwise("differs")
    return a.join(b, key, "full").select(key, state.alias("parity"))


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


#: The limits of the plausibility rules.
LIMITS = {"least_value": 1, "few_shares": 100, "low_price": 1, "high_price": 200, "high_value": 100e6, "dated_value": 100}


def plausibility(block_allowed: list[str] = (), trust_allowed: list[str] = (), limits: dict[str, float] = LIMITS) -> Column:
    """Reasons why a row (type, shares, price, value, ticker) is implausible; R1 to R4 reject, R5 warns."""
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kind, listed = F.col("type"), lambda names: F.col("ticker").isin(*names, "")
    like_a_date = known("shares").between(1, 31) | known("shares").between(1990, 2099)
    rules = {
        "R1_sub_pound_value": (known("value") < limits["least_value"]) & ~kind.isin("GRANT", "EXERCISE", "SIP"),
        "R2_tiny_shares_low_price": (kind != "SIP") & (known("price") < limits["low_price"]) & (known("shares") < limits["few_shares"]),
        "R3_price_too_high": ~listed(trust_allowed) & (known("price") > limits["high_price"]),
        "R4_excessive_value": ~listed(block_allowed) & (known("value") > limits["high_value"]),
        "R5_date_component_in_shares": like_a_date & (known("value") < limits["dated_value"]),
    }
    return reasons([(broken, name) for name, broken in rules.items()])


# Dealing types, and what an added row must have.
TYPES = ("BUY", "SELL", "SELL_TAX", "EXERCISE", "GRANT", "SIP")
REQUIRED = ("date", "ticker", "director", "type", "shares")


def field_errors(edits: DataFrame, sectors: list[str]) -> Column:
    """What is wrong with the fields of an edit (action, and text columns for its fields); nothing for a rejection.

    Null is a field that is not given. Only an added row must give all required ones.
    """
    has = set(edits.columns)
    given = lambda c: F.col(c).isNotNull() if c in has else F.lit(False)
    empty = lambda c: F.trim(F.col(c)) == ""
    number = lambda c: F.col(c).try_cast("double")
    rules = [((F.col("action") == "add") & (~given(c) | (empty(c) if c in has else F.lit(False))), f"{c}_required") for c in REQUIRED]
    rules.append((given("type") & ~F.col("type").isin(*TYPES), "type_unknown"))
    for c in ("shares", "price", "value"):
        if c in has:
            rules += [(given(c) & number(c).isNull(), f"{c}_not_numeric"), (number(c) < 0, f"{c}_negative")]
    rules.append((number("shares") != F.floor(number("shares")), "shares_not_whole"))
    rules.append((given("date") & ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_not_iso"))
    rules += [(given(c) & empty(c), f"{c}_empty") for c in ("ticker", "director", "company") if c in has]
    if "sector" in has:
        rules.append((given("sector") & (F.col("sector") != "") & ~F.col("sector").isin(*sectors), "sector_unknown"))
    return F.when(F.col("action") == "reject", F.array().cast("array<string>")).otherwise(reasons(rules))


def date_audit(dealings: DataFrame, firings: DataFrame, as_of: str, limits: tuple[int, int, int, int] = (1, 7, 1095, 365)) -> tuple[DataFrame, DataFrame]:
    """(counts, violations) of the date rules I1 to I5, for rows whose dates are text.

    I1 both dates are ISO days; I2 announced at most a day after ``as_of``; I3 traded at
    most a week after the announcement; I4 at most three years before; I5 a firing is
    within a year of its dealing. Violations are (rule, fingerprint, dt, announced).
    """
    ahead, after, before, around = limits
    iso = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = lambda c: F.when(iso(c), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date"))
    bad = lambda c: F.coalesce(c, F.lit(False))
    rows = dealings.select("fingerprint", "dt", "announced", day("dt").alias("_d"), day("announced").alias("_a"))
    rules = {
        "I1_format": F.col("_d").isNull() | F.col("_a").isNull(),
        "I2_future": bad(F.col("_a") > F.date_add(F.lit(as_of).cast("date"), ahead)),
        "I3_after_filing": bad(F.col("_d") > F.date_add("_a", after)),
        "I4_stale": bad(F.col("_d") < F.date_sub("_a", before)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    own = rows.select(F.explode(found).alias("rule"), "fingerprint", "dt", "announced")
    fired = firings.select("fingerprint", "fired_at").join(rows, "fingerprint").where(F.abs(F.datediff("fired_at", "_d")) > around)
    violations = own.unionByName(fired.select(F.lit("I5_firing").alias("rule"), "fingerprint", "dt", "announced"))
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    per = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n_failed"))
    names = rows.sparkSession.createDataFrame([(r,) for r in [*rules, "I5_firing"]], "rule string")
    counts = names.join(per, "rule", "left").crossJoin(n).select("rule", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), "n_rows")  # five rows and one
    return counts, violations


def first_copies(rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """One row of each key, with how many there were; of different rows the first by all columns."""
    whole = F.struct(*rows.columns)
    out = rows.groupBy(F.col(key).alias("_key")).agg(F.min(whole).alias("_row"), F.count(F.lit(1)).alias("copies"))
    return out.select("_row.*", "copies")


def field_diff(rows: DataFrame, source: DataFrame, key: str, numbers: dict[str, float], texts: list[str]) -> DataFrame:
    """One row per key and field: MATCH, MINOR, MAJOR, FAILED (no source) or AMBIGUOUS (several source rows that differ).

    Texts are compared trimmed, whatever their case; a number off by at most its tolerance (a share) is MINOR, and so is
    a text that contains the other.
    """
    fields = [*numbers, *texts]
    seen = source.groupBy(key).agg(*[F.min(c).alias(f"_s_{c}") for c in fields], *[(F.countDistinct(c) > 1).alias(f"_m_{c}") for c in fields], F.lit(True).alias("_found"))
    both = rows.select(key, *fields).join(seen, key, "left")

    def verdict(c: str) -> Column:
        a, b = F.col(c), F.col(f"_s_{c}")
        if c in numbers:
            same, close = F.round(a, 4).eqNullSafe(F.round(b, 4)), F.coalesce(F.abs(b / a - 1) <= numbers[c], F.lit(False))
        else:
            a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
            same, close = a.eqNullSafe(b), F.coalesce(a.contains(b) | b.contains(a), F.lit(False))
        return F.when(F.col("_found").isNull(), "FAILED").when(F.col(f"_m_{c}"), "AMBIGUOUS").when(same, "MATCH").when(close, "MINOR").otherwise("MAJOR")

    return both.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), verdict(c).alias("verdict")) for c in fields])).alias("x")).select(key, "x.*")


def match_rates(diff: DataFrame) -> DataFrame:
    """Per field, the number of each verdict."""
    verdicts = ["MATCH", "MINOR", "MAJOR", "AMBIGUOUS", "FAILED"]
    return diff.groupBy("field").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in verdicts])


def bad_batches(results: DataFrame, least: int = 2) -> DataFrame:
    """Dates of one type that one fetch of a source wrote to many tickers."""
    return results.groupBy("report_date", "report_type", "source", F.to_date("fetched_at").alias("fetched")).agg(F.countDistinct("ticker").alias("n_tickers")).where(F.col("n_tickers") >= least)


def near_coverage(buys: DataFrame, dated: DataFrame, at: str, days: int = 90) -> DataFrame:
    """Tickers with a buy that has a row of ``dated`` within ``days`` of its announcement; dates are dealt into buckets as wide."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    asked = buys.select("ticker", day("announced").alias("a")).distinct().withColumn("b", F.explode(F.array(*[F.floor(F.col("a") / days) + k for k in (-1, 0, 1)])))
    known = dated.select("ticker", day(at).alias("d")).distinct().withColumn("b", F.floor(F.col("d") / days))
    return asked.join(known, ["ticker", "b"]).where(F.abs(F.col("a") - F.col("d")) <= days).select("ticker").distinct()


def cache_coverage(dealings: DataFrame, cached: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """(counts, largest): dealings with a filing at hand, without one, or without a link; and the largest that are not cached."""
    hit = cached.select(F.col("rns_id").alias("_hit")).distinct()
    rows = dealings.join(hit, F.col("rns_id") == F.col("_hit"), "left")
    state = F.when(F.col("rns_id").isNull(), "no_url").when(F.col("_hit").isNotNull(), "cached").otherwise("not_cached")
    rows = rows.withColumn("state", state).drop("_hit")
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts, rows.where("state = 'not_cached'").orderBy(F.desc("value"), "fingerprint").limit(top)


def price_recovery(price: Column, value: Column, shares: Column, cap: float = 500.0) -> Column:
    """The price, or value per share where it is missing and not above the cap."""
    back = value / F.nullif(shares, F.lit(0))
    return F.coalesce(price, F.when(back <= cap, back))


def year_as_shares(rows: DataFrame) -> DataFrame:
    """Rows whose shares look like a year; hard where it is the year of the deal."""
    return rows.where(F.col("shares").between(1990, 2099)).withColumn("hard", F.year("dt") == F.col("shares"))


def same_number(rows: DataFrame) -> DataFrame:
    """Rows whose price and shares are the same large number."""
    return rows.where("price > 1000 AND shares > 1000 AND abs(price - shares) < 0.5")


def reconciled_price(raw: Column, close: Column, kind: Column, value: Column, tolerance: float = 0.35) -> Column:
    """Struct (price, status): whether a price is in pounds or pence, judged by the market close."""
    near = lambda p: F.abs(p / close - 1) <= tolerance
    status = (
        F.when(close.isNull(), "no_market_price").when(near(raw), "ok_pounds").when(near(raw / 100), "corrected_pence")
        .when(kind.isin("GRANT", "EXERCISE") & (value <= 100e6), "ok_pounds").otherwise("unresolved_quarantine")
    )
    return F.struct(F.when(status == "corrected_pence", raw / 100).otherwise(raw).alias("price"), status.alias("status"))


def error_class(ratio: Column) -> Column:
    """Which power of ten a price is off the close by."""
    return (
        F.when(ratio.between(0.5, 2), "ok").when(ratio.between(5, 20) | ratio.between(0.05, 0.2), "10x").when(ratio.between(50, 200) | ratio.between(0.005, 0.02), "100x")
        .when(ratio.between(500, 2000) | ratio.between(0.0005, 0.002), "1000x").otherwise("extreme")
    )


def sample_strata(rows: DataFrame, strata: dict[str, tuple[Column, float]], size: int, key: str, seed: int = 1) -> DataFrame:
    """Rows (stratum, key): of each stratum (name -> condition, share) ``share * size`` rows, or all if it has fewer, in the order of a seeded hash.

    Strata may overlap; a row may be drawn for several. Each task keeps only the first rows of each stratum.
    """
    tags = F.array_compact(F.array(*[F.when(inside, F.struct(F.lit(name).alias("stratum"), F.lit(round(share * size)).alias("_most"))) for name, (inside, share) in strata.items()]))
    tagged = rows.withColumn("_tag", F.explode(tags)).select("_tag.*", key)
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    most = max([round(share * size) for _, share in strata.values()], default=0)
    ranked = tagged.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)
    return ranked.where("_rn <= _most").select("stratum", key)


def near_duplicates(dealings: DataFrame, days: int = 7, tolerance: float = 0.05) -> DataFrame:
    """Pairs (fingerprint, earlier_fp) of one director's dealings of like value within ``days``.

    Dates are dealt into buckets of ``days``, and a row meets its own and the bucket before only.
    """
    day = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    left = dealings.select("fingerprint", "director", "dt", "value", F.explode(F.array(F.floor(day / days), F.floor(day / days) - 1)).alias("b"))
    right = dealings.select(F.col("fingerprint").alias("earlier_fp"), "director", F.col("dt").alias("dt0"), F.col("value").alias("v0"), F.floor(day / days).alias("b"))
    earlier = (F.col("dt0") < F.col("dt")) | ((F.col("dt0") == F.col("dt")) & (F.col("earlier_fp") < F.col("fingerprint")))
    near = (F.datediff("dt", "dt0") <= days) & (F.abs(F.col("value") - F.col("v0")) <= tolerance * F.col("v0"))
    return left.join(right, ["director", "b"]).where(earlier & near).select("fingerprint", "earlier_fp").distinct()

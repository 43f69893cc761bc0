"""Roles, keys, names and row filters of dealings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Role patterns in order of precedence, with the bucket each names.
ROLE_BUCKETS = [
    (r"\bpca\b|closely associated|spouse|wife|husband|daughter|\bson\b|family trust|connected person", "PCA"),
    (r"founder", "Founder"),
    (r"regional|divisional|(chief executive|\bceo\b|managing director|president)[^,:]*[,:]", "Divisional"),
    (r"non[- ]?exec\w*( director)?[ ,(]+.*chair|non[- ]?exec\w* chair", "NonExecChair"),
    (r"non[- ]?exec|\bned\b|senior independent|supervisory board", "NED"),
    (r"chair", "Chair"),
    (r"chief executive|\bceo\b", "CEO"),
    (r"chief financial|\bcfo\b|financ\w* director", "CFO"),
    (r"chief \w+( \w+)? officer|\b(coo|cto|cmo|cro|chro|cco|cso|cio)\b", "OtherChief"),
    (r"secretary|general counsel|legal director", "CoSec"),
    (r"president|\b(svp|evp|vp)\b", "President"),
    (r"(executive|managing|commercial|development) director", "ExecDirector"),
    (r"^\s*(director\s*/\s*)?pdmr( of the company)?\s*$", "PDMR"),
    (r"^\s*director\s*$", "NED"),
]
# Bucket -> tier, and tier -> threshold, confidence, rank, signal.
BUCKET_TIERS = {
    "CEO": "T1a", "Founder": "T1a", "CFO": "T1b", "OtherChief": "T2", "ExecDirector": "T2", "Divisional": "T2", "President": "T2",
    "NED": "T3", "PDMR": "T4", "Other": "T4", "PCA": "T5", "CoSec": "T6", "Chair": "T7", "NonExecChair": "T7",
}
TIERS = {
    "T1a": (100_000, "high", 1, "t1a_ceo_founder_buy"), "T1b": (100_000, "high", 2, "t1b_cfo_buy"), "T7": (25_000, "med", 3, "t7_chair_buy"),
    "T2": (25_000, "med", 4, "t2_exec_buy"), "T3": (10_000, "med", 5, "t3_ned_buy"), "T5": (10_000, "low", 6, "t5_pca_buy"),
    "T6": (10_000, "low", 7, "t6_company_sec_buy"), "T4": (1_000, "low", 8, "t4_other_buy"),
}
SENIOR = ("T1a", "T1b", "T2")


def lookup(column: Column, table: dict) -> Column:
    """The value that a small fixed table has for the column."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), column)


def first_rule(column: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern that the column matches, whatever its case."""
    out = F.lit(otherwise)
    for pattern, name in reversed(rules):
        out = F.when(column.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def role_bucket(role: Column) -> Column:
    return first_rule(F.coalesce(role, F.lit("")), ROLE_BUCKETS, "Other")


def role_tier(role: Column) -> Column:
    return lookup(role_bucket(role), BUCKET_TIERS)


# Patterns of the older role classes, in order of precedence.
LEGACY_CLASSES = [
    (r"\b(chief\s+executive|chief\s+financial|c\.?e\.?o\.?|c\.?f\.?o\.?)\b", "CEO_CFO"),
    (r"\b(non[- ]?exec(?:utive)?(?:\s+director)?|\bned\b)\b", "NED"),
    (r"\b(chair(?:man|woman|person)?|chief\s+\w+\s+officer|executive\s+director|managing\s+director|group\s+(?:general\s+counsel|chief))\b", "EXEC"),
]
# Patterns of the three role groups, in order of precedence.
ROLE_GROUPS = [
    (r"\b(CEO|CFO|Chief Executive|Chief Financial)\b", "ceo_cfo"),
    (r"\b(Non[- ]?Executive|NED|Senior Independent)\b", "ned"),
    (r"\b(Chair|Chairman|Group|Executive|COO|CTO|CIO|COMMERCIAL OFFICER|OPERATING OFFICER)\b", "other_exec"),
]
# Sector names of the quote source, and those in use.
SECTORS = {
    "Basic Materials": "Materials", "Communication Services": "Communication Services", "Consumer Cyclical": "Consumer Discretionary", "Consumer Defensive": "Consumer Staples",
    "Energy": "Energy", "Financial Services": "Financials", "Healthcare": "Health Care", "Industrials": "Industrials", "Real Estate": "Real Estate", "Technology": "Information Technology",
    "Utilities": "Utilities",
}
# What a name cell that is no name begins with, and particles and letters after names.
NO_NAME = r"(?i)^(person closely associated|trustee of|pdmr|notifier|the company|director)\b"
PARTICLES = ("of", "the", "van", "de", "der", "von", "la", "le", "du", "da", "di")
POST_NOMINALS = ("CMG", "OBE", "CBE", "MBE", "KBE", "DSC", "PHD")


def legacy_role_class(role: Column) -> Column:
    """Chief executives and finance chiefs first, then non-executives, then executives."""
    return first_rule(F.coalesce(role, F.lit("")), LEGACY_CLASSES, "OTHER")


#: The role class that settles a group; a group's class comes right before its pattern.
ROLE_GROUP_CLASSES = {"ceo_cfo": "T1", "ned": "T3", "other_exec": "T2"}


def role_group(role: Column, role_class: Column | None = None) -> Column:
    """ceo_cfo, ned or other_exec by the first matching rule; null if none does. A group's class, if given, comes before its pattern."""
    known = F.upper(F.trim(F.coalesce(role_class, F.lit("")))) if role_class is not None else F.lit("")
    out = F.lit(None).cast("string")
    for pattern, group in reversed(ROLE_GROUPS):
        fits = (known == ROLE_GROUP_CLASSES[group]) | F.coalesce(role, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(fits, F.lit(group)).otherwise(out)
    return out


def sector(name: Column, table: dict[str, str] = SECTORS) -> Column:
    """The name in use; an unknown one stays."""
    return F.coalesce(lookup(name, table), name)


def valid_director(cell: Column) -> Column:
    """The name in a cell; null for boilerplate and for fragments of fewer than four characters."""
    name = F.trim(cell)
    bare = F.regexp_replace(name, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")
    return F.when(~name.rlike(NO_NAME) & (F.char_length(bare) >= 4), name)


def valid_role(cell: Column) -> Column:
    """The role in a cell, its first letter a capital; null for text that begins in mid-sentence or is longer than a title."""
    role = F.trim(cell)
    title = F.concat(F.upper(F.left(role, F.lit(1))), F.substring(role, 2, 80))
    return F.when((role != "") & ~role.rlike(r"^[,.;:]") & (F.char_length(role) <= 80), title)


def company_label(dealings: DataFrame, name: str = "company", at: str = "dt", tie: str = "fingerprint") -> DataFrame:
    """Per ticker: the most recent name that is not empty, and the most frequent one (of equals the first by name)."""
    named = dealings.withColumn("_name", F.trim(F.col(name))).where("_name <> ''")
    counts = named.groupBy("ticker", "_name").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(at, tie)).alias("_at"))
    most = F.min_by("_name", F.struct(-F.col("_n"), F.col("_name")))
    return counts.groupBy("ticker").agg(F.max_by("_name", "_at").alias("latest"), most.alias("most_frequent"))


def pay_bucket(status: Column, pay: Column, nominal: float = 1_000.0) -> Column:
    """ok, new_appointee, out_of_scope, extraction_fail, fee_waiver or nominal; only ok gives a multiple."""
    return (
        F.when(status == "new_appointee_no_disclosure", "new_appointee").when(status == "out_of_scope", "out_of_scope").when(status != "ok", "extraction_fail")
        .when(pay.isNull(), "extraction_fail").when(pay == 0, "fee_waiver").when(pay < nominal, "nominal").otherwise("ok")
    )


def effective_date(announced: str = "announced", traded: str = "dt") -> Column:
    return F.coalesce(F.col(announced), F.col(traded))


def iso_day(text: Column) -> Column:
    """A date from ISO, day-first or spelled-out text; null if none fits."""
    plain = F.regexp_replace(F.trim(text), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    plain = F.regexp_replace(plain, ",", "")
    shaped = [
        (r"^\d{4}-\d{2}-\d{2}", F.substring(plain, 1, 10), "yyyy-MM-dd"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", plain, "d/M/yyyy"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", plain, "d.M.yyyy"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", plain, "d MMM yyyy"),
        (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", plain, "d MMMM yyyy"),
    ]
    return F.coalesce(*[F.when(plain.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for p, t, f in shaped])


def _nfkc():
    import pandas as pd

    def fold(names: pd.Series) -> pd.Series:
        import unicodedata

        return names.map(lambda n: None if n is None else unicodedata.normalize("NFKC", n).casefold())

    fold.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return F.pandas_udf(fold, "string")


def director_key(name: Column) -> Column:
    """Compatibility-folded, case-folded name with single spaces; see ``with_director_key`` for names beyond Latin-1."""
    spaced = F.translate(name, "\u00a0\u2007\u2009\u202f\u3000", "     ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def with_director_key(rows: DataFrame, name: str, key: str = "director_key") -> DataFrame:
    """Column ``key``: the name in compatibility form (NFKC), case-folded, with single spaces.

    ASCII names, nearly all, are folded by built-in functions; each other distinct name goes through Python once.
    """
    plain = F.col(name).rlike(r"^[\x00-\x7f]*$")
    odd = rows.where(~plain).select(F.col(name).alias("_name")).distinct()
    folded = odd.select("_name", F.trim(F.regexp_replace(_nfkc()("_name"), r"(?U)\s+", " ")).alias("_folded"))
    out = rows.join(folded, F.col(name) == F.col("_name"), "left")
    return out.withColumn(key, F.when(plain, director_key(F.col(name))).otherwise(F.col("_folded"))).drop("_name", "_folded")


def display_name(name: Column) -> Column:
    """Title case by word, hyphenated part and apostrophe, with particles in lower case and letters after a name in capitals."""
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 99))
    parts = lambda w, mark: F.array_join(F.transform(F.split(w, mark), capital), mark)

    def word(w: Column, i: Column) -> Column:
        shaped = F.when(w.contains("-"), parts(w, "-")).when(w.contains("'"), parts(w, "'")).otherwise(capital(w))
        return F.when((i > 0) & w.isin(*PARTICLES), w).when(F.upper(w).isin(*POST_NOMINALS), F.upper(w)).otherwise(shaped)

    return F.array_join(F.transform(F.split(director_key(name), " "), word), " ")


def page_name(ticker: Column) -> Column:
    return F.regexp_replace(F.upper(ticker), r"[^A-Z0-9.]", "_")


def corporate_holder(name: Column, role: Column) -> Column:
    """Whether a dealer is a company or trust, or closely associated."""
    return (role_bucket(role) == "PCA") | name.rlike(r"(?i)\b(ltd|plc|trust|limited|llp|inc|nominees|holdings|fund|capital)\b")


def value_bucket(value: Column) -> Column:
    return F.when(value >= 500_000, "500k+").when(value >= 100_000, "100k-500k").when(value >= 25_000, "25k-100k").when(value >= 1_000, "1k-25k")


def cap_class(cap: Column) -> Column:
    return F.when(cap < 50e6, "micro").when(cap < 500e6, "small").when(cap < 1e9, "mid").when(cap >= 1e9, "large")


def universe(dealings: DataFrame, meta: DataFrame, as_of: str | None = None) -> DataFrame:
    """Announced dealings of issuers with a benchmark, visible at ``as_of``; the reference table is small and joins by broadcast if it is."""
    seen = dealings.where("announced IS NOT NULL")
    if as_of:
        seen = seen.where(F.col("announced") <= F.lit(as_of).cast("date"))
    return seen.join(meta.where("benchmark_symbol IS NOT NULL"), "ticker")


def issuer_tickers(issuers: DataFrame, names: DataFrame, mapped: DataFrame, override: DataFrame) -> DataFrame:
    """Tickers of issuers (issuer, name) by name whatever its case and spaces, else by a map, else by an override, with the method; null if none knows it.

    ``names`` has name and ticker, the two others issuer and ticker; each is a small table and joins by broadcast if it is.
    """
    known = names.select(director_key(F.col("name")).alias("_k"), F.col("ticker").alias("_name")).groupBy("_k").agg(F.min("_name").alias("_name"))
    out = issuers.join(known, director_key(F.col("name")) == F.col("_k"), "left").drop("_k")
    for table, column in ((mapped, "_map"), (override, "_override")):
        out = out.join(table.groupBy("issuer").agg(F.min("ticker").alias(column)), "issuer", "left")
    method = F.when(F.col("_name").isNotNull(), "name").when(F.col("_map").isNotNull(), "map").when(F.col("_override").isNotNull(), "override")
    return out.select("issuer", F.coalesce("_name", "_map", "_override").alias("ticker"), method.alias("method"))


LOOKBACKS = {"90d": 90, "183d": 183, "365d": 365, "all": None}


def lookback_rows(df: DataFrame, at: str, as_of: str) -> DataFrame:
    """A row for each lookback whose window holds the row's date (the last day included)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(at))
    inside = [F.when((age >= 0) & (F.lit(True) if d is None else age <= d), F.lit(n)) for n, d in LOOKBACKS.items()]
    return df.withColumn("lookback", F.explode(F.array_compact(F.array(*inside))))

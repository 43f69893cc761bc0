"""Filings to dealing rows: text, dates, prices and kinds from HTML by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import first_rule, iso_day

# Phrases that tell what a transaction was, in order; then phrases of awards and plans.
KINDS = [
    (r"sell to cover|cover (the )?tax|tax liabilit", "SELL_TAX"), (r"exercise", "EXERCISE"), (r"grant|award|vest", "GRANT"), (r"share incentive plan|\bsip\b", "SIP"),
    (r"\bs(ale|old|ell)\b|disposal", "SELL"), (r"purchase|bought|acqui|\bbuy\b", "BUY"),
]
NON_BUY = (
    r"(?i)vesting of an award|restricted share plan|\bRSP\b|long term incentive plan|\bLTIP\b|performance share plan|\bPSP\b|deferred bonus plan|sharesave|\bSAYE\b|save[- ]as[- ]you[- ]earn"
    r"|scrip dividend|dividend reinvestment|\bDRIP\b|share incentive plan|\bSIP\b|grant of (a|an|conditional|options?) (award|conditional)|grant of options?|exercise of options?"
    r"|nil[- ]cost option|vested|award of \d+|employee benefit trust"
)
# Phrases of a purchase in the market, and of any purchase.
STRICT_BUY = r"(?i)on[- ]market purchase of (ordinary )?shares"
PURCHASE = r"(?i)purchase of (ordinary )?shares"


def html_text(html: Column) -> Column:
    """Text of a page: scripts dropped, cell and paragraph ends kept as line breaks, entities resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/td|/tr|/div|/li|/h[1-6])[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&pound;", "£"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def labelled_date(text: Column, label: str = "date of (the )?transaction") -> Column:
    """The date after a label; null without the label."""
    shape = r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}|\d{1,2}(?:st|nd|rd|th)? [A-Za-z]+,? \d{4})"
    return iso_day(F.nullif(F.regexp_extract(text, rf"(?i){label}\W{{0,20}}{shape}", 2), F.lit("")))


def price(text: Column) -> Column:
    """Struct (price, unit): pounds as given, pence divided by 100; other currencies flagged and not converted."""
    pounds = F.regexp_extract(text, r"£\s?([0-9][0-9,]*\.?[0-9]*)", 1)
    pence = F.regexp_extract(text, r"(?i)\b([0-9][0-9,]*\.?[0-9]*)\s?(p|pence)\b", 1)
    other = F.regexp_extract(text, r"(?i)(?:US\$|\$|€|EUR|USD)\s?([0-9][0-9,]*\.?[0-9]*)", 1)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    return F.struct(
        F.when(pounds != "", number(pounds)).when(pence != "", number(pence) / 100).when(other != "", number(other)).alias("price"),
        F.when(pounds != "", "GBP").when(pence != "", "GBX").when(other != "", "foreign").alias("unit"),
    )


def kind(text: Column) -> Column:
    return first_rule(text, KINDS)


def buy_strictness(text: Column, paid: Column) -> Column:
    """STRICT_BUY, MIXED, NON_BUY_ONLY or UNKNOWN."""
    buy = text.rlike(STRICT_BUY) | (text.rlike(PURCHASE) & (paid > 0))
    non = text.rlike(NON_BUY)
    return F.when(buy & non, "MIXED").when(buy, "STRICT_BUY").when(non, "NON_BUY_ONLY").otherwise("UNKNOWN")


def rns_id(url: Column) -> Column:
    """The last path part of a URL, if it is 5 to 12 digits."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.rlike(r"^\d{5,12}$"), last)


def fingerprint(*columns: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256), 1, 16)


def roll_up(tranches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: total shares, price weighted by shares, latest date."""
    return tranches.groupBy(*keys).agg(
        F.sum("shares").alias("shares"), (F.sum(F.col("price") * F.col("shares")) / F.sum("shares")).alias("price"), F.max("dt").alias("dt"), F.count(F.lit(1)).alias("n_tranches")
    )


def resulting_holding(text: Column, shares: Column, bought: Column) -> Column:
    """The holding after the deal; years are not holdings, and a buyer holds at least what was bought."""
    found = F.regexp_replace(F.regexp_extract(text, r"(?i)(?:holding|interest)[^.\n]{0,60}?([0-9][0-9,]{2,})", 1), ",", "").try_cast("long")
    return F.when(~found.between(1990, 2099) & (~bought | (found >= shares)), found)


# What separates notifications in one filing, a person's name, what begins a person's details, and headlines that are out of scope.
NOTIFICATION = r"(?i)\bnotification\s+\d+\s+of\s+\d+\b"
PERSON = r"(?m)^\s*(?:[a1][.)]\s*)?(?i:(?:full )?name(?:\s+of\s+(?:the\s+)?(?:pdmr|person|director))?)\s*[:.]?\s*((?:(?:Mr|Mrs|Ms|Dr|Sir|Dame|Lord)\.? )?\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)+)"
DETAILS = r"(?im)^\s*1[.)]?\s*details of the person\b"
OUT_OF_SCOPE = r"(?i)employee (benefit|share ownership) trust|\bEBT\b"


def people(text: Column) -> Column:
    """The names that a filing's text gives after name labels, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(1)), lambda n: F.trim(n)))


def each_person(text: Column) -> Column:
    """The names of a filing's people, in order: each part of details is a person's own, so namesakes stay two; what stands before adds the names that no part has."""
    parts = F.split(text, DETAILS)
    own = F.flatten(F.transform(F.slice(parts, 2, 1 << 30), people))
    return F.concat(F.array_except(people(parts[0]), own), own)


def bundled(filings: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(single, review): filings of several people, or of several numbered notifications, go to review with the names."""
    named = filings.withColumn("names", each_person(F.col(text)))
    parts = F.regexp_count(F.col(text), F.lit(NOTIFICATION))
    many = (F.size("names") > 1) | (parts > 1)
    warning = F.concat(F.lit("bundled_multi_pdmr: "), F.array_join("names", "; "))
    return named.where(~many), named.where(many).withColumn("warning", warning)


def in_scope(headline: Column) -> Column:
    """Whether a headline may be a director's dealing: all but those on the denylist."""
    return ~F.coalesce(headline, F.lit("")).rlike(OUT_OF_SCOPE)


#: Warnings by what can be done about them; the first group that applies counts.
PENDING = {
    "recoverable": ("missing_price", "missing_value", "data_quirk", "multi_tranche", "corporate_action"),
    "blocked": ("bundled_multi_pdmr", "foreign_currency", "missing_date", "bad_price", "unknown_kind"),
}


def pending_bucket(warnings: Column) -> Column:
    """recoverable, blocked or advisory."""
    out = F.lit("advisory")
    for name, members in reversed(PENDING.items()):
        out = F.when(F.arrays_overlap(warnings, F.array(*[F.lit(m) for m in members])), F.lit(name)).otherwise(out)
    return out


BLOCKING = ("missing_date", "missing_name", "missing_shares", "bad_price", "unknown_kind", "foreign_currency", "bundled_multi_pdmr", "year_as_shares")


def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ingested, pending): rows whose warnings block wait, one by one; advisory warnings do not.

    Whatever the warnings, a row without a kind waits, and so does one without a positive value, or price where the rows
    have one, unless it is a grant or an exercise.
    """
    free = F.coalesce(F.col("kind").isin("GRANT", "EXERCISE"), F.lit(False))
    paid = F.lit(True)
    for c in ("price", "value"):
        if c in rows.columns:
            paid = paid & F.coalesce(F.col(c) > 0, F.lit(False))
    marked = F.coalesce(F.arrays_overlap("warnings", F.array(*[F.lit(b) for b in BLOCKING])), F.lit(False))
    blocks = marked | F.col("kind").isNull() | (~free & ~paid)
    return rows.where(~blocks), rows.where(blocks)

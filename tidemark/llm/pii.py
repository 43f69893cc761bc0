"""Personal data by candidate gradient boosting (DataFrame and ML functions only).

Base spans (email, ip, card, phone) come from fixed patterns and checks, and
always stay. High-recall generators propose further, overlapping spans: anything
around an ``@``, dotted numbers, digit groups with and without separators,
groups shaped like a phone number, and long mixed runs of letters and digits.
For each kind boosted trees learn from context features (neighbouring
characters, a key word before) and format features: lengths, separators, groups,
how many different characters there are, and the kinds' own checks (Luhn sum,
limit of octets), so that a number of 16 digits that fails its check, written
just like one that passes, is told apart from it.

Labels are positive and unlabelled: a base span is a sure positive of its kind,
any other proposal may or may not be one. So the trees' probability of being
labelled is divided by what labelled spans get on average in documents that were
not trained on, which gives the probability of being of the kind. The threshold
of a kind is where this reaches ``least``. For secrets (keys and tokens,
which have no base pattern) the sure positives are quoted runs that are assigned
to some word, whatever its language, and look random; nothing around a run is a
feature, so one that stands anywhere is found by its shape. Selected proposals that overlap no base span are
added, overlapping ones as one span with the best one's kind: ``email_like``,
``ip_like``, ``card_like``, ``phone_like`` and ``secret``.

Each kind trains on a bounded, documented sample (``train_spans`` positives and
three times as many others in expectation).

Positions come from splitting the text at a pattern's matches: the lengths of
gaps and matches, in code points, are summed along the document by a window.
Patterns are possessive and look behind, so that no run of characters is read
again from each of its places; all work is in proportion to the text.

Defined results: null text counts as empty and has no spans; repeated rows are
searched each; an empty table gives an empty result; a kind without labelled and
other proposals in both halves of the documents adds nothing; other columns are
ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOCATOR, located, stored, whole_text, work_dir

# The kinds in their order, each with its pattern and a cheap test that any match passes.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{14}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
PROPOSALS = {
    "around_at": (r"(?<![^\s@])[^\s@]++@[^\s@]++", r"@"),
    "dotted": (r"(?<![0-9.])[0-9]++(?:\.[0-9]++)++", r"[0-9]\.[0-9]"),
    "groups": (r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++", r"[0-9][0-9\x20().-]{5}"),
    "digits": (r"(?<![0-9])[0-9]{7,}+", r"[0-9]{7}"),
    "phone_shape": (r"(?<![0-9+])\+?[0-9]{1,4}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"[0-9][0-9\x20().-]{5}"),
    "mixed": (r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16}"),
}
KEY_WORD = r"(?i)(mail|phone|tel|call|mobile|fax|card|visa|account|ip|host|server|addr|contact)\W{0,3}$"
#: An assignment of a quoted value to any word.
ASSIGNED = r"[\p{L}\p{N}_]\s{0,2}[:=]{1,2}\s{0,2}[\"']$"
ADDED = {"email": "email_like", "ip": "ip_like", "card": "card_like", "phone": "phone_like", "secret": "secret"}
FORMAT = ["length", "digits", "letters", "capitals", "groups", "spaces", "dots", "hyphens", "parens", "plus", "ats", "odd", "turns", "kinds", "luhn", "octets"]
CONTEXT = ["joined_before", "joined_after", "sign_before", "quoted", "key_word"]
#: What the trees of a kind look at. What stands before a secret is its label; how a card is written is what its base pattern fixes.
FEATURES = {k: [*FORMAT, *CONTEXT] for k in ADDED} | {"card": ["digits", "letters", "luhn", *CONTEXT], "secret": FORMAT}
_NEAR = 16


def _matches(text: Column, kind: str, pattern: str, test: str) -> Column:
    """Leftmost, non-overlapping matches and the gaps around them: kind, place, gap length, gap ends, match (null for the last gap)."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def row(x: Column, i: Column) -> Column:
        gap = x["gap"]
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(gap).cast("long").alias("gap"), F.left(gap, F.lit(1)).alias("head"), F.right(gap, F.lit(_NEAR)).alias("tail"),
            x["match"].alias("match"),
        )

    empty = F.array().cast("array<struct<kind:string,i:int,gap:bigint,head:string,tail:string,match:string>>")
    return F.when(text.rlike(test) & text.rlike(pattern), F.transform(both, row)).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes Luhn's test."""
    from_right = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(from_right, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    places = F.sequence(F.lit(1), F.char_length(digits))
    return F.aggregate(places, F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern passes its kind's check."""
    digits = _digits(match)
    return (
        F.when(kind == "ip", F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
        .when(kind == "card", F.char_length(digits).between(16, 19) & _luhn(F.when(F.char_length(digits) <= 19, digits).otherwise("0")))
        .when(kind == "phone", F.char_length(digits).between(8, 15))
        .otherwise(kind == "email")
    )


def all_spans(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (LOCATOR, kind, start, end, match, before, after) of every match; places in code points, end exclusive."""
    text = F.col("text")
    # no kind does without a digit or an @, and most texts have neither
    found = rows.where(text.rlike("[0-9@]")).select(*LOCATOR, F.explode(F.flatten(F.array(*[_matches(text, k, p, t) for k, (p, t) in patterns.items()]))).alias("m"))
    found = found.select(*LOCATOR, "m.*").repartition(*LOCATOR)
    along = Window.partitionBy(*LOCATOR, "kind").orderBy("i")
    through = F.sum(F.col("gap") + F.coalesce(F.char_length("match"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(through, F.lit(0)) + F.col("gap")
    before = F.right(F.concat(F.coalesce(F.lag("match").over(along), F.lit("")), "tail"), F.lit(_NEAR))
    after = F.left(F.concat(F.lead("head").over(along), F.coalesce(F.lead("match").over(along), F.lit(""))), F.lit(1))
    placed = found.select(*LOCATOR, "kind", start.alias("start"), "match", before.alias("before"), F.coalesce(after, F.lit("")).alias("after"))
    placed = placed.where(F.col("match").isNotNull())
    return placed.withColumn("end", F.col("start") + F.char_length("match"))


def _features(match: Column, before: Column, after: Column) -> dict[str, Column]:
    count = lambda chars: F.char_length(match) - F.char_length(F.regexp_replace(match, chars, ""))
    flag = lambda c: c.cast("int")
    values = {
        "length": F.char_length(match), "digits": count("[0-9]"), "letters": count(r"\p{L}"), "capitals": count(r"\p{Lu}"), "groups": F.regexp_count(match, F.lit("[0-9]+")),
        "spaces": count(r"\s"), "dots": count(r"\."), "hyphens": count("-"), "parens": count("[()]"), "plus": count(r"\+"), "ats": count("@"), "odd": count(r"[^\p{L}0-9@.+()\s%_-]"),
        # places where letters and digits meet
        "turns": F.regexp_count(match, F.lit(r"(?<=\p{L})[0-9]|(?<=[0-9])\p{L}")), "kinds": F.size(F.array_distinct(F.split(F.left(match, F.lit(64)), ""))),
        "luhn": flag(F.char_length(_digits(match)).between(12, 19) & _luhn(F.left(_digits(match), F.lit(19)))),
        "octets": flag(F.regexp_count(match, F.lit(r"[0-9]+")).eqNullSafe(4) & _valid(F.lit("ip"), F.regexp_replace(match, "[^0-9]+", "."))),
        "joined_before": flag(before.rlike(r"\w$")), "joined_after": flag(after.rlike(r"^\w")), "sign_before": flag(before.rlike(r"[=:#/<]\s?$")), "quoted": flag(before.rlike(r"[\"']$")),
        "key_word": flag(before.rlike(KEY_WORD)),
    }
    return {n: F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in values.items()}


def _proposals(spans: DataFrame) -> DataFrame:
    """One row per place that a generator or base pattern names: label (its base kind), touches (overlaps a base span), features."""
    wide = F.col("kind").isin("around_at", "dotted", *BASE) | (F.col("kind") == "mixed") & F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")
    wide = wide | F.col("kind").isin("groups", "digits", "phone_shape") & (F.char_length(_digits(F.col("match"))) >= 7)
    order = F.when(F.col("valid"), F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(BASE) for x in (k, i)]), F.col("kind")))
    placed = spans.where(wide & (F.col("valid") | ~F.col("kind").isin(*BASE))).groupBy(*LOCATOR, "start", "end").agg(
        F.first("match").alias("match"), F.first("before").alias("before"), F.first("after").alias("after"), F.min(order).alias("base"), F.bool_or(F.col("kind") == "mixed").alias("mixed")
    )
    is_base = F.col("base").isNotNull()
    # both frames grow row by row; one that shrinks would be read anew for each row
    forth, back = (Window.partitionBy(*LOCATOR).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
    reached = F.max(F.when(is_base, F.col("end"))).over(forth)
    ahead = F.min(F.when(is_base, F.col("start"))).over(back)
    touches = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    random = (F.char_length("match") >= 20) & (F.regexp_count("match", F.lit(r"(?<=\p{L})[0-9]|(?<=[0-9])\p{L}")) >= 4)
    secret = F.col("mixed") & random & F.col("before").rlike(ASSIGNED) & F.col("after").rlike(r"^[\"']")
    label = F.coalesce(*[F.when(F.col("base") == i, F.lit(k)) for i, k in enumerate(BASE)], F.when(secret & ~touches, F.lit("secret")))
    described = _features(F.col("match"), F.col("before"), F.col("after"))
    return placed.withColumn("touches", touches).select(*LOCATOR, "start", "end", "touches", "mixed", label.alias("label"), *[v.alias(n) for n, v in described.items()])


def _select(spans: DataFrame, work: str, train_spans: int, least: float, seed: int) -> DataFrame | None:
    """Rows (LOCATOR, added): the spans that the calibrated trees add; None if nothing can be learned."""
    turn = F.pmod(F.xxhash64(*LOCATOR, F.lit(seed)), F.lit(1000))
    spans = stored(spans.withColumn("turn", turn), f"{work}/spans")
    # a proposal that overlaps a base span without being one tells nothing
    learned = spans.where(F.col("label").isNotNull() | ~F.col("touches"))
    halves = learned.groupBy((F.col("turn") < 500).alias("early"), "label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 12 rows
    of = lambda kind, early, own: sum(r.n for r in halves if r.early == early and (r.label == kind) == own)
    kinds = [k for k in ADDED if of(k, True, True) and of(k, True, False) and of(k, False, True)]
    if not kinds:
        return None
    vectors = {k: VectorAssembler(inputCols=FEATURES[k], outputCol=f"x_{k}") for k in kinds}
    place = F.pmod(F.xxhash64(*LOCATOR, "start", "end"), F.lit(1 << 20)) / float(1 << 20)
    share = lambda k: F.when(F.col("label").eqNullSafe(k), min(1.0, train_spans / of(k, True, True))).otherwise(min(1.0, 3 * train_spans / of(k, True, False)))
    drawn = F.array_compact(F.array(*[F.when(place < share(k), F.lit(k)) for k in kinds]))
    sample = learned.where("turn < 500").select(F.col("label").alias("own"), *FORMAT, *CONTEXT, drawn.alias("drawn")).where(F.size("drawn") > 0)
    sample = stored(sample.coalesce(8), f"{work}/sample")  # its rows are bounded

    def fitted(kind: str):
        rows = sample.where(F.array_contains("drawn", kind)).withColumn("label", F.col("own").eqNullSafe(kind).cast("double"))
        trees = GBTClassifier(maxDepth=2, maxIter=5, stepSize=0.3, maxBins=32, minInstancesPerNode=25, seed=seed, featuresCol=f"x_{kind}")
        return trees.fit(vectors[kind].transform(rows)).setProbabilityCol(f"p_{kind}").setRawPredictionCol(f"raw_{kind}").setPredictionCol(f"is_{kind}")

    with ThreadPoolExecutor(len(kinds)) as pool:  # small samples: their jobs wait more than they work
        models = dict(zip(kinds, pool.map(fitted, kinds)))

    def chances(df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and the trees' probability for each kind, in one pass."""
        out = df
        for k, model in models.items():
            out = model.transform(vectors[k].transform(out))
        return out.select(*keep, *[vector_to_array(f"p_{k}")[1].alias(k) for k in kinds])

    held = chances(learned.where("turn >= 500 AND label IS NOT NULL"), ["label"])
    own = {k: F.when(F.col("label") == k, F.col(k)) for k in kinds}
    labelled = held.agg(*[F.avg(c).alias(k) for k, c in own.items()]).first().asDict()
    scored = chances(spans.where("NOT touches AND label IS NULL OR label = 'secret'"), [*LOCATOR, "start", "end", "mixed"])
    # a secret is a whole run of letters and digits
    fits = F.array_compact(F.array(*[F.when((F.col(k) >= least * labelled[k]) & (F.col("mixed") | F.lit(k != "secret")), F.struct((F.col(k) / labelled[k]).alias("score"), F.lit(ADDED[k]).alias("kind"))) for k in kinds]))
    every = scored.select(*LOCATOR, "start", "end", F.explode(fits).alias("f")).select(*LOCATOR, "start", "end", "f.*")
    # overlapping ones become one, with the best one's kind
    along = Window.partitionBy(*LOCATOR).orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = every.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy(*LOCATOR, "run").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"))
    return stored(one.groupBy(*LOCATOR).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added")), f"{work}/added")


def find_personal_data(
    docs: DataFrame, train_spans: int = 10_000, least: float = 0.5, seed: int = 11, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, base and added (arrays of kind, start, end) and LOCATOR; base in order of kind and start."""
    work = work_dir(docs.sparkSession, "pii")
    rows = located(docs).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), *LOCATOR)
    spans = all_spans(rows, BASE | PROPOSALS)
    spans = stored(spans.withColumn("valid", F.col("kind").isin(*BASE) & _valid(F.col("kind"), F.col("match"))), f"{work}/found")
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(BASE) for x in (k, i)]), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind")))
    base = spans.where("valid").groupBy(*LOCATOR).agg(F.transform(listed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    added = _select(_proposals(spans), work, train_spans, least, seed)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    out = rows.select("id", *LOCATOR).join(base, list(LOCATOR), "left")
    out = out.withColumn("added", none) if added is None else out.join(added, list(LOCATOR), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"), *LOCATOR)


def redact(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """``text`` with every span (sorted by start, not overlapping) replaced by ``mark``."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    gap = lambda z: F.substring(text, (z["e"] + 1).cast("int"), F.greatest(F.lit(0), (z["s"] - z["e"])).cast("int"))
    return F.array_join(F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), gap), mark)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

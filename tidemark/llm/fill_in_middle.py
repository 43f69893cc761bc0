"""Fill-in-the-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` with the regex library keeps every repetition of
the group, so ``match.ends(1)`` gives the number of units and both places where
the text is cut; nothing steps from unit to unit. Two cuts at unit ends are drawn
from a hash of the document's identifier: what lies before the smaller one is the
prefix, up to the larger one the middle, the rest the suffix. Only the text and
two numbers go to Python and three numbers come back (one Arrow column each);
texts are cut, put together and hashed by column functions, and no row is
shuffled, so a lost executor costs its own tasks only.

Form ``psm`` is mark, prefix, mark, suffix, mark, middle; ``spm`` starts with the
suffix. Texts that are empty, hold a mark, are not made of units throughout, or
are left out by ``rate`` stay ``plain``. Marks that cannot overlap one another
are the only ones allowed, so the parts between them give back the exact text.

Defined results: null text is empty, so plain with no units; a null identifier
draws like an empty one; repeated rows and repeated identifiers are documents of
their own, which equal identifiers cut at equal draws; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text

#: A line with its end, or what is left after the last one.
LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


def _draws(identifier: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from a hash of the seed and the identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cuts(unit: str):
    @F.arrow_udf("struct<n:long,first:long,second:long>")
    def cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        whole = regex.compile(f"({unit})*")
        rows = []
        for text, a, b in zip(texts, one.to_pylist(), other.to_pylist()):
            found = whole.fullmatch(text.as_py())
            if found is None:
                rows.append((None, None, None))
                continue
            ends = found.ends(1)
            n = len(ends)
            low, high = sorted((a % (n + 1), b % (n + 1)))
            rows.append((n, ends[low - 1] if low else 0, ends[high - 1] if high else 0))
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, ["n", "first", "second"])

    return cuts


def _check(marks: tuple[str, str, str]) -> None:
    overlap = any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b) + (a != b)))
    inside = any(b in a for a in marks for b in marks if a != b)
    if len(set(marks)) < 3 or "" in marks or overlap or inside:
        raise ValueError("marks must differ and must not be empty, hold one another or overlap")


def fill_in_middle(
    docs: DataFrame,
    unit: str = LINE,
    marks: tuple[str, str, str] = MARKS,
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n (units; null if other text is between them), form, prefix_chars, middle_chars, output.

    ``rate`` and ``spm_rate`` are percentages; ``unit`` is a pattern of the regex library without groups that capture.
    """
    _check(marks)
    h1, h2, h3, h4 = _draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    cut = rows.withColumn("cut", _cuts(unit)("text", "h1", "h2"))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate) | F.col("cut.n").isNull()
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    parts = cut.select("id", "text", "cut.n", "cut.first", "cut.second", form.alias("form"))
    length = F.char_length("text")
    piece = lambda start, end: F.substring("text", (start + 1).cast("int"), (end - start).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), F.col("first")), piece(F.col("first"), F.col("second")), piece(F.col("second"), length)
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    known = lambda c: F.when(F.col("form") != "plain", c)
    return parts.select(
        F.col("id").alias(id_col), "n", "form", known(F.col("first")).alias("prefix_chars"), known(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    part = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)

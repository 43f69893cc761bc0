"""The corpus operators as registered queries over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.ann import nearest
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.fill_in_middle import fill_in_middle, restored
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.line_dedup import drop_boilerplate
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack
from tidemark.llm.pii import BASE, find_personal_data, joined
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_counts import token_counts


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(_read(spark, sf_dir, "pages"), ratio=0.5, min_pages=3)
    n_lines, n_kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    return out.select(
        "page_id", "host", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH a AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<(/p|br|/li|/div|/h[1-6]|/title|/td|/tr|/nav|/footer|/header|/section|/article|p|li|div)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\f]+', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM b),
n AS (SELECT host, count(*) AS pages FROM c GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM c) GROUP BY host, line),
d AS (SELECT host, list(line) AS dropped FROM l JOIN n USING (host) WHERE l.n >= 3 AND l.n > 0.5 * n.pages GROUP BY host),
k AS (SELECT page_id, c.host, lines, CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, x)) END AS kept FROM c LEFT JOIN d ON c.host = d.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_read(spark, sf_dir, "documents"), weights=[3.0, 1.0, 2.0], share=1.5, max_epochs=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT min(cap / weight) AS first_open FROM f WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM f JOIN g ON f.cap / f.weight = g.first_open AND f.level * f.weight <= f.cap ORDER BY encode(source) NULLS LAST LIMIT 1), 'inf'::DOUBLE)) AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS through
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN through - size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_read(spark, sf_dir, "documents"), words=3, max_bits=2, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), length=200)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = quality.scoring_weights(quality.labelled_rows(docs, _read(spark, sf_dir, "labels"), "quality"))
    scored = quality.score(docs, weights)
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_read(spark, sf_dir, "documents"), rate=100, spm_rate=50, seed=7)
    digest = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
  coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS s FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), length=10, coverage=1.0)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item, r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b WHERE len(w) > 0),
bg AS (SELECT item, n, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o, lead(word, 8) OVER o, lead(word, 9) OVER o] AS g FROM bx WINDOW o AS (PARTITION BY r ORDER BY i)),
bw AS (SELECT DISTINCT item, least(10, n) AS m, array_to_string(g[1:least(10, n)], ' ') AS g FROM bg WHERE i + least(10, n) - 1 <= n),
dx AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
dg AS (SELECT r, n, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o, lead(word, 8) OVER o, lead(word, 9) OVER o] AS g FROM dx WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT dg.r, dg.i, bw.m, bw.item FROM dg JOIN (SELECT DISTINCT m FROM bw) l ON dg.i + l.m - 1 <= dg.n JOIN bw ON bw.m = l.m AND bw.g = array_to_string(dg.g[1:l.m], ' ')),
c AS (SELECT r, CAST(count(DISTINCT k) AS BIGINT) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").withColumn("label", noisy)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=10, low=30, high=90, scale=256)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_line_dedup": op3_line_dedup,
        "op4_mixing": op4_mixing,
        "op5_pii": op5_pii,
        "op6_simhash": op6_simhash,
        "op7_packing": op7_packing,
        "op8_repeats": op8_repeats,
        "op9_quality": op9_quality,
        "op10_ann": op10_ann,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_decontamination": op12_decontamination,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op3_line_dedup": OP3_SQL,
        "op4_mixing": OP4_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_decontamination": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }

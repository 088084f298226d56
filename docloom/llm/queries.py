"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, kdtree, licences, linededup, lm, neardup, packing, quality, substrings, urls
from docloom.llm.common import table
from docloom.llm.registry import register


def tokenizer_path() -> str:
    """The default vocabulary file; callers may name another."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LICENCE_SQL = f"""
WITH known AS (
  SELECT sha256(plain) AS known, min(licence_id) AS licence_id
  FROM (SELECT licence_id, {licences.canonical_sql("licence_text")} AS plain FROM (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in licences.KNOWN)}) AS v(licence_id, licence_text)) t
  WHERE plain <> '' GROUP BY 1)
SELECT d.doc_id, d.digest, k.licence_id
FROM (SELECT doc_id, sha256({licences.canonical_sql("text")}) AS digest FROM documents) d LEFT JOIN known k ON d.digest = k.known
"""


@register("op1_license_scans", _LICENCE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "licence_id")


_DECONTAM_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM items) t WHERE n > 0) u),
lens AS (SELECT DISTINCT n FROM wins),
occ AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens WHERE len(w) >= n) t),
hits AS (SELECT o.doc_id, o.n, o.i, x.item_id FROM occ o JOIN wins x ON o.n = x.n AND o.win = x.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) t GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) t GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""


@register("op4_benchmark_decontamination", _DECONTAM_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan(docs, table(spark, sf_dir, "benchmark")))


@register("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "poor_probability", "toxic_probability", "kept")


@register("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm.score(docs, lm.train(docs, target)).select("doc_id", "n_words", "target_loss", "background_loss", "score")


@register("op8_url_filters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


@register("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_LINES_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
lines AS (
  SELECT doc_id, text, x, i, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS p
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) t
  WHERE trim(x, ' ') <> ''),
sums AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id, text ORDER BY p) AS upto FROM lines),
packed AS (SELECT doc_id, text, list(x ORDER BY p) AS xs, list(upto ORDER BY p) AS ups FROM sums GROUP BY 1, 2),
pairs AS (
  SELECT a.doc_id, a.text, a.p, b.p AS q
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND a.text = b.text AND b.p >= a.p AND b.p < a.p + {linededup.MIN_CHARS} AND b.upto - a.upto + length(a.x) >= {linededup.MIN_CHARS}),
shortest AS (
  SELECT doc_id, text, p, min(q) AS q FROM pairs GROUP BY 1, 2, 3
  UNION SELECT doc_id, text, max(p) AS p, q FROM pairs GROUP BY doc_id, text, q),
runs AS (
  SELECT s.doc_id, s.text, s.p, s.q - s.p + 1 AS need, array_to_string(list_slice(k.xs, s.p, s.q), chr(10)) AS run
  FROM shortest s JOIN packed k ON s.doc_id = k.doc_id AND s.text = k.text),
firsts AS (SELECT run, min((doc_id, p)) AS f FROM runs GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(p, p + need)) AS p
  FROM (SELECT r.* FROM runs r JOIN firsts f ON r.run = f.run WHERE (r.doc_id, r.p) <> f.f) t),
spans AS (SELECT g.doc_id, g.text, g.p, l.i, g.p - row_number() OVER (PARTITION BY g.doc_id, g.text ORDER BY g.p) AS grp FROM gone g JOIN lines l ON g.doc_id = l.doc_id AND g.text = l.text AND g.p = l.p),
stat AS (SELECT doc_id, text, count(*) AS removed_lines, count(DISTINCT grp) AS removed_runs FROM spans GROUP BY 1, 2),
rest AS (
  SELECT doc_id, text, string_agg(x, chr(10) ORDER BY i) AS t
  FROM (SELECT d.doc_id, d.text, d.x, d.i FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) d
        LEFT JOIN spans s ON d.doc_id = s.doc_id AND d.text = s.text AND d.i = s.i WHERE s.i IS NULL) t GROUP BY 1, 2)
SELECT d.doc_id, CAST(coalesce(s.removed_lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(s.removed_runs, 0) AS BIGINT) AS removed_runs,
  sha256(CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(r.t, '') END) AS text_sha256
FROM documents d LEFT JOIN stat s ON d.doc_id = s.doc_id AND d.text = s.text LEFT JOIN rest r ON d.doc_id = r.doc_id AND d.text = r.text
"""


@register("op2_line_dedup", _LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removed_lines", "removed_runs", F.sha2("text", 256).alias("text_sha256"))


_VECTORS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op3_exact_topk_search", _VECTORS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), kdtree.whole_numbers("embedding").alias("v"))
    return kdtree.top_k(points, points.where("id % 20 = 0"), k=20)


@register("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs, keep_text=False)

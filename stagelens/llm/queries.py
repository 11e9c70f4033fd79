"""The registered queries of this package, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    plan = mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::HUGEINT AS s,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM sized GROUP BY source
), ratios AS (
  SELECT *, row_number() OVER (ORDER BY s::DOUBLE / w, source NULLS LAST) AS r FROM totals
), steps AS (
  SELECT r - 1 AS capped, s, w,
         sum(s) OVER () - 3 * coalesce(sum(s) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM ratios
), fixed AS (
  SELECT capped, rest, open FROM steps WHERE rest * w <= 3 * open * s ORDER BY capped LIMIT 1
), targets AS (
  SELECT source, s::BIGINT AS source_size,
         CASE WHEN r <= capped THEN (3 * s)::DOUBLE ELSE (w * rest)::DOUBLE / open::DOUBLE END AS target,
         ('0x' || substr(md5(coalesce(source, '') || ':mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM ratios, fixed
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS k
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor((k + 1) * rate + u) - floor(k * rate + u), ceil(rate)) * size)::BIGINT AS taken
FROM placed
"""


def op2_store_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_shards import stored_tokens

    return stored_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_encode_and_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_words import encode_and_decode

    return encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_documents

    return near_documents(_table(spark, sf_dir, "documents"), k=3, threshold=90)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_join import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import predicted_languages

    return predicted_languages(_table(spark, sf_dir, "documents"))


def op10_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whiten_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_mine_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


def op13_drop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import kept_lines

    kept = kept_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT d.doc_id, d.line, d.place, coalesce(d.doc_id <> r.owner, false) AS gone FROM keyed d LEFT JOIN repeated r ON d.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP8_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = v.vec_id
"""


QUERIES: dict[str, Query] = {
    "op1_mix_sources": Query(op1_mix_sources, OP1_SQL),
    "op2_store_tokens": Query(op2_store_tokens),
    "op3_fingerprints": Query(op3_fingerprints),
    "op4_extract_pages": Query(op4_extract_pages),
    "op5_count_tokens": Query(op5_count_tokens),
    "op6_encode_and_decode": Query(op6_encode_and_decode),
    "op7_ngram_join": Query(op7_ngram_join, OP7_SQL),
    "op8_near_vectors": Query(op8_near_vectors, OP8_SQL),
    "op9_identify_languages": Query(op9_identify_languages),
    "op10_score_toxicity": Query(op10_score_toxicity),
    "op11_whiten_vectors": Query(op11_whiten_vectors),
    "op12_mine_negatives": Query(op12_mine_negatives, OP12_SQL),
    "op13_drop_lines": Query(op13_drop_lines, OP13_SQL),
}

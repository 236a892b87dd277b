"""The numbered queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path
from . import decontamination, hard_negatives, html_text, language, packing, quality, resampling, resampling_sql, simhash, substrings, token_codes, toxicity, url_queries, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_rest(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_id_rest(5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels, held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_id_rest(3) == 1, F.lit(False))
    model = quality.fit(docs, labels, held_out)
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.5).cast("int").alias("predicted"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_codes")
    token_codes.write(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=0, special_as_text=False)
    return token_codes.read_documents(spark, path)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2, special_as_text=False)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(_table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where(
        "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    )
    scaled = F.expr("transform(embedding, x -> cast(floor(1024 * double(x)) as bigint))")
    index = vector_search.build(vectors.select("vec_id", scaled.alias("v")))
    return vector_search.search(index, index.rows.where("vec_id % 100 = 0"), k=10)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x : floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), similarity=0.8, size=5)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    vectors = _table(spark, sf_dir, "embeddings").where(F.expr(f"label is not null and embedding is not null and {finite}"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.expr("transform(embedding, x -> cast(floor(256 * double(x)) as bigint))")
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), scaled.alias("v")), anchors=F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid AS own, c.vec_id,
    CASE WHEN len(a.e) = 0 THEN 0 ELSE CAST(list_inner_product(a.e, c.e) AS BIGINT) END AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.rid <> c.rid AND len(a.e) = len(c.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, own) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.rid, p.own ORDER BY s.score DESC, s.vec_id, s.own) AS INTEGER) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND p.place <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, buckets=10_000, percent=25, least_words=20, seed=7)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_id_rest(4) == 2, F.lit(False))
    model = language.fit(docs.select("doc_id", "text", "lang"), held_out)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_token_codes": op3_token_codes,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_vector_search": op6_vector_search,
    "op7_substrings": op7_substrings,
    "op8_url_filters": url_queries.op8_url_filters,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_resampling": op12_resampling,
    "op13_language": op13_language,
}
ORACLE_SQL: dict[str, str] = {
    "op6_vector_search": OP6_SQL,
    "op8_url_filters": url_queries.ORACLE,
    "op11_hard_negatives": OP11_SQL,
    "op12_resampling": resampling_sql.ORACLE,
}

"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import ann, bpe, exact_dedup, language_id, licenses, line_dedup, lm_score, mixing, repair, secrets, simhash, toxicity, vector_codes
from pricetide.llm.common import cut, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(cut(ann.index(vectors)), vectors.where("vec_id % 50 = 0"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.lm_score(table(spark, sf_dir, "documents"), good)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.split(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.language_id(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that lose all rows to the damage count zeros and the digest of nothing."""
    rows = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(rows)).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.codebooks(vectors)
    return vector_codes.vector_codes(vectors, books).withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SQL = {
    "op5_mix": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
        ), weighed AS (
            SELECT source, source_size, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM sources
        ), levels AS (
            SELECT 0 AS turn, -1.0::DOUBLE AS was, 1.5::DOUBLE * sum(source_size) / sum(weight) AS level FROM weighed
            UNION ALL
            SELECT turn + 1, level, coalesce((1.5::DOUBLE * (SELECT sum(source_size) FROM weighed) - (SELECT sum(CASE WHEN 2.0 * source_size <= weight * level THEN 2.0::DOUBLE * source_size ELSE 0 END) FROM weighed))
                / nullif((SELECT sum(CASE WHEN 2.0 * source_size <= weight * level THEN 0 ELSE weight END) FROM weighed), 0), 1e300)
            FROM levels WHERE level <> was AND turn < 1000
        ), last AS (SELECT max_by(level, turn) AS level FROM levels
        ), targets AS (
            SELECT source, source_size, CASE WHEN 2.0 * source_size <= weight * level THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target FROM weighed, last
        ), rated AS (
            SELECT doc_id, digest, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS rate
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
            CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM rated
    """,
    "op8_exact_dedup": r"""
        WITH docs AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM docs JOIN groups USING (text_sha256)
    """,
}


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """DuckDB SQL of the vector codes, one step for each round."""
    nearest = """
        near{k} AS (
            SELECT v.vec_id, v.label, v.p, v.part, arg_min(b.e, (d, b.e)) AS e, min(d) AS d
            FROM parts v JOIN books{k} b ON b.p = v.p,
                LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d) GROUP BY ALL
        ),"""
    averaged = """
        means{k} AS (
            SELECT p, e, list(m ORDER BY place) AS entry
            FROM (SELECT p, e, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT p, e, unnest(part) AS x, unnest(range(len(part))) AS place FROM near{k}) GROUP BY p, e, place)
            GROUP BY p, e
        ), books{n} AS (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM books{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e),"""
    steps = "".join(nearest.format(k=k) + averaged.format(k=k, n=k + 1) for k in range(rounds)) + nearest.format(k=rounds)
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, label, place, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS part FROM kept, range(16) t(p)
        ), books0 AS (SELECT p, place AS e, part AS entry FROM parts WHERE place < 64),
        {steps}
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
        FROM coded
    """


SQL["op13_vector_codes"] = _codes_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_secrets, op3_lm_score, op4_toxicity, op5_mix, op6_line_dedup, op7_bpe, op8_exact_dedup, op9_licenses, op10_simhash, op11_language_id, op12_repair, op13_vector_codes, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.scan(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(n(k) for k in pii.BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(_table(spark, sf_dir, "documents"), lm.held_out(F.col("doc_id")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_vectors

    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_pii, op4_best_fit, op5_repeated_passages, op6_lm_score, op7_html_text, op8_jaccard_join, op9_near_vectors, op10_exact_topk)}

#: DuckDB SQL for the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
}

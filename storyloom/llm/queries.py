"""The operators' queries, each over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, licenses, line_dedup, minhash_dedup, packing, poisson_mix, quality, secrets, topk
from ._common import spread
from .sql import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).drop("row", "first")


PASSAGE = 1  # words from which a repeat is returned: every one is; `words` lets readers choose longer ones


def op2_line_dedup(spark, sf_dir):
    return line_dedup.removals(table(spark, sf_dir, "documents")).drop("row")


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024, with_ids=False).drop("ids")


def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def secret_forest() -> secrets.Forest:
    """The forest of the scans, with the words of a public vocabulary."""
    import public_tokenizers

    return secrets.fit(vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op5_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), secret_forest()).filter("is_secret").drop("is_secret")


def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_licenses(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality_model(spark, sf_dir, docs: DataFrame | None = None) -> quality.Model:
    """A model from the labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "quality"))


KEEP = 0.3  # score from which a document counts as good


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op9_poisson_mix(spark, sf_dir):
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


def op10_topk(spark, sf_dir):
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024.0)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_line_dedup, op3_packing, op4_html_text, op5_secrets, op6_embedding_dedup, op7_licenses, op8_quality, op9_poisson_mix, op10_topk)}

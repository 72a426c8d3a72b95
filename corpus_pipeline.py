"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. The first
reads `labels` beside the documents; nothing else is read but what the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import minhash_dedup, packing, poisson_mix, quality, secrets
from storyloom.llm._common import discard, fresh, materialise
from storyloom.llm.queries import KEEP, quality_model, secret_forest, table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at KEEP or more; labels of held-out ids aren't learned from.

    Null and empty texts have the score of a text that neither dictionary helps. Rows that repeat stay or go together.
    All columns are kept, whatever their names. An empty table stays empty.
    """
    out = fresh(docs, "score")
    return quality.score(docs, quality_model(spark, sf_dir, docs), out=out).filter(F.col(out) >= KEEP).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, null ids last: five-word shingles,
    similarity of 0.8.

    Texts without words are no duplicates of each other, but rows that share both id and text are one: of those that
    stays whose columns come first as JSON. Rows that share an id and differ stay, if their texts aren't near. All columns
    are kept. An empty table stays empty.
    """
    row = F.xxhash64(F.col("text").cast("string"))
    found = minhash_dedup.near_duplicates(docs, words=5, percent=80).filter("first").select(F.col("doc_id").alias("i"), F.col("row").alias("r")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), row.alias("row"))
    kept = whole.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left_semi")
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        kept = kept.groupBy("id", "row").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return kept.select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder in the place of each secret in the text, and n_chars brought up to date.

    Null and empty texts stay as they are, with n_chars null and 0. Every row is read on its own. All columns are kept. An
    empty table stays empty.
    """
    out = secrets.redact(docs, secret_forest())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources weigh the same, in a random order.

    A null source is a source. A source without any text has rate 0, so its documents go. Rows that share an id get the
    same number of copies, rows without one draw each on its own. All columns are kept. An empty table stays empty.
    """
    return poisson_mix.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of 1024 tokens, with their ids.

    A null or empty text is its closing id alone. Every row is packed on its own, copies and rows without an id too.
    Further columns end here. An empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path(), 1024)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Compression, MinHash, a forest and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

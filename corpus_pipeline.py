"""Documents made ready for training, by the operators of ringlog.llm, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlog.llm import decontaminate, languages, pieces, secret_scan, simhash
from ringlog.llm.queries import TOKENIZERS, held_out
from ringlog.llm.scratch import free_name, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes if less than this part of its letters is in its language, in a
#: script that a language is known to have. Mixed languages do not come below it.
LEAST_SCORE = 0.2


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (6): documents without a letter, or all but wholly in unknown scripts, go.

    The model learns from the labels of the documents that are not held out. Without
    any label, documents with a letter stay.
    """
    model = languages.fit(docs.where(~held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free_name(docs, "found")
    found = languages.identified(docs, model, "text", name)
    lang, score = F.col(name)["lang"], F.col(name)["score"]
    kept = found.where((lang != languages.UNDETERMINED) & (score >= LEAST_SCORE))
    return kept.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (7): one document of each group stays, that with the smallest id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (8): documents that hold an item of `benchmark` go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (3): every secret in a text is replaced by a mark; n_chars follows."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.coalesce(length, "n_chars")).select(docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (1): the ids of each text, and whether they give it back."""
    model = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = docs.select("doc_id", "lang", "source", "text")
    found = rows.withColumn("coded", pieces.encode_checked(F.col("text"), model))
    ids = F.size("coded.ids").cast("bigint")
    return found.select(
        "doc_id", "lang", "source", ids.alias("n_ids"), "coded.ids", "coded.round_trip"
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_a_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("pieces", as_pieces),
]

#: Python models and encoders decide in most stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

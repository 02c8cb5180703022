"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    languages,
    licenses,
    merkle,
    negatives,
    neighbours,
    pieces,
    repeats,
    secret_scan,
    simhash,
    token_tree,
    toxicity,
    warc,
)
from .oracle import SQL as SQL

#: Where the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(
    spark: SparkSession, sf_dir: str, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model"
) -> DataFrame:
    model = pieces.read_model(model_path)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("coded", pieces.encode_checked(F.col("text"), model))
    return found.select(
        "doc_id",
        F.size("coded.ids").cast("bigint").alias("n_ids"),
        "coded.ids",
        "coded.round_trip",
    )


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "kept_ids",
        F.size("removed").cast("bigint").alias("n_removed"),
        "removed",
        "text",
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit(docs), partly=True)
    return found.select("doc_id", *secret_scan.digest_columns())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    counts = ["n_words", "n_base", "first_word", "last_word"]
    return found.select(F.col("id").alias("doc_id"), *counts, *licenses.digest_columns())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(_table(spark, sf_dir, "pages"))


def held_out() -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = languages.fit(docs.where(~held_out()))
    found = languages.identified(docs.select("doc_id", "text"), model, "text", "found")
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.size("found.spans").cast("bigint").alias("n_spans"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


#: What is taken out of texts whose tokens are counted anew: long numbers, keys, addresses.
PRIVATE = r"[0-9a-f]{24,}|[0-9]{12,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
REMOVED = "[removed]"


def op9_token_counts(
    spark: SparkSession, sf_dir: str, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    vocabulary = token_tree.read_vocabulary(ranks_path, token_tree.PATTERN)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.matches(F.coalesce("text", F.lit("")), PRIVATE)
    edits = F.transform(
        found,
        lambda x: F.struct(
            x["s"].alias("start"), x["e"].alias("end"), F.lit(REMOVED).alias("text")
        ),
    )
    trees = docs.withColumn("edits", edits).withColumn(
        "tree", token_tree.tree(F.col("text"), vocabulary)
    )
    after = token_tree.edit_tree(F.col("text"), F.col("tree"), F.col("edits"), vocabulary)
    return trees.withColumn("after", after).select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        token_tree.tokens_of(F.col("tree")).alias("n_tokens"),
        F.col("after.applied").cast("bigint").alias("n_edits"),
        F.col("after.encoded").cast("bigint").alias("n_chars_encoded"),
        token_tree.tokens_of(F.col("after")).alias("n_tokens_after"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


#: What a document's leaf is made of, in this order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*LEAF)
    unbroken = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in LEAF]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = F.when(tampered, merkle.leaf(unbroken))
    found = merkle.manifest(docs, LEAF, altered=altered)
    start = F.coalesce("altered", "leaf")
    found = found.withColumn("folded_root", merkle.folded(start, F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    model = toxicity.fit(docs.where(~held_out()), labels)
    found = docs.withColumn("score", toxicity.score(F.col("text"), model))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
    )


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_repeats": op2_repeats,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_warc": op5_warc,
    "op6_languages": op6_languages,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_neighbours": op10_neighbours,
    "op11_negatives": op11_negatives,
    "op12_merkle": op12_merkle,
    "op13_toxicity": op13_toxicity,
}

"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.llm import (
    centroids,
    chat,
    decontamination,
    html,
    language,
    periods,
    pii,
    quality,
    rules,
    sentencepiece,
    simhash,
    suffixes,
    toxicity,
)
from shelfledger.llm.common import fold, read_table

#: SentencePiece model file read by the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Secret of the surrogates; a real corpus takes its own.
PII_KEY = "registered query"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside fold 1 of 3."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(fold("doc_id", 3) != 1))
    found = language.identify(docs, model)
    return found.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_words", "n_switches"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside fold 0 of 5."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.learn(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(docs, PII_KEY)[0]


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read_table(spark, sf_dir, "pages"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation under every participant's perspective."""
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside fold 0 of 5."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    found = toxicity.detect(docs, model)
    return found.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        "predicted",
        F.size("passages").alias("n_passages"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its coverage."""
    return decontamination.contaminated(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under risk-controlled thresholds."""
    return rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    found = sentencepiece.encode(
        read_table(spark, sf_dir, "documents"), sentencepiece.load(VOCABULARY)
    )
    return found.select("doc_id", "ids", F.size("ids").alias("n_pieces"), "decodes")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector."""
    assigned, points = centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, points)


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier one holds."""
    return suffixes.digests(suffixes.remove_repeats(read_table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after every tenth one was made to repeat itself."""
    docs = periods.planted(read_table(spark, sf_dir, "documents"))
    return periods.digests(periods.periodic_runs(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality,
        op3_pii_surrogates,
        op4_simhash,
        op5_html_text,
        op6_chat_perspectives,
        op7_toxicity,
        op8_decontamination,
        op9_quality_rules,
        op10_sentencepiece,
        op11_centroid_clusters,
        op12_suffix_repeats,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat_perspectives": chat.oracle(),
    "op9_quality_rules": rules.oracle(),
    "op11_centroid_clusters": centroids.oracle(),
    "op12_suffix_repeats": suffixes.oracle(),
    "op13_periodic_runs": periods.oracle(),
}

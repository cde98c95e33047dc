"""Corpus pipeline: raw documents to token ids, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.llm import decontamination, language, pii, sentencepiece, simhash
from shelfledger.llm.common import drop_table, read_table, write_table
from shelfledger.llm.queries import PII_KEY, VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; ``lang`` becomes the predicted one.

    Learns from the documents' own languages.  Null texts and texts without a letter are rejected,
    texts in several languages are not, however evenly these share the letters.
    """
    model = language.learn(docs)
    found = docs.withColumn("__found", language.predict(model, "text"))
    found = found.filter(F.col("__found.lang") != language.UNKNOWN)
    return found.withColumn("lang", F.col("__found.lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the one with the smallest id.

    Null, empty and blank texts are one component; of repeated rows one stays; long texts count whole; an empty
    table stays empty; all columns are kept, whatever their names.
    """
    return simhash.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none; repeated rows are judged alike; long texts are searched whole; without documents
    or items nothing is dropped; all columns are kept.
    """
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; the number of characters follows the text.

    Null and empty texts stay; repeated rows are treated alike; an empty table stays empty; all columns are kept.
    """
    replaced, _ = pii.replaced(docs, PII_KEY)
    if "n_chars" not in docs.columns:
        return replaced
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return replaced.withColumn("n_chars", F.coalesce(n, F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    Null and empty texts have no ids; repeated rows are encoded each; long texts are encoded whole; an empty table
    gives no rows; columns other than id and text are left out.
    """
    return sentencepiece.encode(docs, sentencepiece.load(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii_surrogates", replace_personal_data),
    ("sentencepiece", tokenize),
]

#: Learned models and fingerprints cannot be said in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written to the shared folder.

    A stage's table is removed once the next one is written; the last one stays for the result.
    """
    docs, path = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, written = write_table(stage(spark, docs, sf_dir))
        if path is not None:
            drop_table(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)

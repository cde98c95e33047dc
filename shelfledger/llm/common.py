"""Shared helpers of the text operators: tables, folds, bounded samples, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an unknown id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(folds)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller cannot clash."""
    return df.select(*[df[name] for name in names])


def hashed_below(rank: Column, share: float) -> Column:
    """Whether a 64-bit hash is in the lowest ``share`` of its range."""
    return rank <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones on every run: those whose key hashes lowest.

    A first cut by hash value leaves about the wanted number in each task, so the
    final ordering sees few rows whatever the size of ``df``.
    """
    total = df.count()
    ranked = df.withColumn("__rank", F.xxhash64(F.col(key)))
    if total > rows:
        ranked = ranked.filter(hashed_below(F.col("__rank"), 1.2 * rows / total + 0.001))
    return ranked.orderBy("__rank", key).limit(rows).drop("__rank")


def label_sample(
    labels: DataFrame, label: str, *, folds: int, held: int, rows: int, doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids outside the held-out fold.

    Rows without id or label are left out, an id with two different labels as well.
    The bound makes the result safe to broadcast.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.filter(fold(doc_id, folds) != held)
    known = known.groupBy(doc_id).agg(F.min(label).alias(label), F.max(label).alias("__most"))
    known = known.filter(F.col(label) == F.col("__most")).select(doc_id, label)
    return bounded_sample(known, doc_id, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local master may fall back to a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="shelfledger-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once into the shared folder; returns the stored table and its path.

    The table outlives lost executors and cuts the lineage.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return write_table(df)[0]


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``write_table`` that a later one has replaced."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

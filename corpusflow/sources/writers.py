"""Writers: corpora, buckets, shards, sidecars, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import drop_cr, first_filled
from ..operators.mixing import mixture_manifest
from ..operators.packing import SHARD_SEQS, with_shard

# Separator between documents and sidecar defaults.
DOC_END = "\n\n"
DEFAULT_VOCAB = 200_000
DEFAULT_SEQ_LEN = 2048


def write_corpus(df: DataFrame, path: str, order: str, text: str = "text", content: str | None = None) -> None:
    """Text files in order, documents ended by a blank line, carriage returns removed."""
    body = first_filled(text, content) if content else first_filled(text)
    d = df.select(order, drop_cr(body).alias("value")).filter(F.col("value") != "")
    d.orderBy(order).select("value").write.option("lineSep", DOC_END).text(path)


def write_buckets(df: DataFrame, path: str, bucket: str = "bucket", fmt: str = "parquet") -> None:
    """One folder per bucket. Rebalancing splits a large bucket over several tasks."""
    df.hint("rebalance", bucket).write.partitionBy(bucket).format(fmt).save(path)


def write_shards(packed: DataFrame, path: str, shard_seqs: int = SHARD_SEQS) -> None:
    """Parquet files of ``shard_seqs`` sequences.

    A task holds whole shards in order and every shard but the last is full, so
    cutting files at ``shard_seqs`` records puts one shard in each.
    """
    (with_shard(packed, shard_seqs).repartition("shard").sortWithinPartitions("seq_id").drop("shard")
     .write.option("maxRecordsPerFile", shard_seqs).parquet(path))


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def meta_path(path: str) -> str:
    return f"{path.rstrip('/')}.meta"


def write_meta(spark: SparkSession, path: str, encoding: str, vocab_size: int, seq_len: int) -> None:
    rows = [(f"encoding={encoding}",), (f"vocab_size={vocab_size}",), (f"seq_len={seq_len}",)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(meta_path(path))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row ``encoding, vocab_size, seq_len``; missing entries take the defaults."""
    kv = spark.read.text(meta_path(path)).select(F.split("value", "=", 2).alias("kv"))
    value = lambda k: F.max(F.when(F.get("kv", F.lit(0)) == k, F.get("kv", F.lit(1))))
    return kv.agg(value("encoding").alias("encoding"),
                  F.coalesce(value("vocab_size").cast("int"), F.lit(DEFAULT_VOCAB)).alias("vocab_size"),
                  F.coalesce(value("seq_len").cast("int"), F.lit(DEFAULT_SEQ_LEN)).alias("seq_len"))


def write_mixture(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """The mixture manifest as JSON lines; also returned."""
    d = mixture_manifest(spark, root=root)
    d.coalesce(1).write.mode("overwrite").json(path)
    return d

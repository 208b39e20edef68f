"""Whole flows from the single operators: corpus build, mixture to training rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import classify_bucket, not_blank
from ..session import materialize
from ..sources import readers as R
from ..sources import writers as W
from . import mixing as M
from . import packing as P
from . import tokens as K

SPOT = 512  # units of the emission order per block; about one emission each
COPIES = 1 << 16  # copies of one text that are numbered in one piece
POS_BITS = 48  # places of emissions stay below 2**48


# ---- mixture to packed rows --------------------------------------------------------

def read_mixture(spark: SparkSession, path: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Manifest file to ``(sources, spec)``: all sources' rows ``source, order, text`` and one row per source with a weight.

    Each source is read by its type: Parquet with an ``order`` column, or one text or JSON-lines
    file whose line numbers are the order.
    """
    spec = (spark.read.schema("source string, type string, path string, weight double, temperature double").json(path)
            .where("weight is not null"))
    parts = []
    for r in spec.orderBy("source").toLocalIterator():  # one row per source
        if r["type"] == "parquet":
            d = R.read_parquet_text(spark, r["path"], keep=[order])
        elif r["type"] == "jsonl":
            d = R.read_jsonl_text(spark, r["path"]).withColumnRenamed("line_no", order)
        else:
            d = R.read_lines(spark, r["path"]).withColumnRenamed("line", "text").withColumnRenamed("line_no", order)
        parts.append(d.select(F.lit(r["source"]).alias("source"), F.col(order).cast("bigint").alias(order), "text"))
    return M.concat_sources(*parts), spec


def interleaved(df: DataFrame, probs: DataFrame, order: str) -> DataFrame:
    """Emissions of the mixture with their place ``pos``; places within a millionth go by source."""
    d = M.interleave(df, probs, order).withColumn("at", F.round("at", 6))
    return M.row_index(d, ["at", "source", "e"], "pos", block=F.floor(F.col("at") / SPOT).cast("bigint"),
                       key_bits=POS_BITS).drop("at", "e")


def packed_mixture(spark: SparkSession, manifest: str, vocab: K.Vocab, seq_len: int, seed: int, order: str,
                   temperature: float | None) -> DataFrame:
    """Manifest to training rows: read, encode with line ends, weigh, interleave in order, buffer shuffle, pack.

    A row of a small source is emitted many times. Emissions are placed without their ids, which
    are joined when all places are known: repeats are never stored, and of them only what shares a sequence is shuffled.
    """
    rows, spec = read_mixture(spark, manifest, order)
    ids = K.encode_lines(rows, vocab).drop("text").withColumn("row", F.monotonically_increasing_id())
    ids = materialize(ids, "mixture-ids")  # once per row, before repeats
    where = interleaved(ids.select("source", order), M.temperature_weights(spec, temperature), order)
    where = where.join(ids.select("source", order, "n_tok", "row"), ["source", order]).withColumnRenamed("pos", "place")
    where = materialize(where.select("place", "n_tok", "row"), "mixture")
    return P.pack_placed(P.shuffled_starts(where, "place", seed, "n_tok", key_bits=POS_BITS), ids, ["row"], seq_len)


# ---- corpus build --------------------------------------------------------------------

MANIFEST = ("source string, type string, path string, weight double, temperature double, data_files string, "
            "newline_separated boolean, n bigint")


def build_corpus(spark: SparkSession, roots: list[str], out: str, cap: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """Scan, route by path, read by type, keep ``cap`` rows per bucket (0: all), one folder per bucket, manifest.

    Every Parquet file takes its own text column. Files that cannot be read or hold no text column are named in a
    warning, with ``strict`` they raise; so are raw Arrow files, which a corpus build passes over.
    Rows are ``doc_no, text``: their place in the bucket by the hash of the text and, of equal texts, their number, so places
    and what a cap keeps depend on no order or layout of files. Returns the manifest, one row per bucket;
    ``read_mixture`` reads it, and buckets without a weight stay out of the mixture.
    """
    parts = []
    for root in roots:  # a few roots with a handful of endings
        found = R.scan_files(spark, [root])
        for r in found.where("skipped").select("path").orderBy("path").toLocalIterator():
            if strict:
                raise ValueError(f"not read: {r['path']}")
            warnings.warn(f"not read: {r['path']}")
        for ext in sorted(r["ext"] for r in found.where("not skipped").select("ext").distinct().toLocalIterator()):
            file = F.col("_metadata.file_path").alias("path")
            if ext == ".parquet":
                parts.append(R.read_parquet_text(spark, root, keep=[file], strict=strict, mixed=True))
                continue
            d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").text(root)
            text = R.json_text("value") if "json" in ext else F.col("value")
            parts.append(d.select(file, text.alias("text")))
    if not parts:
        raise ValueError(f"nothing readable in {roots}")
    d = M.concat_sources(*parts).filter(not_blank("text"))
    d = d.select(classify_bucket(F.regexp_replace("path", "^[a-z]+:/+", "/")).alias("bucket"), "text")
    d = _numbered(d)
    key = ["text", "copy"]
    if cap:
        d = M.sample_n(d, spark.createDataFrame([(b, cap) for b in [*dict(M.MIXTURE_WEIGHTS), "misc"]], "bucket string, k bigint"),
                       seed, key, ["bucket"])
    d = d.withColumn("h", M.hash_key(seed, *key))
    d = M.row_index(d, ["h", *key], "doc_no", ["bucket"], block=M.hash_block("h"), key_bits=32).drop("h", "copy")
    W.write_buckets(d, out)
    n = spark.read.parquet(out).groupBy("bucket").agg(F.count("*").alias("n"))
    weights = M.mixture_manifest(spark, root=out).drop("path", "type").withColumnRenamed("source", "bucket")  # one row per bucket
    folder = F.concat(F.lit(f"{out}/bucket="), "bucket")
    manifest = n.join(F.broadcast(weights), "bucket", "left").select(
        F.col("bucket").alias("source"), F.lit("parquet").alias("type"), folder.alias("path"), "weight", "temperature",
        F.concat(folder, F.lit("/*.parquet")).alias("data_files"), F.lit(False).alias("newline_separated"), "n")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}.manifest")
    return spark.read.schema(MANIFEST).json(f"{out}.manifest")


def _numbered(d: DataFrame) -> DataFrame:
    """``bucket, text, copy``: equal texts of a bucket are numbered from 0, so that each has a key of its own.

    They are counted, which is combined on the map side, and told apart again in blocks of numbers.
    """
    n = d.groupBy("bucket", "text").agg(F.count("*").alias("n"))
    n = n.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    last = F.least(F.col("first") + COPIES, F.col("n")) - 1
    return n.select("bucket", "text", F.explode(F.sequence("first", last)).alias("copy"))

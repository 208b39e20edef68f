"""Data-health checks on packed datasets, vectors and losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .index import first_n

# Thresholds.
SAFE_LOSS = 10.0
MAX_LOSS = 100.0
HIGH_LOSS = 20.0


def id_range(df: DataFrame, vocab_size: int, n: int | None = 1000, order: str = "seq_id",
             ids: str = "input_ids") -> DataFrame:
    """Smallest and largest id over the first ``n`` sequences (all when None)."""
    d = df.select(order, ids)
    d = d if n is None else first_n(d, n, order)
    d = d.filter(F.size(ids) > 0).agg(F.min(F.array_min(ids)).alias("min_id"),
                                      F.max(F.array_max(ids)).alias("max_id"))
    return d.withColumn("vocab_ok", F.coalesce(
        (F.col("max_id") < vocab_size) & (F.col("min_id") >= 0), F.lit(True)))


def dataset_facts(df: DataFrame, ids: str = "input_ids", seq_len: int | None = None) -> DataFrame:
    """Rows, shortest and longest sequence, and rows of another length than expected."""
    n = F.size(ids)
    want = F.lit(seq_len) if seq_len is not None else None
    aggs = [F.count("*").alias("rows"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
            F.sum(n.cast("bigint")).alias("tokens")]
    if want is not None:
        aggs.append(F.sum((n != want).cast("int")).alias("mismatched"))
    return df.agg(*aggs)


def vector_stats(df: DataFrame, vec: str, group: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, largest magnitude, and NaN / infinity flags."""
    x = F.col("x")
    d = df.select(*(group or []), F.explode(vec).alias("x")).withColumn("x", x.cast("double"))
    return d.groupBy(*(group or [])).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.max(F.abs("x")).alias("max_abs"), F.max(F.isnan("x")).alias("has_nan"),
        F.max(F.abs("x") == float("inf")).alias("has_inf"))


def sanitize_loss(loss: Column | str) -> Column:
    """NaN and infinite losses become 10, others are capped at 100."""
    c = F.col(loss) if isinstance(loss, str) else loss
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, SAFE_LOSS).otherwise(F.least(c, F.lit(MAX_LOSS)))


def loss_verdict(loss: Column | str) -> Column:
    c = F.col(loss) if isinstance(loss, str) else loss
    return F.when(c > MAX_LOSS, "broken").when(c > HIGH_LOSS, "high").otherwise("ok")


def expected_fresh_loss(vocab_size: int) -> float:
    return math.log(vocab_size)


def token_budget(df: DataFrame, target_tokens: int, seq_len: int, batch_size: int = 1,
                 accumulate: int = 32) -> DataFrame:
    """Steps and rows for a token target, and how often the dataset is read for it."""
    per_step = batch_size * accumulate * seq_len
    steps = math.ceil(target_tokens / per_step)
    rows = steps * batch_size * accumulate
    return df.agg(F.count("*").alias("dataset_rows")).select(
        "dataset_rows", F.lit(per_step).cast("bigint").alias("tokens_per_step"),
        F.lit(steps).cast("bigint").alias("steps"), F.lit(rows).cast("bigint").alias("rows_needed"),
        (F.lit(rows) / F.col("dataset_rows")).alias("epochs"))

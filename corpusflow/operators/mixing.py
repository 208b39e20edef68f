"""Deduplication, sampling, splitting and mixing.

Random order is the order of ``md5(seed|key)``: the same rows come out on any
layout and cluster. The leading 16 bits of the hash are the blocks of the exact
"first n in hash order" operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import classify_bucket
from .index import KEY_BITS, WIDE_BITS, first_n, int_div, row_index

# Mixture manifest and instruction-mix defaults.
MIXTURE_WEIGHTS = {"fineweb": 0.60, "wikipedia": 0.10, "books": 0.10, "code": 0.10, "math": 0.10}
MIXTURE_TEMPERATURE = 0.5
MIX_CAPS = (150_000, 80_000, 20_000)
MIX_FRACTIONS = (0.60, 0.25, 0.15)
SHUFFLE_BUFFER = 128

REPEATS = 4096  # emissions of one row that are made from one array


def hash_key(seed: int | str, *keys: str | Column) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def hash_block(h: str | Column) -> Column:
    """Leading 16 bits of a hex digest: 65,536 even blocks.

    Written as never null, so a join on it adds no filter that hashes a second time.
    """
    h = F.col(h) if isinstance(h, str) else h
    return F.coalesce(F.conv(F.substring(h, 1, 4), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


# ---- dedup --------------------------------------------------------------------

def content_hash(*cols: str) -> Column:
    """``sha1(a||"||"||b...)`` over the UTF-8 text."""
    return F.sha1(F.concat_ws("||", *[F.coalesce(F.col(c), F.lit("")) for c in cols]).cast("binary"))


def dedup_exact(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Keep the first row in order per distinct content.

    Rank 1 is pruned on the map side (window group limit), so a text copied a
    billion times sends one row per task to its hash partition.
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy("__h").orderBy(*order)
    return (df.withColumn("__h", content_hash(*keys))
            .withColumn("__r", F.row_number().over(w))
            .filter(F.col("__r") == 1).drop("__h", "__r"))


# ---- sampling -------------------------------------------------------------------

def shuffle_rows(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in seeded hash order (a range-partitioned sort)."""
    return df.withColumn("__h", hash_key(seed, key)).orderBy("__h", key).drop("__h")


def shuffle_index(df: DataFrame, seed: int, key: str, out: str = "pos") -> DataFrame:
    """Position of each row in the seeded shuffle, without sorting everything."""
    d = df.withColumn("__h", hash_key(seed, key))
    return row_index(d, ["__h", key], out, block=hash_block("__h"), key_bits=32).drop("__h")


def sample_n(df: DataFrame, n: int | DataFrame, seed: int, key: str | Sequence[str],
             group: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle (per group; quotas allowed); ``key`` may be several columns."""
    key = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("__h", hash_key(seed, *key))
    return first_n(d, n, ["__h", *key], group, block=hash_block("__h"), key_bits=32).drop("__h")


def block_shuffle(df: DataFrame, order: str, seed: int, buffer: int = SHUFFLE_BUFFER,
                  key_bits: int = KEY_BITS) -> DataFrame:
    """Shuffle inside consecutive buffers; the last partial one keeps its order.

    Adds ``pos``, the new global position, and ``block``.
    """
    d = row_index(df, order, "__i", key_bits=key_bits, bits=WIDE_BITS)
    d = d.withColumn("block", int_div("__i", buffer))
    whole = F.count("*").over(Window.partitionBy("block")) == buffer
    # one fixed-width sort key: hash for full buffers, original position for the rest
    d = d.withColumn("__k", F.when(whole, hash_key(seed, order))
                     .otherwise(F.lpad(F.col("__i").cast("string"), 32, "0")))
    w = Window.partitionBy("block").orderBy("__k", order)
    return (d.withColumn("pos", F.col("block") * buffer + F.row_number().over(w) - 1)
            .drop("__i", "__k"))


def cap_per_group(df: DataFrame, group: str, n: int, order: str, key_bits: int = KEY_BITS) -> DataFrame:
    """First ``n`` rows per group; 0 keeps everything."""
    return df if not n else first_n(df, n, order, [group], key_bits=key_bits)


def cap_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """First ``n`` rows; 0 keeps everything."""
    return df if not n else first_n(df, n, order)


# ---- splits -----------------------------------------------------------------------

def head_split(df: DataFrame, cap: int, ratio: float, order: str, text: str = "text",
               at_least_one: bool = True) -> DataFrame:
    """Add ``split``: the head of the first ``cap`` rows is validation, the rest train.

    Positions count all rows; empty texts are dropped afterwards.
    """
    val = int(cap * ratio)
    val = max(1, val) if at_least_one else val
    d = first_n(df, cap, order, index="__i")
    return (d.withColumn("split", F.when(F.col("__i") < val, "validation").otherwise("train"))
            .filter(F.coalesce(F.col(text), F.lit("")) != "").drop("__i"))


def hash_split(df: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Add ``split`` by a hash threshold: narrow, and stable when rows are added."""
    cut = int(ratio * 16 ** 8)
    v = F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(v < cut, "test").otherwise("train"))


def exact_split(df: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Add ``split`` with exactly ``ceil(ratio * rows)`` test rows, by seeded shuffle."""
    n = df.agg(F.ceil(F.count("*") * F.lit(ratio))).scalar()
    d = shuffle_index(df, seed, key, "__i")
    return d.withColumn("split", F.when(F.col("__i") < n, "test").otherwise("train")).drop("__i")


# ---- mixing -----------------------------------------------------------------------

def mixture_manifest(spark, weights: dict[str, float] | None = None,
                     temperature: float = MIXTURE_TEMPERATURE, root: str = "") -> DataFrame:
    weights = weights or MIXTURE_WEIGHTS
    rows = [(n, "text", f"{root}/bucket={n}", float(w), temperature) for n, w in weights.items()]
    return spark.createDataFrame(
        rows, "source string, type string, path string, weight double, temperature double")


def temperature_weights(spec: DataFrame, temperature: float | None, weight: str = "weight") -> DataFrame:
    """Add ``prob``: ``w/sum`` for T null or <= 0, else ``w**(1/T)/sum``.

    The window spans the specification (one row per source).
    """
    w = F.col(weight)
    if temperature is not None and temperature > 0:
        w = F.pow(w, F.lit(1.0 / temperature))
    return spec.withColumn("prob", w / F.sum(w).over(Window.partitionBy(F.lit(0))))


def attach_weights(df: DataFrame, spec: DataFrame, on: str = "source") -> DataFrame:
    """Source weights joined to rows. The specification has one row per source and
    is broadcast by Spark while it stays under the session's broadcast threshold."""
    return df.join(spec, on, "left")


def concat_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def mix_quotas(counts: DataFrame, caps: dict[str, int], fractions: dict[str, float],
               source: str = "source") -> DataFrame:
    """``(source, k)`` with ``k = int(sum(min(n, cap)) * fraction)``; ``counts`` has ``n``."""
    def pick(table: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(source)]

    capped = counts.filter(F.col(source).isin(*caps))
    total = F.sum(F.least(F.col("n"), pick(caps).cast("bigint"))).over(Window.partitionBy(F.lit(0)))
    return capped.select(source, F.floor(total * pick(fractions)).cast("bigint").alias("k"))


def fraction_mix(df: DataFrame, caps: dict[str, int], fractions: dict[str, float],
                 key: str | Sequence[str], source: str = "source", seed: int = 42) -> DataFrame:
    """Take ``min(k, n)`` seeded-random rows of each source."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    return sample_n(df, mix_quotas(counts, caps, fractions, source), seed, key, [source])


def interleave(df: DataFrame, probs: DataFrame, order: str, source: str = "source",
               key_bits: int = KEY_BITS) -> DataFrame:
    """Mix sources by probability until each was used up once; small ones repeat.

    ``N = max(ceil(n_i / p_i))`` draws give source i ``k_i = round(N * p_i)`` of
    them. Emission ``e`` of source i sits at ``(e + 0.5) / p_i``; sorting by that
    spreads every source evenly. Each row is emitted ``k_i / n_i`` times.
    """
    counts = df.groupBy(source).agg(F.count("*").alias("__n"))
    plan = counts.join(probs.select(source, F.col("prob").alias("__p")), source)
    total = F.max(F.ceil(F.col("__n") / F.col("__p"))).over(Window.partitionBy(F.lit(0)))
    draws = F.greatest(F.round(total * F.col("__p")).cast("bigint"), F.col("__n"))
    plan = plan.select(source, "__n", draws.alias("__k"), "__p")
    # one row per source: broadcast by Spark once its real size is known
    d = row_index(df, order, "__i", [source], key_bits=key_bits).join(plan, source)
    # repeats in two steps of at most REPEATS each, so no row holds all of them in one array
    times = int_div(F.col("__k") - 1 - F.col("__i"), F.col("__n")) + 1
    d = d.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("bigint"), int_div(times - 1, REPEATS))))
    first = F.col("__i") + F.col("__c") * REPEATS * F.col("__n")
    last = F.least(F.col("__k") - 1, first + (REPEATS - 1) * F.col("__n"))
    d = d.withColumn("e", F.explode(F.sequence(first, last, F.col("__n"))))
    return d.withColumn("at", (F.col("e") + 0.5) / F.col("__p")).drop("__i", "__n", "__k", "__p", "__c")


# ---- buckets ----------------------------------------------------------------------

def bucket_counts(df: DataFrame, path: str) -> DataFrame:
    return (df.select(classify_bucket(path).alias("bucket"))
            .groupBy("bucket").agg(F.count("*").alias("n")))

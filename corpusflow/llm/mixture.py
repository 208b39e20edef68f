"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

All DataFrame functions. A document's key is an exponential variate divided by its quality
weight; the least keys of a source are a weighted sample without replacement. A source first
takes its complete epochs, every document once each, and the fraction that is left goes along the
keys until the words are used up.

The running sum along the keys needs no task that holds a source: keys fall into blocks of about
``BLOCK`` documents (the key's distribution is known, so the block is computed, not sampled),
blocks into groups of ``BLOCK`` blocks, and totals are added level by level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BLOCK = 64
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and the characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest; the same on every run. ``key`` is never null."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 13), 16, 10)
    return (bits.cast("bigint").cast("double") + 0.5) / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(source, source_size, n)`` to ``target``: the water level over the sources.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words.
    A target stops at ``most`` times its source; with the sources ordered by the level at which
    they stop, prefix sums give the one level that spends everything. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("stop", F.col("source_size") * F.lit(float(most)) / F.col("w"))
    all_rows = Window.partitionBy()
    before = (Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    s = (s.withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * F.lit(float(most))).over(before), F.lit(0.0)))
         .withColumn("open", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("stopped")) / F.col("open")))
    # the level is the first one at or below its own stop; if all stop, every source is full
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(all_rows)["level"]
    full = F.col("source_size") * F.lit(float(most))
    return s.select("source", "source_size", "n", F.least(full, F.coalesce(level * F.col("w"), full)).alias("target"))


def running_sum(rows: DataFrame) -> DataFrame:
    """Add ``before``: words of the source's rows with a smaller key. Needs source, block, key, size."""
    src = F.struct("source")  # never null, so sources with a null name meet in plain joins
    rows = rows.withColumn("g", src)
    totals = rows.groupBy("g", "block").agg(F.sum("size").alias("s"))
    totals = totals.withColumn("top", F.floor(F.col("block") / BLOCK))
    tops = totals.groupBy("g", "top").agg(F.sum("s").alias("s"))

    def earlier(*part: str, by: str) -> Column:
        w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("s").over(w), F.lit(0))
    tops = tops.select("g", "top", earlier("g", by="top").alias("base"))
    base = (totals.withColumn("base1", earlier("g", "top", by="block")).join(tops, ["g", "top"])
            .select("g", "block", (F.col("base1") + F.col("base")).alias("base")))
    w = (Window.partitionBy("g", "block").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
            .join(base, ["g", "block"], "left")
            .withColumn("before", F.col("inside") + F.col("base")).drop("g", "inside", "base"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (3.0, 1.0, 2.0),
        share: float = 1.5, most: float = 2.0, seed: str = "mix", low: float = 0.25, unknown: float = 0.5,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col``, th (hash of the text), source, size, source_size, target, taken.

    ``size`` is the words of the text; ``taken`` the words the mix takes of it, repeats counted: the
    complete epochs in whole, then the document's share of the rest of its source's target, so
    the document at the border gives only its first words. ``quality`` has (``id_col``, quality 0 or 1):
    weight 1 for quality 1, ``low`` for 0, ``unknown`` otherwise.

    Null text has size 0 and is never taken; a null source is a source of its own, the last;
    a row without id draws its key by its text; repeated rows count each, ordered among themselves
    by text; a table without words takes nothing; an empty one gives an empty result; other columns
    are ignored. The texts are read once: what is needed of them is stored.
    """
    by_text = F.concat(F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("tie"), uniform(seed, F.coalesce(F.col(id_col).cast("string"), by_text)).alias("u")), "sizes")
    if quality is None:
        rows = rows.withColumn("w", F.lit(unknown))
    else:
        q = quality.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("q")).where("id is not null")
        rows = rows.join(q, "id", "left").withColumn(
            "w", F.when(F.col("q") == 1, F.lit(1.0)).when(F.col("q") == 0, F.lit(low)).otherwise(F.lit(unknown))).drop("q")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    target = source_targets(sizes, weights, share, most)
    t = target.select(F.struct("source").alias("g"), "source_size", "n", "target")
    key = -F.ln("u") / F.col("w")
    # 1 - exp(-low * key) lies in (0, 1) and is at most 1 / low times denser than even
    spot = 1 - F.exp(-F.col("key") * F.lit(min(low, unknown, 1.0)))
    rows = (rows.withColumn("key", key).withColumn("g", F.struct("source")).join(t, "g").drop("g")
            .withColumn("block", F.floor(spot * F.ceil(F.col("n") / BLOCK))))
    rows = running_sum(rows)
    words = F.floor(F.col("target") + F.lit(0.5)).cast("bigint")
    full = F.when(F.col("source_size") > 0, F.call_function("div", words, F.col("source_size"))).otherwise(F.lit(0))
    rest = words - F.col("full") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return (rows.withColumn("full", full).withColumn("rest", rest)
            .select(F.col("id").alias(id_col), F.col("tie").alias("th"), "source", "size", "source_size", "target",
                    (F.col("full") * F.col("size") + part).cast("bigint").alias("taken")))


def mixed(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``id_col``, ``source_col``, ``text_col``, size, source_size, target and taken, where taken > 0.

    Rows equal in id, source and text are one row with the words taken of all of them.
    """
    got = mix(docs, quality, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    got = (got.where("taken > 0").groupBy(F.col(id_col).alias("g_id"), F.col("source").alias("g_source"), F.col("th").alias("g_th"))
           .agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                F.sum("taken").alias("taken")))
    d = docs.select(F.col(id_col).alias("d_id"), F.col(source_col).alias("d_source"), F.col(text_col).alias("d_text"))
    d = d.withColumn("d_th", F.xxhash64("d_text")).dropDuplicates(["d_id", "d_source", "d_th"])
    cond = (F.col("d_id").eqNullSafe(F.col("g_id")) & F.col("d_source").eqNullSafe(F.col("g_source")) & (F.col("d_th") == F.col("g_th")))
    return d.join(got, cond).select(F.col("d_id").alias(id_col), F.col("d_source").alias(source_col), F.col("d_text").alias(text_col),
                                    "size", "source_size", "target", "taken")

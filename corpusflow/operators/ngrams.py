"""Count-based language model: the table-shaped stand-in for neural scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .tokens import BOS

# A key above this share of the rows is salted, or above one shuffle partition's even share
# where that is less; by counting there are at most 1 / share of them, which bounds what is broadcast.
HOT_SHARE = 0.001


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], row_key: Sequence[str],
                how: str = "left", share: float | None = None, salts: int | None = None) -> DataFrame:
    """Equi-join where a key of ``left`` may hold a large part of all rows.

    Keys above ``share`` of the left rows (at most ``1/share`` of them) are marked
    by a broadcast; their rows are spread over as many partitions as they hold shares (or
    ``salts``) and the matching right rows are repeated that often. Everything else joins as usual.
    """
    keys = list(keys)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = share or min(HOT_SHARE, 1.0 / parts)
    counts = left.groupBy(*keys).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c")).scalar()
    n = F.lit(salts) if salts else F.ceil(F.col("__c") / (total * share))
    hot = F.broadcast(counts.filter(F.col("__c") > total * share).select(*keys, n.cast("int").alias("__n")))
    salt = F.when(F.col("__n") > 1, F.pmod(F.xxhash64(*row_key), F.col("__n"))).otherwise(F.lit(0))
    a = left.join(hot, keys, "left").withColumn("__s", salt.cast("int")).drop("__n")
    every = F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1)
    b = right.join(hot, keys, "left").withColumn("__s", F.explode(every)).drop("__n")
    return a.join(b, [*keys, "__s"], how).drop("__s")


# ---- counting -------------------------------------------------------------------

def ngrams(ids: Column | str, n: int) -> Column:
    """All runs of ``n`` adjacent entries; empty when the list is shorter."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    last = F.size(ids) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: F.slice(ids, i + 1, n)))


def ngram_counts(df: DataFrame, n: int, ids: str = "ids", group: Sequence[str] = ()) -> DataFrame:
    """``(group..., gram, n)``; counts are summed before the shuffle."""
    return (df.select(*group, F.explode(ngrams(ids, n)).alias("gram"))
            .groupBy(*group, "gram").agg(F.count("*").alias("n")))


def transitions(df: DataFrame, key: Sequence[str], ids: str = "ids", bos: int = BOS) -> DataFrame:
    """One row per token: ``key..., pos, ctx, tok``."""
    pairs = F.arrays_zip(F.concat(F.array(F.lit(bos)), F.col(ids)).alias("ctx"), F.col(ids).alias("tok"))
    # the longer list leaves one entry without a token at the end
    return (df.select(*key, F.posexplode(pairs).alias("pos", "t")).filter(F.col("t.tok").isNotNull())
            .select(*key, F.col("pos").cast("bigint").alias("pos"), "t.ctx", "t.tok"))


def bigram_counts(df: DataFrame, ids: str = "ids", group: Sequence[str] = (), bos: int = BOS) -> DataFrame:
    """``(group..., ctx, tok, n)``."""
    return (transitions(df, group, ids, bos).groupBy(*group, "ctx", "tok")
            .agg(F.count("*").alias("n")))


def context_counts(bigrams: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return bigrams.groupBy(*group, "ctx").agg(F.sum("n").alias("ctx_n"))


# ---- scoring ----------------------------------------------------------------------

def score_tokens(tokens: DataFrame, bigrams: DataFrame, vocab_size: int, k: float = 1.0,
                 key: Sequence[str] = ("doc_id",), group: Sequence[str] = ()) -> DataFrame:
    """Add ``logp`` = ln((n(ctx,tok)+k) / (n(ctx)+k*V)).

    ``group`` names the model column. The counts are stored once, so the training text is read once and both
    joins know how large their right side is: small counts are broadcast, and beside large ones AQE splits the
    partitions of frequent bigrams and contexts, as every left row only looks its count up.
    """
    group = list(group)
    bigrams = materialize(bigrams, "bigrams")
    d = tokens.join(bigrams, [*group, "ctx", "tok"], "left")
    d = d.join(context_counts(bigrams, group), [*group, "ctx"], "left")
    p = ((F.coalesce("n", F.lit(0)) + F.lit(float(k)))
         / (F.coalesce("ctx_n", F.lit(0)) + F.lit(float(k) * vocab_size)))
    return d.withColumn("logp", F.log(p)).drop("n", "ctx_n")


def seq_logprob(scored: DataFrame, key: Sequence[str], prompt_len: str | None = None) -> DataFrame:
    """``key..., logp, n_tok`` over completion tokens (``pos >= prompt_len``)."""
    d = scored.filter(F.col("pos") >= F.col(prompt_len)) if prompt_len else scored
    return d.groupBy(*key).agg(F.sum("logp").alias("logp"), F.count("*").alias("n_tok"))


def with_models(df: DataFrame, models: list[str], out: str = "model") -> DataFrame:
    """Every row once per model of a given list; narrow, no join."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(m) for m in models])))


# ---- next-token tables --------------------------------------------------------------

def next_token_probs(bigrams: DataFrame) -> DataFrame:
    """``ctx, tok, p``. The totals share the partitioning by ``ctx`` with the join."""
    return (bigrams.join(context_counts(bigrams), "ctx")
            .select("ctx", "tok", (F.col("n") / F.col("ctx_n")).alias("p")))


def next_token_topk(bigrams: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` continuations per context; ranks are pruned before the shuffle."""
    w = Window.partitionBy("ctx").orderBy(F.desc("n"), "tok")
    top = bigrams.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return (top.join(context_counts(bigrams), "ctx")
            .select("ctx", "tok", "rank", (F.col("n") / F.col("ctx_n")).alias("p")))


def nucleus(bigrams: DataFrame, top_p: float = 0.9) -> DataFrame:
    """Smallest head of the continuations kept by nucleus sampling, renormalised.

    A token is cut when the running share including it exceeds ``top_p``; the first
    stays. Running sums are integer counts, so equal shares stay equal. A context
    has at most one row per vocabulary entry.
    """
    w = Window.partitionBy("ctx").orderBy(F.desc("n"), "tok")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ctx")
    d = (bigrams.withColumn("rank", F.row_number().over(w))
         .withColumn("cum", F.sum("n").over(run)).withColumn("total", F.sum("n").over(whole))
         .filter((F.col("rank") == 1) | (F.col("cum") <= F.lit(top_p) * F.col("total"))))
    kept = F.sum("n").over(whole)
    return d.select("ctx", "tok", "rank", (F.col("n") / kept).alias("p"))

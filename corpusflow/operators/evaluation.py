"""Perplexity, preference metrics, rewards and leaderboards over score rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import reward
from .index import first_n, join_whole

# Limits used by the metrics.
LOSS_CAP_FOR_PPL = 30.0
NAN_RANK = 1e9
ACCURACY = 10_000  # a sketch is off by one part in so many of the rows at most
GROUPS = 10_000    # groups whose brackets are broadcast


# ---- perplexity -------------------------------------------------------------------

def ppl_unweighted(df: DataFrame, loss: str = "loss", group: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*group).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))
            .withColumn("ppl", F.exp("loss")))


def ppl_weighted(df: DataFrame, loss: str = "loss", n_tok: str = "n_tok",
                 group: Sequence[str] = ()) -> DataFrame:
    """Weight of a text is its token count."""
    return (df.groupBy(*group)
            .agg((F.sum(F.col(loss) * F.col(n_tok)) / F.sum(n_tok)).alias("loss"),
                 F.sum(n_tok).alias("n_tok"))
            .withColumn("ppl", F.exp("loss")))


def ppl_completion(df: DataFrame, nll: str = "nll", n_tok: str = "n_tok",
                   group: Sequence[str] = ()) -> DataFrame:
    """NaN loss without tokens; infinite ppl when the loss is NaN or at least 30."""
    d = df.groupBy(*group).agg(F.coalesce(F.sum(nll), F.lit(0.0)).alias("__n"),
                               F.coalesce(F.sum(n_tok), F.lit(0)).alias("n_tok"))
    loss = F.when(F.col("n_tok") > 0, F.col("__n") / F.col("n_tok")).otherwise(F.lit(float("nan")))
    d = d.withColumn("loss", loss)
    ok = ~F.isnan("loss") & (F.col("loss") < LOSS_CAP_FOR_PPL)
    return d.withColumn("ppl", F.when(ok, F.exp("loss")).otherwise(F.lit(float("inf")))).drop("__n")


def compare_models(df: DataFrame, max_n: int | None = 10, order: str = "item_id",
                   loss: str = "loss", model: str = "model") -> DataFrame:
    """Mean loss and ppl per model over its first ``max_n`` items, or all."""
    d = df if max_n is None else first_n(df, max_n, order, [model])
    return ppl_unweighted(d, loss, [model])


# ---- leaderboards -----------------------------------------------------------------

def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    # one row per model: the window runs over the list of models
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def leaderboard_loss(df: DataFrame, loss: str = "loss", model: str = "model") -> DataFrame:
    """Ascending loss, NaN last."""
    return _ranked(df, F.when(F.isnan(loss), NAN_RANK).otherwise(F.col(loss)), F.col(model))


def leaderboard_ppl(df: DataFrame, ppl: str = "ppl", model: str = "model") -> DataFrame:
    return _ranked(df, F.col(ppl).asc(), F.col(model))


def leaderboard_acc(df: DataFrame, acc: str = "acc", model: str = "model") -> DataFrame:
    return _ranked(df, F.col(acc).desc(), F.col(model))


# ---- quantiles --------------------------------------------------------------------

def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    group: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per entry of ``probs``.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here one pass of mergeable
    sketches gives two values around each wanted rank. A second pass counts what lies below them, and the values between
    them one by one: about ``8 / accuracy`` of the rows. Both passes add up on the map side, so a group of all rows is spread
    over all tasks. Groups are joined by broadcast up to ``GROUPS`` of them. A rank outside its bracket raises.
    """
    g = list(group)
    d = df.filter(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("v"))
    if not g:
        d, g = d.withColumn("__g", F.lit(0)), ["__g"]
    margin = 4.0 / accuracy  # the sketch errs by a quarter of it
    cuts = sorted({c for p in probs.values() for c in (p - margin, p + margin) if 0 < c < 1})
    sketch = [F.percentile_approx("v", cuts, accuracy).alias("e")] if cuts else []
    edges = d.groupBy(*g).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"), *sketch)

    def edge(p: float, beyond: str) -> Column:
        if p not in cuts:
            return F.col(beyond)
        return F.when(F.col("n") >= accuracy, F.col("e")[cuts.index(p)]).otherwise(F.col(beyond))  # few values: all of them
    brackets = edges.select(*g, F.array(*[F.struct(
        F.lit(name).alias("q"), ((F.col("n") - 1) * F.lit(float(p))).alias("at"), edge(p - margin, "least").alias("low"),
        edge(p + margin, "most").alias("high")) for name, p in probs.items()]).alias("qs"))
    rows = brackets.limit(GROUPS + 1).collect()
    if len(rows) <= GROUPS:
        brackets = F.broadcast(df.sparkSession.createDataFrame(rows, brackets.schema))
    near = join_whole(d, brackets, g).select(
        *g, "v", F.explode(F.filter("qs", lambda x: F.col("v") <= x["high"])).alias("x"))
    # one row for all that lies below a bracket, one for each value inside
    counts = (near.groupBy(*g, "x.q", "x.at", F.when(F.col("v") >= F.col("x.low"), F.col("v")).alias("v"))
              .agg(F.count("*").alias("c")))
    before = Window.partitionBy(*g, "q").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("lo", F.coalesce(F.sum("c").over(before), F.lit(0))).filter(F.col("v").isNotNull())

    def inside(r: Column) -> Column:
        return (r >= F.col("lo")) & (r < F.col("lo") + F.col("c"))
    counts = counts.filter(inside(F.floor("at")) | inside(F.ceil("at")))
    aggs = []
    for name in probs:
        mine = F.col("q") == name
        low = F.max(F.when(mine & inside(F.floor("at")), F.col("v")))
        high = F.max(F.when(mine & inside(F.ceil("at")), F.col("v")))
        part = F.max(F.when(mine, F.col("at") - F.floor("at")))
        found = F.when(low.isNull() | high.isNull(), F.raise_error(F.lit(f"rank of {name} outside its bracket")).cast("double"))
        aggs.append(found.otherwise(F.when(part == 0, low).otherwise(low + (high - low) * part)).alias(name))
    return counts.groupBy(*g).agg(*aggs).drop("__g")


# ---- pairs --------------------------------------------------------------------------

def join_pair_scores(chosen: DataFrame, rejected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scores of both answers of a pair on one row: ``lp_chosen, lp_rejected, ...``."""
    a = chosen.select(*key, F.col("logp").alias("lp_chosen"), F.col("n_tok").alias("len_chosen"))
    b = rejected.select(*key, F.col("logp").alias("lp_rejected"), F.col("n_tok").alias("len_rejected"))
    return a.join(b, list(key))


def pair_metrics(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Count, accuracy, margin statistics and mean lengths; a tie is not a win."""
    d = pairs.withColumn("margin", F.col("lp_chosen") - F.col("lp_rejected")).withColumn("__all", F.lit(0))
    keys = list(group) or ["__all"]
    base = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.col("lp_chosen") > F.col("lp_rejected")).cast("double")).alias("acc"),
        F.avg("margin").alias("margin_mean"),
        F.avg("len_chosen").alias("len_chosen_tokens_mean"),
        F.avg("len_rejected").alias("len_reject_tokens_mean"))
    q = exact_quantiles(d, "margin", {"margin_median": 0.5, "margin_p95": 0.95}, keys)
    return join_whole(base, q, keys).drop("__all")


# ---- rewards --------------------------------------------------------------------------

def score_answers(predictions: DataFrame, truths: DataFrame, key: Sequence[str],
                  kind: str = "boxed") -> DataFrame:
    """Prediction joined to its ground truth by key, with a ``reward`` column."""
    d = predictions.join(truths, list(key))
    return d.withColumn("reward", reward(kind)(F.col("completion"), F.col("ground_truth")))


def accuracy(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*group).agg(F.count("*").alias("n"), F.avg("reward").alias("accuracy"))


def pass_rate(checked: DataFrame, group: Sequence[str] = ("check",)) -> DataFrame:
    """Passed, total and rate per group; ``()`` for the overall rate."""
    ok = F.col("ok").cast("int")
    return checked.groupBy(*group).agg(F.sum(ok).alias("passed"), F.count("*").alias("total"),
                                       F.avg(ok).alias("rate"))

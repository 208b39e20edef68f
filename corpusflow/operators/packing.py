"""Packing token rows to fixed-length sequences, collating and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .index import BLOCK_BITS, KEY_BITS, WIDE_BITS, int_div, prefix_sum, row_index
from .mixing import SHUFFLE_BUFFER, block_shuffle
from .tokens import IGNORE, PAD, pad_to

# Defaults of the batch-local packing and of pair truncation.
BATCH_ROWS = 1000
SHARD_SEQS = 10_000
MAX_PROMPT_LEN = 768
MAX_LEN = 1024
MIN_RESP = 32


def _segments(df: DataFrame, ids: str, seq_len: int, group: list[str]) -> DataFrame:
    """Cut every row at sequence boundaries: ``group, seq, at, piece``.

    A row gives one segment per sequence it touches, about ``rows + tokens / L``
    rows in all; token rows are never made.
    """
    n, s = F.size(F.col(ids)), F.col("start")
    d = df.filter(n > 0).withColumn("end", s + n)
    d = d.withColumn("seq", F.explode(F.sequence(int_div(s, seq_len), int_div(F.col("end") - 1, seq_len))))
    lo = F.greatest(F.col("seq") * seq_len - s, F.lit(0))
    hi = F.least((F.col("seq") + 1) * seq_len, F.col("end")) - s
    piece = F.slice(F.col(ids), (lo + 1).cast("int"), (hi - lo).cast("int"))
    return d.select(*group, "seq", (s + lo).alias("at"), piece.alias("piece"))


def _assemble(segments: DataFrame, seq_len: int, group: list[str]) -> DataFrame:
    """Join the pieces of each sequence; at most ``seq_len`` pieces per key."""
    parts = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return (segments.groupBy(*group, "seq")
            .agg(F.flatten(F.transform(parts, lambda p: p["piece"])).alias("input_ids"))
            .filter(F.size("input_ids") == seq_len))


def pack(df: DataFrame, seq_len: int, order: str, ids: str = "ids", n_tok: str | None = None,
         key_bits: int = KEY_BITS, block: str | None = None) -> DataFrame:
    """Concatenate all ids in order, cut to ``seq_len``, drop the tail.

    Returns ``seq_id, input_ids``. ``n_tok`` names a stored or cheap length column;
    without it the ids are read for their length too. ``block`` names a column that
    already groups neighbours; rows partitioned by it are not shuffled again.
    """
    length = F.col(n_tok) if n_tok else F.size(F.col(ids))
    d = df.select(order, ids, length.cast("bigint").alias("__n"), *([block] if block else []))
    d = prefix_sum(d, F.col("__n"), "start", order, block=F.col(block) if block else None,
                   key_bits=key_bits, bits=BLOCK_BITS if block else WIDE_BITS)
    return _assemble(_segments(d, ids, seq_len, []), seq_len, []).select(
        F.col("seq").alias("seq_id"), "input_ids")


def with_shard(packed: DataFrame, shard_seqs: int = SHARD_SEQS) -> DataFrame:
    return packed.withColumn("shard", int_div("seq_id", shard_seqs))


def pack_by_batch(df: DataFrame, seq_len: int, order: str, ids: str = "ids",
                  batch_rows: int = BATCH_ROWS, key_bits: int = KEY_BITS) -> DataFrame:
    """Pack inside consecutive groups of ``batch_rows`` rows, dropping every tail.

    The grouping by (batch, sequence) reuses the batch partitioning of the window.
    """
    d = row_index(df.select(order, ids), order, "__i", key_bits=key_bits, bits=WIDE_BITS)
    d = d.withColumn("batch", int_div("__i", batch_rows))
    w = Window.partitionBy("batch").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum(F.size(ids)).over(w), F.lit(0).cast("bigint")))
    return _assemble(_segments(d, ids, seq_len, ["batch"]), seq_len, ["batch"]).select(
        "batch", F.col("seq").alias("seq_id"), "input_ids")


def pack_training(df: DataFrame, seq_len: int, order: str, seed: int, ids: str = "ids",
                  n_tok: str | None = None, buffer: int = SHUFFLE_BUFFER,
                  key_bits: int = KEY_BITS) -> DataFrame:
    """Buffer shuffle, pack, labels equal to the ids, mask of ones."""
    cols = [order, ids] + ([n_tok] if n_tok else [])
    d = block_shuffle(df.select(*cols), order, seed, buffer, key_bits)
    return (pack(d, seq_len, "pos", ids, n_tok, key_bits, block="block")
            .withColumn("labels", F.col("input_ids"))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), seq_len)))


def shuffled_starts(df: DataFrame, order: str, seed: int, n_tok: str, buffer: int = SHUFFLE_BUFFER,
                    key_bits: int = KEY_BITS) -> DataFrame:
    """Buffer shuffle without the ids: adds ``start``, the number of tokens before each row."""
    d = block_shuffle(df, order, seed, buffer, key_bits)
    d = prefix_sum(d, F.col(n_tok).cast("bigint"), "start", "pos", block=F.col("block"), key_bits=key_bits)
    return d.drop("pos", "block")


def pack_placed(starts: DataFrame, rows: DataFrame, key: list[str], seq_len: int, ids: str = "ids",
                n_tok: str = "n_tok") -> DataFrame:
    """``pack_training`` where places and ids come apart: ``starts`` has ``key, n_tok, start``, a key any number of
    times, ``rows`` has ``key, ids``, a key once.

    A sequence that lies inside one row is cut out of it where it is; only the pieces at both ends of
    a row, less than two sequences, are shuffled.
    """
    starts = materialize(starts.select(*key, "start", F.col(n_tok).alias("__n")).filter("__n > 0"), "starts")
    rows = rows.select(*key, F.col(ids).alias("__ids"))
    first = int_div(F.col("start") + (seq_len - 1), seq_len)  # whole sequences of a row are first to last - 1
    last = int_div(F.col("start") + F.col("__n"), seq_len)
    cut = lambda lo, n: F.slice("__ids", (lo + 1).cast("int"), n)
    inner = starts.filter(first < last).withColumns({"__f": first, "__t": last}).join(rows, key)
    inner = inner.withColumn("seq", F.explode(F.sequence("__f", F.col("__t") - 1)))
    inner = inner.select("seq", cut(F.col("seq") * seq_len - F.col("start"), seq_len).alias("input_ids"))
    # what is left: from the start to the first whole sequence, from behind the last one to the end
    lo, hi = F.col("start"), F.col("start") + F.col("__n")
    ends = F.array(F.struct(lo.alias("at"), F.least(hi, first * seq_len).alias("to")),
                   F.struct(F.greatest(lo, last * seq_len).alias("at"), hi.alias("to")))
    ends = F.when(first > last, F.slice(ends, 1, 1)).otherwise(ends)  # a row inside one sequence is one piece
    edge = starts.withColumn("__e", F.explode(F.filter(ends, lambda e: e["at"] < e["to"])))
    edge = edge.select(*key, "start", "__e.*").join(rows, key)
    edge = edge.select(int_div("at", seq_len).alias("seq"), "at",
                       cut(F.col("at") - F.col("start"), (F.col("to") - F.col("at")).cast("int")).alias("piece"))
    packed = inner.unionByName(_assemble(edge, seq_len, []).select("seq", "input_ids"))
    return (packed.select(F.col("seq").alias("seq_id"), "input_ids").withColumn("labels", F.col("input_ids"))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), seq_len)))


# ---- collation ------------------------------------------------------------------

def _mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def collate_fixed(df: DataFrame, max_length: int = 1024, pad: int = 0, ids: str = "input_ids") -> DataFrame:
    """Truncate or pad right; labels are the padded ids, mask is ``id != pad``."""
    d = df.withColumn(ids, pad_to(F.slice(F.col(ids), 1, max_length), max_length, pad))
    return d.withColumn("labels", F.col(ids)).withColumn("attention_mask", _mask(F.col(ids), pad))


def with_batches(df: DataFrame, batch_size: int, order: str, key_bits: int = KEY_BITS) -> DataFrame:
    d = row_index(df, order, "__i", key_bits=key_bits, bits=WIDE_BITS)
    return d.withColumn("batch_id", int_div("__i", batch_size)).drop("__i")


def collate_dynamic(df: DataFrame, pad: int = 0, ids: str = "input_ids", batch: str = "batch_id") -> DataFrame:
    """Pad to the longest row of the batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    d = df.withColumn("__m", longest).withColumn(ids, pad_to(F.col(ids), F.col("__m"), pad)).drop("__m")
    return d.withColumn("labels", F.col(ids)).withColumn("attention_mask", _mask(F.col(ids), pad))


def collate_packed(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Equal-length rows as they are, labels a copy."""
    return df.withColumn("labels", F.col(ids))


# ---- masking ----------------------------------------------------------------------

def _right(ids: Column, keep: Column) -> Column:
    return F.slice(ids, (F.size(ids) - keep + 1).cast("int"), keep.cast("int"))


def masked_pair(p: Column | str, c: Column | str, seq_len: int, min_resp: int = MIN_RESP,
                whole_prompt_at_zero: bool = False) -> Column:
    """Prompt and completion ids fitted to ``seq_len``, labels ignored on the prompt.

    Over length, the prompt keeps its right end (at most ``seq_len - min_resp - 1``),
    then the completion keeps ``max(min_resp, seq_len - prompt)`` from the left.
    ``whole_prompt_at_zero`` keeps the whole prompt where nothing of it would be left
    (the behaviour of a ``[-0:]`` slice).
    """
    p = F.col(p) if isinstance(p, str) else p
    c = F.col(c) if isinstance(c, str) else c
    np_, nc = F.size(p), F.size(c)
    over = np_ + nc - seq_len
    keep = F.least(F.greatest(np_ - over, F.lit(0)), F.lit(max(0, seq_len - min_resp - 1)))
    cut = _right(p, keep)
    if whole_prompt_at_zero:
        cut = F.when(keep == 0, p).otherwise(cut)
    p2 = F.when(over > 0, cut).otherwise(p)
    left = F.greatest(F.lit(min_resp), seq_len - F.size(p2))
    c2 = F.when(F.size(p2) + nc > seq_len, F.slice(c, 1, left)).otherwise(c)
    return F.struct(F.concat(p2, c2).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(IGNORE), F.size(p2)), c2).alias("labels"))


def mask_completion(df: DataFrame, prompt_ids: str, completion_ids: str, seq_len: int,
                    min_resp: int = MIN_RESP, batch: str | None = None, pad: int = PAD,
                    legacy_pad_labels: bool = False, whole_prompt_at_zero: bool = False) -> DataFrame:
    """Adds ``input_ids, labels, attention_mask``; with ``batch`` rows are padded to the
    longest of their batch. Pad labels are ignored, or the pad id in legacy mode."""
    d = df.withColumn("__m", masked_pair(prompt_ids, completion_ids, seq_len, min_resp,
                                         whole_prompt_at_zero)).select("*", "__m.*").drop("__m")
    n = F.size("input_ids")
    d = d.withColumn("__n", n).withColumn(
        "__max", F.max("__n").over(Window.partitionBy(batch)) if batch else F.col("__n"))
    return (d.withColumn("input_ids", pad_to(F.col("input_ids"), F.col("__max"), pad))
            .withColumn("labels", pad_to(F.col("labels"), F.col("__max"), pad if legacy_pad_labels else IGNORE))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("__n")),
                                                   F.array_repeat(F.lit(0), F.col("__max") - F.col("__n"))))
            .drop("__n", "__max"))


def truncate_pair(p: Column | str, c: Column | str, max_prompt: int = MAX_PROMPT_LEN,
                  max_len: int = MAX_LEN) -> Column:
    """Prompt cut from the left to ``max_prompt``; completion to what is left of ``max_len``."""
    p = F.col(p) if isinstance(p, str) else p
    c = F.col(c) if isinstance(c, str) else c
    p2 = _right(p, F.least(F.size(p), F.lit(max_prompt)))
    return F.struct(p2.alias("prompt_ids"),
                    F.slice(c, 1, F.greatest(max_len - F.size(p2), F.lit(0))).alias("completion_ids"))


def supervised_tokens(labels: Column | str) -> Column:
    return F.size(F.filter(F.col(labels) if isinstance(labels, str) else labels, lambda x: x != IGNORE))

"""Vocabulary learning and word-level encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow_text import WordIds, count_line_tokens, line_ids, list_ids, text_ids
from ..functions.text import WS, _col, not_blank, strip, text_or_empty, words
from ..session import materialize
from .index import first_n
from .mixing import hash_block, hash_key

# Special ids.
UNK, BOS, EOS, PAD = 0, 1, 2, 2
SPECIALS = ("<unk>", "<s>", "</s>")
IGNORE = -100

# A word can never hold white space, so a newline marks the end of a line.
LINE_END = "\n"


# ---- corpus side ------------------------------------------------------------

def lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per line: ``key, line_no, line`` (0-based, blank lines included)."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def clean_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stripped, non-blank lines."""
    return (lines(df, text, key).filter(not_blank("line"))
            .select(key, F.col("line_no").cast("bigint").alias("line_no"), strip("line").alias("line")))


def tokenizer_sample(df: DataFrame, n: int = 2_000_000, seed: int = 42, text: str = "text",
                     key: str = "doc_id") -> DataFrame:
    """At most ``n`` clean lines in seeded hash order."""
    d = clean_lines(df, text, key).withColumn("__h", hash_key(seed, key, "line_no"))
    return first_n(d, n, ["__h", key, "line_no"], block=hash_block("__h"), key_bits=32).drop("__h")


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Characters with counts; partial sums leave at most the alphabet per task."""
    return (df.select(F.explode(F.split(text_or_empty(text), "")).alias("ch"))
            .filter((F.col("ch") != "") & ~F.col("ch").rlike(f"^{WS}$"))
            .groupBy("ch").agg(F.count("*").alias("n")))


def char_coverage(df: DataFrame, coverage: float = 0.9995, text: str = "text") -> DataFrame:
    """Smallest set of most frequent characters whose share reaches ``coverage``.

    The window runs over the alphabet, at most 1,114,112 code points.
    """
    c = char_counts(df, text)
    w = Window.partitionBy(F.lit(0))
    before = w.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, -1)
    return (c.withColumn("total", F.sum("n").over(w))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .filter((F.col("before") == 0) | (F.col("before") < coverage * F.col("total")))
            .select("ch", "n"))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return (df.select(F.explode(words(text_or_empty(text))).alias("token"))
            .groupBy("token").agg(F.count("*").alias("n")))


def build_vocab(counts: DataFrame, size: int) -> DataFrame:
    """``token, n, id``: ids 0-2 are special, then by (count desc, token).

    The count at the cut comes first, from a table of counts, so only words at or above it
    are ordered; top-n follows, so the ranking window sees at most ``size`` rows. The counts are
    stored, so the texts behind them are read once.
    """
    counts = materialize(counts, "word-counts")
    by_count = counts.groupBy("n").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    cut = (by_count.withColumn("before", F.coalesce(run, F.lit(0))).filter(F.col("before") < size)
           .agg(F.min("n")).scalar())
    top = counts.filter(F.col("n") >= cut).orderBy(F.desc("n"), "token").limit(max(0, size - len(SPECIALS)))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")
    return top.select("token", "n",
                      (F.row_number().over(w) + len(SPECIALS) - 1).cast("int").alias("id"))


# ---- encoding -----------------------------------------------------------------

class Vocab:
    """A vocabulary of bounded size, sent to the workers once.

    ``limit`` is the proof of the bound: reading stops with an error beyond it. With
    ``first_byte`` an unknown word gives its UTF-8 bytes as ``first_byte + byte``
    instead of the unknown id.
    """

    def __init__(self, df: DataFrame, limit: int = 1_000_000, first_byte: int | None = None):
        rows = df.select("token", "id").limit(limit + 1).toArrow()
        if rows.num_rows > limit:
            raise ValueError(f"vocabulary has more than {limit} entries")
        self.size = rows.num_rows + len(SPECIALS)
        self.first_byte = first_byte
        self.data = df.sparkSession.sparkContext.broadcast(
            (rows["token"].combine_chunks().cast(pa.string()),
             rows["id"].combine_chunks().cast(pa.int32())))

    def word_ids(self) -> WordIds:
        """Lookup of flat words, one hash probe per word."""
        data, first_byte = self.data, self.first_byte

        def known(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            toks, ids = data.value
            got = pc.fill_null(pc.take(ids, pc.index_in(words, value_set=toks)), UNK)
            return got.to_numpy(zero_copy_only=False), np.ones(len(words), np.int64)

        def or_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            toks, ids = data.value
            got = pc.take(ids, pc.index_in(words, value_set=toks))
            missing = pc.is_null(got)
            raw = pc.if_else(missing, words, "").cast(pa.binary())
            n = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
            width = np.where(missing.to_numpy(zero_copy_only=False), n, 1)
            out = np.repeat(pc.fill_null(got, -1).to_numpy(zero_copy_only=False), width)
            out[out < 0] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).astype(np.int32) + first_byte
            return out, width

        return known if first_byte is None else or_bytes


def encode(tokens: Column | str, model, line_end: int = EOS) -> Column:
    """Ids of an ``array<string>`` column; ``LINE_END`` entries become ``line_end``.

    ``model`` is a ``Vocab`` or a ``BpeModel``. Rows keep their place: the lookup
    runs on Arrow batches and costs no shuffle.
    """
    word_ids = model.word_ids()

    def with_marks(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, width = word_ids(words)
        mark = pc.equal(words, LINE_END).to_numpy(zero_copy_only=False)
        if not mark.any():
            return ids, width
        keep = ~np.repeat(mark, width)
        out_width = np.where(mark, 1, width)
        out = np.full(int(out_width.sum()), line_end, np.int32)
        out[~np.repeat(mark, out_width)] = ids[keep]
        return out, out_width

    @F.arrow_udf("array<int>")
    def lookup(col: pa.Array) -> pa.Array:
        return list_ids(col, with_marks)

    return lookup(_col(tokens))


def encode_text(df: DataFrame, model, text: str = "text", out: str = "ids") -> DataFrame:
    """Ids of the words of a whole text, no specials added."""
    word_ids = model.word_ids()

    @F.arrow_udf("array<int>")
    def lookup(col: pa.Array) -> pa.Array:
        return text_ids(col, word_ids)

    return df.withColumn(out, lookup(text_or_empty(text)))


def line_token_count(text: Column | str, keep_blank: bool = False) -> Column:
    """Number of word tokens and line ends of a text; cheap next to encoding it."""
    @F.arrow_udf("int")
    def count(col: pa.Array) -> pa.Array:
        return count_line_tokens(col, keep_blank)

    return count(text_or_empty(text))


def encode_lines(df: DataFrame, model, text: str = "text", out: str = "ids",
                 line_end: int = EOS, keep_blank: bool = False) -> DataFrame:
    """Ids of all lines of a text, each ended by ``line_end``.

    Blank lines are dropped; with ``keep_blank`` only empty ones are. For a word
    vocabulary ``n_tok`` is added from a count of its own, so that running totals
    over it do not need the ids.
    """
    word_ids = model.word_ids()

    @F.arrow_udf("array<int>")
    def lookup(col: pa.Array) -> pa.Array:
        return line_ids(col, word_ids, line_end, keep_blank)

    ids = lookup(text_or_empty(text))
    if isinstance(model, Vocab) and model.first_byte is None:
        return df.withColumns({out: ids, "n_tok": line_token_count(text, keep_blank)})
    return df.withColumn(out, ids)


def with_eos(ids: Column | str, eos: int = EOS) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(ids, F.array(F.lit(eos)))


def with_newline(ids: Column | str, newline_ids: list[int]) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(ids, F.array(*[F.lit(i) for i in newline_ids]))


def pad_to(ids: Column, length: int | Column, value: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def padded_with_labels(df: DataFrame, ids: str = "ids", max_length: int = 128,
                       pad: int = PAD) -> DataFrame:
    """Truncate and pad to ``max_length``; labels are a copy, mask marks real tokens."""
    cut = F.slice(F.col(ids), 1, max_length)
    n = F.size(cut)
    return (df.withColumn("input_ids", pad_to(cut, max_length, pad))
            .withColumn("labels", F.col("input_ids"))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n),
                                                   F.array_repeat(F.lit(0), F.lit(max_length) - n)))
            .drop(ids))


def keep_right(ids: Column | str, ctx: int, reserve: int = 128) -> Column:
    """Right end of a token list so that a reply still fits the context."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    k = max(8, ctx - max(8, reserve))
    return F.slice(ids, F.greatest(F.size(ids) - k, F.lit(0)) + 1, k)


def mean_lengths(df: DataFrame, cols: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """Mean token count per id column: ``{output name: ids column}``."""
    aggs = [F.avg(F.size(F.col(c))).alias(o) for o, c in cols.items()]
    return df.groupBy(*(group or [])).agg(*aggs)

"""Cross-tokenizer alignment by exact-text deduplication (operator 11).

Texts are shuffled by the full text, so each distinct one is encoded by both tokenizers once and
carries its multiplicity. Both tokenizers always break before a single space between other
characters (the byte-level pattern does by itself; for the pieces it is checked that none holds the
space mark after another character), so a text is aligned chunk by chunk, and a task aligns
each distinct chunk once while it remembers it.

A task cuts its texts into blocks of about ``BLOCK`` bytes. A block is one row: its texts' measures,
its distinct id pairs with their weighted counts, and for each link the place of its pair in
that list. So what is shuffled for the corpus-wide counts is one row per block and pair, and what
comes back to a block is bounded by the block. Measures then join the documents by the text's digest.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

MARK = "▁"
BLOCK = 8 << 20  # bytes of text of one block
MEMO = 300_000   # remembered chunks of a task; forgotten between blocks, which changes no result
SHORT = 64       # only chunks up to so many characters are remembered
_BITS = 32       # a pair of ids as one number: id of B, then id of A


def byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Encodes and aligns chunks of texts; built once per task from the contents of both files."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        level = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in level for c in token)
            self.a_bytes[i] = bytes(level[c] for c in token) if known else token.encode()
        self.b_bytes = []
        cuts = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
            cuts &= re.search(f"[^{MARK}]{MARK}", piece) is None
        # a chunk begins at a single space between characters that are no white space
        self.cut = re.compile(r"(?<=\S) (?=\S)" if cuts else r"(?!)")

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that both tokenizers encode by themselves; each stands for a space and the part."""
        return self.cut.split(text)

    def encode(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        a = self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        return zip((x.ids for x in a), self.b.encode(chunks, num_threads=1))

    def align(self, chunk: str, a: list[int], b: list[int]) -> tuple[int, int, int, str, list[int]] | None:
        """(n_a, n_b, n_groups, groups, linked pairs) of one chunk; None where the bytes differ."""
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        want = b" " + chunk.encode()
        if b"".join(x) != want or b"".join(y) != want:
            return None
        x, y = list(accumulate(map(len, x))), list(accumulate(map(len, y)))  # where tokens end
        if x == y:
            return (len(a), len(b), len(a), ";".join([f"{p}|{q}" for p, q in zip(a, b)]),
                    [q << _BITS | p for p, q in zip(a, b)])
        groups, pairs = [], []
        i = j = 0
        for end in sorted({*x}.intersection(y)):
            k, m = x.index(end, i) + 1, y.index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            pairs.append(b[m - 1] << _BITS | a[k - 1])
            i, j = k, m
        return len(a), len(b), len(groups), ";".join(groups), pairs


class Block:
    """Texts of one block while it fills; what the task remembers lives in ``Task``."""

    def __init__(self):
        self.size = 0
        self.digests: list[bytes] = []
        self.weights: list[int] = []
        self.groups: list[str] = []
        self.entries: list[array] = []


class Task:
    """Remembers aligned chunks by number."""

    def __init__(self, aligner: Aligner, digest: bool):
        self.aligner, self.digest = aligner, digest
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = array("q")           # n_a, n_b, n_groups of each chunk
        self.text: list[str | None] = []  # None: the bytes differ
        self.pairs, self.ends = array("q"), array("q")

    def add(self, block: Block, digest: bytes, text: str, weight: int) -> None:
        parts = self.aligner.chunks(text)
        found = list(map(self.number.get, parts))
        if None in found:
            new = list({c for c, k in zip(parts, found) if k is None})
            numbers = dict(zip(new, range(len(self.text), len(self.text) + len(new))))
            for c, (a, b) in zip(new, self.aligner.encode(new)):
                n_a, n_b, n_groups, groups, pairs = self.aligner.align(c, a, b) or (0, 0, 0, None, [])
                self.sizes.extend((n_a, n_b, n_groups))
                self.text.append(groups)
                self.pairs.extend(pairs)
                self.ends.append(len(self.pairs))
            self.number.update(numbers if max(map(len, new)) <= SHORT else {c: k for c, k in numbers.items() if len(c) <= SHORT})
            found = [numbers[c] if k is None else k for c, k in zip(parts, found)]
        groups = list(map(self.text.__getitem__, found))
        if None in groups:
            found, groups = [], []
        joined = ";".join(groups)
        block.digests.append(digest)
        block.weights.append(weight)
        block.groups.append(hashlib.sha256(joined.encode()).hexdigest() if joined and self.digest else joined)
        block.entries.append(array("i", found))
        block.size += len(text) + 1

    def row(self, block: Block) -> dict:
        """The block as one row."""
        n = np.fromiter(map(len, block.entries), np.int64, len(block.entries))
        entry = np.fromiter(chain.from_iterable(block.entries), np.int64, int(n.sum()))
        sizes, ends = np.array(self.sizes, np.int64).reshape(-1, 3), np.array(self.ends, np.int64)
        starts = np.r_[0, ends[:-1]][:len(ends)]
        of_text = np.repeat(np.arange(len(n)), n)
        sums = [np.bincount(of_text, sizes[entry, k], len(n)).astype(np.int64) for k in range(3)]
        m = (ends - starts)[entry]
        link = np.repeat(starts[entry] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        pair, place = np.unique(np.array(self.pairs, np.int64)[link], return_inverse=True)
        links = np.bincount(of_text, m, len(n)).astype(np.int64)
        weight = np.repeat(np.array(block.weights, np.int64), links)
        count = np.zeros(len(pair), np.int64)
        np.add.at(count, place, weight)
        return {"digest": block.digests, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": links,
                "groups": block.groups, "link": place.astype(np.int32), "pair": pair, "n": count}


_BLOCK_SCHEMA = ("block bigint, digest array<binary>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
                 "n_links array<bigint>, groups array<string>, link array<int>, pair array<bigint>, n array<bigint>")
_KINDS = {"digest": pa.binary(), "groups": pa.string(), "link": pa.int32()}


def _one_row(block: int, row: dict) -> pa.RecordBatch:
    cols = [pa.array([block], pa.int64())]
    for k, v in row.items():
        flat = pa.array(v, _KINDS.get(k, pa.int64()))
        cols.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
    return pa.RecordBatch.from_arrays(cols, ["block", *row])


def aligned_blocks(texts: DataFrame, a_json: str, b_model: bytes, digest: bool, block_bytes: int) -> DataFrame:
    """Blocks of the distinct ``texts`` (digest, text, weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = None, Block()
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            task = task or Task(Aligner(a_json, b_model), digest)
            for d, t, w in zip(b.column("digest"), b.column("text"), b.column("weight")):
                task.add(block, d.as_py(), t.as_py(), w.as_py())
                if block.size >= block_bytes:
                    yield _one_row(number, task.row(block))
                    number, block = number + 1, Block()
                    if len(task.text) > MEMO:
                        task.forget()
        if block.digests:
            yield _one_row(number, task.row(block))
    return texts.mapInArrow(run, _BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: links corpus-wide of each id pair, and whether no pair of its B id has more.

    The broadcast table has one row per id of B at most, so the vocabulary bounds it.
    """
    each = blocks.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    counts = each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.shiftright("pair", _BITS))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _measures(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per distinct text with the measures that need corpus-wide counts."""
    wanted = blocks.select("block", F.posexplode("pair").alias("at", "pair"))
    back = (wanted.join(pairs, "pair").groupBy("block")
            .agg(F.collect_list(F.struct("at", "count", "best")).alias("counted")))  # as many as the block has pairs
    own = blocks.select("block", "digest", "n_a", "n_b", "n_groups", "n_links", "groups", "link")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                col = {c: b.column(c)[r].values for c in b.schema.names if c not in ("block", "counted")}
                links = col["n_links"].to_numpy(zero_copy_only=False)
                link = col["link"].to_numpy(zero_copy_only=False)
                count, best = np.zeros(1, np.int64), np.zeros(1, np.int64)
                if b.column("counted")[r].is_valid:
                    c = b.column("counted")[r].values
                    at = c.field("at").to_numpy(zero_copy_only=False)
                    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    count[at] = c.field("count").to_numpy(zero_copy_only=False)
                    best[at] = c.field("best").to_numpy(zero_copy_only=False)
                cut = np.r_[0, np.cumsum(links)]
                total, hits = np.r_[0, np.cumsum(count[link])], np.r_[0, np.cumsum(best[link])]
                yield pa.RecordBatch.from_arrays(
                    [col["digest"], col["n_a"], col["n_b"], col["n_groups"], col["n_links"],
                     pa.array(hits[cut[1:]] - hits[cut[:-1]]), pa.array(total[cut[1:]] - total[cut[:-1]]), col["groups"]],
                    ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
    return own.join(back, "block", "left").mapInArrow(
        run, "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          digest: bool = False, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(measures, pairs)`` of two tokenizers over all texts.

    ``a_path`` is a byte-level ``tokenizers`` file, which encodes a space and the text; ``b_path`` a
    sentencepiece model, which encodes the text and adds the space itself. measures has one row per row of
    ``docs``: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2``;
    with ``digest`` its lowercase SHA-256). pairs has (a, b, count): links corpus-wide, copies counted.

    Null, empty, and texts whose pieces do not give the same bytes back (a literal space mark, say) have no
    tokens: zeros and ''. Blank texts are encoded like others. Repeated rows and null ids keep a row each
    and weigh in; an empty table gives empty results; other columns are ignored. A text of any
    length is one piece of one block. Counts are exact, so ties are exact: all pairs with the highest count are best.
    """
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("weight"))
    distinct = distinct.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "weight")
    blocks = materialize(aligned_blocks(distinct, a_json, b_model, digest, block_bytes), "aligned")
    pairs = pair_counts(blocks)
    done = _measures(blocks, pairs)
    zero = F.lit(0).cast("bigint")
    measures = rows.select("__id", "digest").join(done, "digest", "left").select(
        F.col("__id").alias(id_col),
        *[F.coalesce(c, zero).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.coalesce("groups", F.lit("")).alias("groups"))
    of_a = F.col("pair").bitwiseAND(F.lit((1 << _BITS) - 1))
    return measures, pairs.select(of_a.alias("a"), F.shiftright("pair", _BITS).alias("b"), "count")

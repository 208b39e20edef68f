"""Best-fit packing with certified bin counts (operator 13).

Texts are encoded where they are read, cut into pieces of at most one sequence, and dealt evenly into
partitions of about ``TOKENS`` tokens, whatever the texts are. Each partition is packed best-fit
decreasing, and dual feasible functions give a lower bound on its bins: the identity, the rounding
functions u(k), and the threshold functions that drop small and round up large pieces. Where
the bound is met, no other packing of that partition has fewer bins.

Partitions with a gap then exchange documents: one whose bins exceed the rounded bound gives back
all bins that are not full, a certified one whose last bin is not covered by its bound gives back
its emptiest bin. What was given back is dealt anew, into partitions of the same size, and packed best-fit
decreasing again; the exchange stands if it takes fewer bins. That ends when the bound over all
pieces is met, nothing is won, or after ``rounds`` exchanges. Only row counts reach the driver.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from . import repeats

TOKENS = 1 << 22   # tokens of a partition
PIECES = 1 << 17   # pieces of a partition at most, on average
MEMO = 1_000_000   # remembered words of a task, about 150 bytes each; forgotten when full, which changes no id
JOINED = 512       # words of letters encoded in one call
TOGETHER = 4 << 20  # bytes of texts whose new words are encoded together
LONG = 64          # only words up to so many characters are remembered
_TAIL = ".,;:!?$&%#*"


class Encoder:
    """Ids of whole texts, by the library once per distinct word.

    The normaliser only composes characters, folds white space and lower-cases, and white space is dropped, so
    words between spaces and line breaks are encoded independently. That is checked on the file; if it does not
    hold, whole texts are encoded.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lib = tokenizers.Tokenizer.from_str(source)
        probe = "Ab  cd\nÉfg, 12 x's\n\nü "
        alone = b"".join(self._library(probe.split()))
        spaced = any(c.isspace() for t in self.lib.get_added_tokens_decoder().values() for c in t.content)
        self.by_word = not spaced and alone == self._library([probe])[0]
        self.folds = self.by_word and self._library(["ABCxyz"]) == self._library(["abcxyz"])
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a word of the pattern
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # words of small ASCII letters pass the normaliser and the pattern as they are, so only the model is needed
        self.plain = tokenizers.Tokenizer(self.lib.model)
        self.plain.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        probe = "the quick brown fox jumps over a lazy dog abcdefghijklmnopqrstuvwxyz x zzyzx"
        if not self.folds or self.plain.encode(probe).ids != self.lib.encode(probe, add_special_tokens=False).ids:
            self.plain = None
        self.forget()

    def _library(self, parts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        return [array("I", x.ids).tobytes() for x in self.lib.encode_batch_fast(parts, add_special_tokens=False)]

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64)  # ids of all words, and how many each has
        self.cores: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [np.frombuffer(self._library([t])[0], "<u4") for t in texts.to_pylist()]
        if len(self.number) > MEMO:
            self.forget()
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        found = list(map(self.number.get, words))
        new = sorted((w for w, k in zip(words, found) if k is None), key=len)
        kept = sum(len(w) <= LONG for w in new) + len(self.size)
        raw = self._new(new)
        pool = np.r_[self.pool, np.frombuffer(b"".join(raw), "<u4")]
        size = np.r_[self.size, np.fromiter(map(len, raw), np.int64, len(raw)) // 4]
        fresh = dict(zip(new, range(len(self.size), len(size))))
        at = np.array([fresh[w] if k is None else k for w, k in zip(words, found)], np.int64)[coded.indices.to_numpy()]
        n, first = size[at], (np.cumsum(size) - size)[at]
        ends = np.cumsum(n)
        ids = pool[np.arange(int(n.sum())) + np.repeat(first - (ends - n), n)]
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]].tolist()
        self.pool, self.size = pool[:int(size[:kept].sum())], size[:kept]
        self.number.update((w, k) for w, k in fresh.items() if k < kept)
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def _new(self, words: list[str]) -> list[bytes]:
        """A letter before closing marks ends a word of the pattern, so both sides are looked up alone."""
        cores, tails = [], []
        for w in words:
            core, tail = w.rstrip(_TAIL), ""
            if len(core) != len(w):
                last = core[-1:]
                # another letter may end in a mark once normalised
                if last.isalpha() if last.isascii() else unicodedata.normalize("NFC", last).lower().isalpha():
                    tail = w[len(core):]
                else:
                    core = w
            cores.append(core.lower() if self.folds and core.isascii() and "<" not in core else core)
            tails.append(tail)
        asked = {*cores, *tails}.difference(self.cores)
        letters = [p for p in asked if p.isalpha()]
        others = list(asked.difference(letters))
        got = dict(zip(others, self._library(others)))
        simple = [p for p in letters if p.isascii() and p.islower()] if self.plain else []
        for lib, some in ((self.plain, simple), (self.lib, list(set(letters).difference(simple)))):
            for i in range(0, len(some), JOINED):
                got.update(self._joined(lib, some[i:i + JOINED]))
        self.cores.update(got)
        known = self.cores
        out = [known[c] + known[t] if t else known[c] for c, t in zip(cores, tails)]
        for p in got:
            if len(p) > LONG:
                del known[p]
        return out

    def _joined(self, lib: tokenizers.Tokenizer, words: list[str]) -> zip:
        """Words with a letter in one call, cut behind the ids that end a word of the pattern.

        Each has one such id at least, so there are as many as words only if each has one; else they are asked one by one.
        """
        ids = np.array(lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return zip(words, self._library(words))
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        return zip(words, [raw[i:j] for i, j in zip([0, *cuts], cuts)])


def _stretches(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in order, in runs of about ``size`` bytes."""
    n = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    cuts = np.r_[0, np.flatnonzero(np.diff(n // size)) + 1, len(texts)] if len(texts) else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield texts.slice(i, j - i)


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32[, ids])``: the ids of each text and ``end``, cut every ``size`` ids."""
    with open(path, encoding="utf-8") as f:
        source = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = None, np.array([end], "<u4")
        for b in batches:
            encoder = encoder or Encoder(source)
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            texts = _stretches(b.column("text"), TOGETHER)
            for r, coded in enumerate(chain.from_iterable(map(encoder.encode_all, texts))):
                raw = np.r_[coded, last]
                for k, s in enumerate(range(0, len(raw), size)):
                    part = raw[s:s + size]
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int64))
            cols = [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if keep_ids else ""
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each size, given from large to small, and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    free = 0                                                   # bit r: some open bin has r free
    bins, at, n = [], [], 0
    for s in sizes:
        fits = free >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            left, b, n = capacity, n, n + 1
        bins.append(b)
        at.append(capacity - left)
        left -= s
        if left:
            if not room[left]:
                free |= 1 << left
            room[left].append(b)
    return bins, at, n


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[int, bool]:
    """Bins that ``counts`` pieces of ``sizes`` need at least, and whether that bound is met without rounding up."""
    x, n = sizes.astype(object), counts.astype(object)  # Python's whole numbers: no sum is rounded
    total = int((x * n).sum()) if len(x) else 0
    best = [(-(-total // capacity), total % capacity == 0)]
    for k in range(1, 21):  # u(k): a multiple of 1/(k+1) stays, others are rounded
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        top = int((value.astype(object) * n).sum()) if len(x) else 0
        best.append((-(-top // (k * capacity)), top % (k * capacity) == 0))
    by = np.zeros(capacity + 1, np.int64)
    np.add.at(by, sizes, counts)
    whole = np.cumsum(by[::-1])[::-1]                       # pieces of at least s
    mass = np.r_[0, np.cumsum(by * np.arange(capacity + 1))]  # size of pieces below s
    for e in range(1, capacity // 2 + 1):  # above capacity - e: a bin each; below e: nothing
        large = int(whole[capacity - e + 1])
        rest = int(mass[capacity - e + 1] - mass[e])
        best.append((large - (-rest // capacity), rest % capacity == 0))
    most = max(b for b, _ in best)
    return most, any(b == most and whole for b, whole in best)


def _pack_round(pieces: DataFrame, parts: int, capacity: int, seed: int) -> DataFrame:
    """Best-fit decreasing in each of ``parts`` partitions; adds part, bin, offset, bins, certified and released."""
    kind = pieces.schema["id"].dataType.simpleString()
    dealt = (pieces.withColumn("part", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(parts)))
             .repartition("part").sortWithinPartitions("part", F.desc("length"), "key"))
    names = [*pieces.columns, "part", "bin", "offset", "certified", "released"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.sorted_runs(batches, ["part"]):
            part = t["part"].to_numpy()
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(part)]):
                one = t.slice(a, b - a).combine_chunks()
                length = one["length"].to_numpy()
                bins, at, n = best_fit(length.tolist(), capacity)
                bins = np.array(bins)
                least, tight = lower_bound(*np.unique(length, return_counts=True), capacity)
                fill = np.bincount(bins, length, n)
                give = np.zeros(n, bool)
                if n > least:
                    give = fill < capacity
                elif not tight:
                    give[np.argmin(fill)] = True
                for c, v in (("bin", pa.array(bins)), ("offset", pa.array(at, pa.int64())),
                             ("certified", pa.array(np.full(len(bins), n == least))), ("released", pa.array(give[bins]))):
                    one = one.append_column(c, v)
                yield from one.select(names).to_batches()
    return dealt.mapInArrow(run, f"key bigint, id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                 "part bigint, bin bigint, offset bigint, certified boolean, released boolean")


def _parts(pieces: DataFrame) -> tuple[int, int]:
    """(partitions, pieces) for what there is."""
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return max(1, -(-total // TOKENS), -(-n // PIECES)), n


def _bins(packed: DataFrame) -> int:
    return packed.select("part", "bin").distinct().count()


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", rounds: int = 3) -> DataFrame:
    """``pieces`` (id_col, piece, start, length, ids_crc32) with sequence_id, offset and certified.

    Lengths are 1 to ``capacity``; each piece is placed once, sequences have no holes and start at 0.
    ``certified``: the partition that packed it has provably least bins. Rows of any ids, nulls and equal rows
    included, are dealt by their place in the stored table, so copies never share a task; an empty
    table gives an empty result. Ties of length go to the earlier row.
    """
    own = ["piece", "start", "length", "ids_crc32"]
    rows = materialize(pieces.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), *own), "pieces")
    parts, _ = _parts(rows)
    packed = materialize(_pack_round(rows, parts, capacity, 0), "packed")
    # at most one row per length, so at most ``capacity`` rows
    sizes = np.array(rows.groupBy("length").count().collect(), np.int64).reshape(-1, 2)
    least, _ = lower_bound(sizes[:, 0], sizes[:, 1], capacity)
    release(rows)
    total = _bins(packed)
    kept = []
    for turn in range(1, rounds + 1):
        open_ = packed.where("released")
        before = _bins(open_) if total > least else 0
        if not before:
            break
        again_parts, _ = _parts(open_)
        again = materialize(_pack_round(open_.select("key", "id", *own), again_parts, capacity, turn), "packed")
        after = _bins(again)
        if after >= before:
            release(again)
            break
        kept.append(packed.where("not released").withColumn("turn", F.lit(turn - 1)))
        packed, total = again, total - before + after
    out = packed.withColumn("turn", F.lit(len(kept)))
    for k in kept:
        out = out.unionByName(k)
    seq = (F.col("turn").cast("bigint") * F.lit(1 << 58)) + F.col("part") * F.lit(1 << 22) + F.col("bin")
    return out.select(F.col("id").alias(id_col), *own, seq.alias("sequence_id"), "offset", "certified")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", rounds: int = 3) -> DataFrame:
    """One row per piece of each document: id_col, piece, start, length, ids_crc32, sequence_id, offset, certified.

    Null text is empty: its only id is ``end``. Texts of any length are encoded whole and cut only where they exceed
    ``capacity`` ids. Repeated rows and null ids are packed like any other; other columns are ignored.
    """
    return pack(token_pieces(docs, path, capacity, end, id_col, text_col), capacity, id_col, rounds)


def sequences(packed: DataFrame, with_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(sequence_id, input_ids, starts)`` of each sequence: its ids and where its pieces begin.

    ``with_ids`` are the pieces with their ids (``token_pieces(..., keep_ids=True)``); pieces that agree
    in id, piece and checksum hold the same ids, so any of them serves. A sequence holds at most its capacity.
    """
    key = [id_col, "piece", "length", "ids_crc32"]
    ids = with_ids.groupBy(*key).agg(F.first("ids").alias("ids"))
    same = None
    for k in key:
        one = packed[k].eqNullSafe(ids[k])
        same = one if same is None else same & one
    rows = packed.join(ids, same).select("sequence_id", F.struct("offset", "ids").alias("x"))
    got = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return got.select("sequence_id", F.flatten(F.transform("x", lambda x: x["ids"])).alias("input_ids"),
                      F.transform("x", lambda x: x["offset"]).alias("starts"))

"""Byte-pair merges: learned on word types with Spark, applied in Arrow batches.

Word types are kept in blocks, one row each: the symbols of its types, and an inverted index from adjacent pair to
the types that hold it. A round sends the chosen merges to all blocks; a block looks them up, rewrites only the
types found, and reports by how much each pair's count changed. The counts are the sum of all such changes, so
nothing is counted again.

A pair of symbols is at most as frequent as the two characters that meet in it. So word types are cut wherever two characters
meet that are rarer than the merges looked for: no such merge crosses a cut, and equal runs between cuts are added up.
What is learned from is then the distinct runs, which are few however many word types there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush, nsmallest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, functions as F

from ..functions.arrow_text import WordIds
from ..session import materialize, release
from .tokens import SPECIALS

# Word-start mark and the layout of ids (specials, bytes, pieces).
WORD_START = "▁"
FIRST_BYTE = len(SPECIALS)
FIRST_PIECE = FIRST_BYTE + 256

BLOCK = 20_000          # word types of one block, about
ALPHABET = 1_114_112    # code points there are
MEETINGS = 1 << 20      # pairs of characters sent to the tasks at most; beyond that nothing is cut
CHUNK = 16_384          # words split together
LONG = 64               # longer words are split one by one
_STATE = ("block bigint, flat array<int>, first array<int>, size array<int>, n array<bigint>, "
          "keys array<bigint>, cuts array<int>, held array<int>, new_keys array<bigint>, new_held array<int>")
_CHANGE = "pair bigint, change bigint"


def alphabet(counts: DataFrame) -> DataFrame:
    """``(piece, n)`` of the single characters of word types ``token, n``, the word mark included."""
    ch = F.explode(F.split(F.concat(F.lit(WORD_START), "token"), "")).alias("piece")
    return counts.select("n", ch).where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))


def marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each behind the word mark, and the word of each."""
    codes = np.frombuffer("".join([WORD_START + w for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)


def meetings(counts: DataFrame) -> DataFrame:
    """``(pair, n)``: how often two characters, as ``first << 32 | second``, stand side by side in word types ``token, n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, of = marked(b.column("token").to_pylist())
            pair, of = _pairs(codes, of)
            pair, at = np.unique(pair, return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, at, b.column("n").to_numpy()[of])
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n)], ["pair", "n"])
    return counts.select("token", "n").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def runs_between(counts: DataFrame, pairs: list[int] | None) -> DataFrame:
    """``(run, n)``: word types ``token, n`` with their mark, cut wherever other characters than ``pairs`` meet.

    Runs of one character are left out, equal ones added up. Without ``pairs`` nothing is cut.
    """
    if pairs is None:
        return counts.select(F.concat(F.lit(WORD_START), "token").alias("run"), "n")
    known = counts.sparkSession.sparkContext.broadcast(np.sort(np.array(pairs, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for b in batches:
            words = b.column("token").to_pylist()
            codes, of = marked(words)
            if not len(codes):
                continue
            pair = codes[:-1] << 32 | codes[1:]
            joined = (of[1:] == of[:-1]) & _among(pair, keep)
            first = np.flatnonzero(np.r_[True, ~joined])
            size = np.diff(np.r_[first, len(codes)])
            width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes in UTF-8
            ends = np.r_[0, np.cumsum(width)]
            cuts = ends[np.r_[first, len(codes)]].astype(np.int32)
            flat = pa.py_buffer("".join([WORD_START + w for w in words]).encode())
            pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts.tobytes()), flat)
            long = pa.array(size > 1)
            n = pa.array(b.column("n").to_numpy()[of[first]])
            yield pa.RecordBatch.from_arrays([pieces.filter(long), n.filter(long)], ["run", "n"])
    return counts.select("token", "n").mapInArrow(run, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


class Block:
    """Some word types as symbol numbers, with the index from pair to type.

    ``keys`` are the sorted pairs of the index, ``held[cuts[k]:cuts[k + 1]]`` the types that hold the k-th. Pairs that
    appear later are appended to ``new_keys`` and ``new_held``; types that lost a pair stay listed and are
    found unchanged. Merging never makes a type longer, so it is rewritten where it stands.
    """

    ARRAYS = {"flat": np.int32, "first": np.int32, "size": np.int32, "n": np.int64, "keys": np.int64, "cuts": np.int32,
              "held": np.int32, "new_keys": np.int64, "new_held": np.int32}

    def __init__(self, **arrays: np.ndarray):
        for k, kind in self.ARRAYS.items():
            setattr(self, k, np.array(arrays[k], kind))

    @classmethod
    def of(cls, words: list[list[int]], n: list[int]) -> tuple[Block, np.ndarray, np.ndarray]:
        """The block of fresh types, and its pairs with their counts."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.array([x for w in words for x in w], np.int64)
        first = np.cumsum(size) - size
        inside = np.ones(len(flat), bool)
        inside[first + size - 1] = False  # the last symbol of a type begins no pair
        at = np.flatnonzero(inside)
        pair = flat[at] << 32 | flat[at + 1]
        of = np.repeat(np.arange(len(words)), size)[at]
        keys, back = np.unique(pair, return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        np.add.at(count, back, np.array(n, np.int64)[of])
        order = np.argsort(back, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(back, minlength=len(keys)))]
        none = np.zeros(0)
        return cls(flat=flat, first=first, size=size, n=n, keys=keys, cuts=cuts, held=of[order], new_keys=none, new_held=none), keys, count

    def holders(self, pairs: np.ndarray) -> np.ndarray:
        """Types that hold one of ``pairs``, or held it once."""
        at = np.searchsorted(self.keys, pairs)
        hit = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == pairs)] if len(self.keys) else at[:0]
        parts = [self.held[self.cuts[k]:self.cuts[k + 1]] for k in hit]
        return np.unique(np.concatenate([*parts, self.new_held[np.isin(self.new_keys, pairs)], np.zeros(0, np.int32)])).astype(np.int64)

    def _places(self, types: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols of ``types`` stand in ``flat``, and the place of each one's type in ``types``."""
        of = np.repeat(np.arange(len(types)), size)
        return np.arange(len(of)) + (self.first[types] - (np.cumsum(size) - size))[of], of

    def merge(self, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Apply merges (a, b, new) in order; returns the pairs whose count changed, and by how much."""
        types = self.holders(np.array([a << 32 | b for a, b, _ in merges], np.int64))
        size = self.size[types].astype(np.int64)
        places, of = self._places(types, size)
        x = self.flat[places].astype(np.int64)
        old, old_of = _pairs(x, of)
        for a, b, ab in merges:
            x, of = merged(x, of, a, b, ab)
        new, new_of = _pairs(x, of)
        less = np.bincount(of, minlength=len(types))
        changed = less != size
        places, _ = self._places(types[changed], less[changed])
        self.flat[places] = x[changed[of]]
        self.size[types] = less
        old, old_of = old[changed[old_of]], old_of[changed[old_of]]
        new, new_of = new[changed[new_of]], new_of[changed[new_of]]
        keys, at = np.unique(np.r_[old, new], return_inverse=True)
        change = np.zeros(len(keys), np.int64)
        n = self.n[types]
        np.subtract.at(change, at[:len(old)], n[old_of])
        np.add.at(change, at[len(old):], n[new_of])
        # pairs that a type did not hold before, as (pair, type) in one number
        held = np.setdiff1d(at[len(old):] * len(types) + new_of, at[:len(old)] * len(types) + old_of)
        if len(held):
            self.new_keys = np.r_[self.new_keys, keys[held // len(types)]]
            self.new_held = np.r_[self.new_held, types[held % len(types)].astype(np.int32)]
        return keys[change != 0], change[change != 0]


def _pairs(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent symbols inside each type, and the type."""
    inside = np.flatnonzero(of[1:] == of[:-1])
    return x[inside] << 32 | x[inside + 1], of[inside]


def merged(x: np.ndarray, of: np.ndarray, a: int, b: int, ab: int) -> tuple[np.ndarray, np.ndarray]:
    """Every adjacent ``a b`` inside a type joined, left to right."""
    at = np.flatnonzero((x[:-1] == a) & (x[1:] == b) & (of[1:] == of[:-1]))
    if a == b and len(at):  # in a run of equal symbols every other place
        begins = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))) % 2 == 0]
    x = x.copy()
    x[at] = ab
    keep = np.ones(len(x), bool)
    keep[at + 1] = False
    return x[keep], of[keep]


def _rows(number: int, block: Block, pairs: np.ndarray, changes: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A block's row, then its changes."""
    cols = [pa.array([number], pa.int64())]
    for k in Block.ARRAYS:
        v = pa.array(getattr(block, k))
        cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
    empty = [pa.nulls(len(pairs), c.type) for c in cols]
    if len(pairs):
        yield pa.RecordBatch.from_arrays([*empty, pa.array(pairs, pa.int64()), pa.array(changes, pa.int64())], names)


_NAMES = ["block", *Block.ARRAYS, "pair", "change"]


def _first_blocks(runs: DataFrame, ids: dict[str, int], size: int, done: list[tuple[int, int, int]]) -> DataFrame:
    """Blocks of ``run, n`` with the merges ``done`` applied."""
    def fresh(words: list[list[int]], n: list[int]) -> tuple[Block, np.ndarray, np.ndarray]:
        if done:
            x = np.array([c for w in words for c in w], np.int64)
            of = np.repeat(np.arange(len(words)), [len(w) for w in words])
            for a, b, ab in done:
                x, of = merged(x, of, a, b, ab)
            words = [w.tolist() for w in np.split(x, np.flatnonzero(np.diff(of)) + 1)]
        return Block.of(words, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, n = TaskContext.get().partitionId() << 32, [], []
        for b in batches:
            for w, c in zip(b.column("run").to_pylist(), b.column("n").to_pylist()):
                words.append([ids[ch] for ch in w])
                n.append(c)
                if len(words) == size:
                    yield from _rows(number, *fresh(words, n), _NAMES)
                    number, words, n = number + 1, [], []
        if words:
            yield from _rows(number, *fresh(words, n), _NAMES)
    return runs.select("run", "n").mapInArrow(run, f"{_STATE}, {_CHANGE}")


def _next_blocks(state: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                block = Block(**{k: b.column(k)[r].values.to_numpy(zero_copy_only=False) for k in Block.ARRAYS})
                pairs, change = block.merge(merges)
                yield from _rows(b.column("block")[r].as_py(), block, pairs, change, _NAMES)
    return state.mapInArrow(run, f"{_STATE}, {_CHANGE}")


def _sum(changes: list[DataFrame]) -> DataFrame:
    all_ = changes[0]
    for c in changes[1:]:
        all_ = all_.unionByName(c)
    return all_.groupBy("pair").agg(F.sum("change").alias("change")).where("change <> 0")


def _safe_batch(top: list) -> list:
    """Leading pairs that one-at-a-time merging would pick in this very order.

    Pairs must share no symbol. A merge then only makes pairs at most as frequent
    as some pair outside the batch, so everything strictly above that one is final.
    A doubled symbol (a, a) can make (aa, aa), so it may only come last.
    """
    batch, used = [], set()
    for r in top:
        if used & {r.a, r.b}:
            break
        batch.append(r)
        used |= {r.a, r.b}
        if r.a == r.b:
            break
    if len(batch) == len(top):
        batch = batch[:-1] or batch
        rest = top[len(batch)] if len(batch) < len(top) else None
    else:
        rest = top[len(batch)]
    sure = [r for r in batch if rest is None or r.n > rest.n]
    return sure or batch[:1]


def _top(counts: DataFrame, symbols: list[str], n: int) -> list[Row]:
    """The best ``n`` pairs as ``a, b, n``: each task sends its own best ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, str, str]] = []
        for b in batches:
            pair, count = b.column("pair").to_numpy(), b.column("change").to_numpy()
            if len(count) > n:  # ties with the n-th stay
                least = np.partition(count, len(count) - n)[len(count) - n]
                pair, count = pair[count >= least], count[count >= least]
            best += [(-c, symbols[p >> 32], symbols[p & 0xFFFFFFFF]) for p, c in zip(pair.tolist(), count.tolist())]
            best = nsmallest(n, best)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[1] for x in best], pa.string()), "b": pa.array([x[2] for x in best], pa.string()),
                                          "n": pa.array([-x[0] for x in best], pa.int64())})
    found = counts.mapInArrow(run, "a string, b string, n bigint").collect()
    return nsmallest(n, found, key=lambda r: (-r.n, r.a, r.b))


def learn_bpe(counts: DataFrame, n_merges: int, batch: int = 64, every: int = 8,
              min_count: int = 1, block: int = BLOCK) -> list[tuple[str, str, int]]:
    """Merges ``(a, b, count)`` by (count desc, a, b), from word types ``token, n``.

    First the merges at least half as frequent as the ``n_merges``-th pair of characters are learned; while more are
    wanted, the bound falls to a quarter and learning goes on, at last over uncut word types. The driver sees
    the alphabet, frequent pairs of characters (``MEETINGS`` at most) and the ``batch`` best pairs of a round.
    Blocks of ``block`` runs and the changes of pair counts are written every round, so a lost executor costs one
    round; every ``every`` rounds the changes are added up into one table.
    """
    types = materialize(counts.select("token", "n"), "word-types")  # few next to the corpus
    met = materialize(meetings(types), "meetings")
    best = met.orderBy(F.desc("n")).limit(max(n_merges, 1)).agg(F.min("n").alias("n"), F.count("n").alias("k")).first()
    least = best.n // 2 if best.k == n_merges else min_count
    merges: list[tuple[str, str, int]] = []
    while True:
        least = max(least, min_count)
        pairs = [r.pair for r in met.where(F.col("n") >= least).select("pair").limit(MEETINGS + 1).collect()] if least > min_count else []
        if least <= min_count or len(pairs) > MEETINGS:
            least, pairs = min_count, None
        _learn(runs_between(types, pairs), merges, n_merges, batch, every, least, block)
        if len(merges) >= n_merges or pairs is None:
            break
        least //= 4
    release(types)
    release(met)
    return merges


def _learn(runs: DataFrame, merges: list[tuple[str, str, int]], n_merges: int, batch: int, every: int, least: int, block: int) -> None:
    """Goes on with ``merges``, over ``run, n``, while there are pairs at least ``least`` times."""
    runs = materialize(runs, "runs")
    symbols = sorted(r["piece"] for r in runs.select(F.explode(F.split("run", "")).alias("piece")).where("piece <> ''")
                     .distinct().limit(ALPHABET + 1).collect())
    ids = {x: i for i, x in enumerate(symbols)}
    done = []
    for a, b, _ in merges:
        for x in (a, b, a + b):
            ids.setdefault(x, len(ids))
        done.append((ids[a], ids[b], ids[a + b]))
    parts = max(1, -(-runs.count() // block))  # one block a task and file, so rounds run on all cores
    state = materialize(_first_blocks(runs.repartition(parts, "run"), ids, 2 * block, done), "blocks")
    release(runs)
    changes = [state.where("pair is not null").select("pair", "change")]
    kept = [state]
    while len(merges) < n_merges:
        top = _top(_sum(changes).where(F.col("change") >= least), list(ids), batch + 1)
        if not top:
            break
        step = []
        for r in _safe_batch(top)[:n_merges - len(merges)]:
            merges.append((r.a, r.b, r.n))
            step.append((ids[r.a], ids[r.b], ids.setdefault(r.a + r.b, len(ids))))
        if len(merges) == n_merges:
            break
        state = materialize(_next_blocks(state.where("block is not null").drop("pair", "change"), step), "blocks")
        changes.append(state.where("pair is not null").select("pair", "change"))
        kept.append(state)
        if len(changes) > every:
            changes = [materialize(_sum(changes), "pair-counts")]
            for old in kept[:-1]:
                release(old)
            kept = [changes[0], state]
    for old in kept:
        release(old)


def distinct_lookup(splitter: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]) -> WordIds:
    """Ids of flat words by a function that gives the ids of many words and how many each has. A batch is
    dictionary-encoded, so a distinct word is split once."""
    memo: dict = {}

    def lookup(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not memo:
            memo["split"] = splitter()
        split = memo["split"]
        coded = words.dictionary_encode()
        found = [split(coded.dictionary.slice(i, CHUNK).to_pylist()) for i in range(0, len(coded.dictionary), CHUNK)]
        if not found:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        pool, size = np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])
        at = coded.indices.to_numpy(zero_copy_only=False)
        first = np.cumsum(size) - size
        return pool[places(first[at], size[at])], size[at]

    return lookup


def places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of stretches, given by their beginnings and sizes."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


class Symbols:
    """Numbers of characters and pieces, the ids they stand for, and merges by pair, as sorted arrays.

    A character of no number is counted below zero; what is no piece stands for its UTF-8 bytes.
    """

    def __init__(self, ids: dict[str, int], ranks: dict[tuple[str, str], int]):
        self.ids = ids
        self.names = list(dict.fromkeys([*ids, *(x for a, b in ranks for x in (a, b, a + b))]))
        number = {x: i for i, x in enumerate(self.names)}
        chars = sorted((ord(x), i) for x, i in number.items() if len(x) == 1)
        self.code, self.char = np.array(chars, np.int64).reshape(-1, 2).T
        merges = sorted((number[a] << 32 | number[b], k, number[a + b]) for (a, b), k in ranks.items())
        self.pair, self.rank, self.merged = np.array(merges, np.int64).reshape(-1, 3).T
        self.pool, self.size = self._stand_for(self.names)

    def _stand_for(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [piece_ids([x], self.ids) for x in names]
        return np.array([i for x in out for i in x], np.int32), np.array([len(x) for x in out], np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of code points; ``-1 - code`` for those without."""
        if not len(self.code):
            return -1 - codes
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        return np.where(self.code[at] == codes, self.char[at], -1 - codes)

    def word_ids(self, x: np.ndarray, of: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words whose symbols are ``x``, and how many each has."""
        strange = np.unique(x[x < 0])
        pool, size = self._stand_for([chr(-1 - c) for c in strange.tolist()])
        pool, size = np.r_[self.pool, pool].astype(np.int32), np.r_[self.size, size].astype(np.int64)
        at = np.where(x < 0, len(self.names) + np.searchsorted(strange, x), x)
        first = np.cumsum(size) - size
        return pool[places(first[at], size[at])], np.bincount(of, size[at], words).astype(np.int64)


def merge_all(x: np.ndarray, of: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of many words after all merges: in each word the lowest-ranked is applied to all its places, left to
    right, until none is left."""
    none = len(symbols.pair)
    over: list[tuple[np.ndarray, np.ndarray]] = []
    while len(x) > 1 and none:
        pair = x[:-1] << 32 | (x[1:] & 0xFFFFFFFF)
        k = np.minimum(np.searchsorted(symbols.pair, pair), none - 1)
        hit = (symbols.pair[k] == pair) & (of[1:] == of[:-1])
        if not hit.any():
            break
        rank = np.r_[np.where(hit, symbols.rank[k], np.iinfo(np.int64).max), np.iinfo(np.int64).max]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(x)]))
        at = np.flatnonzero(hit & (rank == least)[:-1])
        begins = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # in a run of equal symbols every other place
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))) % 2 == 0]
        x = x.copy()
        x[at] = symbols.merged[k[at]]
        live = least < np.iinfo(np.int64).max
        over.append((x[~live], of[~live]))
        live[at + 1] = False
        x, of = x[live], of[live]
    over.append((x, of))
    x, of = np.concatenate([a for a, _ in over]), np.concatenate([b for _, b in over])
    order = np.argsort(of, kind="stable")
    return x[order], of[order]


class BpeModel:
    """Characters and merges of bounded number with their ids, sent to workers once."""

    def __init__(self, spark, chars: list[str], merges: list[tuple[str, str]]):
        pieces = dict.fromkeys([WORD_START, *chars, *[a + b for a, b, *_ in merges]])
        self.ids = {p: FIRST_PIECE + i for i, p in enumerate(pieces)}
        self.ranks = {(a, b): i for i, (a, b, *_) in enumerate(merges)}
        self.size = FIRST_PIECE + len(self.ids)
        self.data = spark.sparkContext.broadcast((self.ids, self.ranks))

    def word_ids(self) -> WordIds:
        data = self.data

        def splitter():
            ids, ranks = data.value
            symbols = Symbols(ids, ranks)

            def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
                codes, of = marked(words)
                return symbols.word_ids(*merge_all(symbols.of(codes), of, symbols), len(words))
            return lambda words: split_by_length(words, together, lambda w: piece_ids(bpe_pieces(w, ranks), ids))
        return distinct_lookup(splitter)


def split_by_length(words: list[str], together: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                    alone: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words and how many each has: short ones ``together``, those over ``LONG`` characters ``alone``."""
    long = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > LONG)
    if not len(long):
        return together(words)
    big = set(long.tolist())
    ids, size = together(["" if i in big else w for i, w in enumerate(words)])
    cuts = np.cumsum(size) - size
    parts, at = [], 0
    for i in long.tolist():  # the place of a long word holds what stands for the empty one
        own = np.array(alone(words[i]), np.int32)
        parts += [ids[at:cuts[i]], own]
        at = cuts[i] + size[i]
        size[i] = len(own)
    return np.concatenate([*parts, ids[at:]]), size


def bpe_pieces(word: str, ranks: dict) -> list[str]:
    """Apply the lowest-ranked merge to all its places, left to right, until none is left.

    Neighbouring pairs wait in a heap by (rank, place), so the work grows as the length of the
    word times its logarithm. A merge only makes pairs of its own or later rounds: pairs are
    taken rank by rank, those of one rank from the left.
    """
    parts: list[str | None] = [WORD_START, *word]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapify(heap)
    while heap:
        rank = heap[0][0]
        round_ = []
        while heap and heap[0][0] == rank:
            round_.append(heappop(heap))
        new = []
        for _, i, a, b in round_:
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            new.append(i)
        for i in new:
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and parts[x] is not None and parts[y] is not None and (parts[x], parts[y]) in ranks:
                    heappush(heap, (ranks[parts[x], parts[y]], x, parts[x], parts[y]))
    return [p for p in parts if p is not None]


def piece_ids(pieces: list[str], ids: dict) -> list[int]:
    """Ids of pieces; an unknown piece falls back to its UTF-8 bytes."""
    out: list[int] = []
    for p in pieces:
        if p in ids:
            out.append(ids[p])
        else:
            out.extend(FIRST_BYTE + b for b in p.encode("utf-8"))
    return out

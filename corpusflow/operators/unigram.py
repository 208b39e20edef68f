"""Unigram pieces: a likelihood model over segmentations, learned with Spark jobs, applied in Arrow batches.

A word is the product of its pieces' probabilities, summed over all ways to cut it. Learning starts from the
frequent substrings of the word types and alternates two steps: expected counts of all pieces by the
forward-backward sums over each type's lattice, which Spark adds up over types, and new
probabilities from those counts. Between rounds the pieces that the likelihood misses least are dropped until
``size`` are left. Single characters always stay, so every training word keeps a segmentation.

Only the model comes to the driver; its size is bounded by ``seeds`` and the alphabet. Expected counts are
added as whole numbers of ``1 / UNIT``, so the model is the same on any layout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow_text import WordIds
from ..session import materialize, release
from .bpe import ALPHABET, FIRST_PIECE, MEETINGS, WORD_START, alphabet, distinct_lookup, marked, piece_ids, split_by_length

UNIT = 1 << 16         # parts of one expected occurrence
LONGEST = 16           # characters of a piece
UNKNOWN_BELOW = 10.0   # an unknown character scores so much below the least piece
SPREAD = 20_000        # word types of one task
STRIDE = 4096          # word types whose lattices are summed together
TABLE = 1 << 22        # entries of a table of steps
MIDDLING = 32          # longer words are summed apart from the others


# ---- lattices ---------------------------------------------------------------------

@dataclass
class Lattices:
    """The pieces that can stand in some words, as edges between character places."""

    words: int
    first: np.ndarray  # node of each word's beginning
    last: np.ndarray   # node behind its last character
    start: np.ndarray  # of each edge: the node it leaves, the node it reaches, its piece, its end inside the word
    end: np.ndarray
    piece: np.ndarray
    inner: np.ndarray


class Trie:
    """Pieces as paths of characters from a root, looked up for many places at once; in a table of all steps where that is small."""

    def __init__(self, pieces: list[str]):
        self.codes = np.array(sorted({ord(c) for p in pieces for c in p}), np.int64)
        self.width = len(self.codes) + 1  # the last for all other characters
        number = {c: i for i, c in enumerate(map(chr, self.codes.tolist()))}
        child: dict[int, int] = {}
        piece = [-1]
        for k, p in enumerate(pieces):
            at = 0
            for c in p:
                at = child.setdefault(at * self.width + number[c], len(piece))
                if at == len(piece):
                    piece.append(-1)
            piece[at] = k
        self.piece = np.array(piece, np.int64)
        self.key = np.array(sorted(child), np.int64)
        self.child = np.array([child[k] for k in sorted(child)], np.int64)
        self.table = None
        if len(piece) * self.width <= TABLE:
            self.table = np.full(len(piece) * self.width, -1, np.int64)
            self.table[self.key] = self.child

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Code points as numbers of the characters of pieces."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The nodes reached by a character, -1 where there is none."""
        want = node * self.width + number
        if self.table is not None:
            return self.table[want]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.child[at], -1)


def lattices(words: list[str], trie: Trie, longest: int = LONGEST, strange: bool = False) -> Lattices:
    """Edges of all words; a character without a piece of its own has none, so its word has probability 0, or with ``strange`` piece -1."""
    codes, of = marked(words)
    size = np.bincount(of, minlength=len(words))
    last = np.cumsum(size + 1) - 1
    first = last - size
    number, left = trie.numbers(codes), np.cumsum(size)[of] - np.arange(len(codes))  # characters up to the end of the word
    place, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    found = [(place[:0], place[:0], place[:0])]
    for d in range(longest):
        inside = left[place] > d
        place, node = place[inside], node[inside]
        if not len(place):
            break
        node = trie.step(node, number[place + d])
        there = node >= 0
        piece = np.where(there, trie.piece[node], -1)
        here = (piece >= 0) | (strange and d == 0)
        found.append((place[here], np.full(np.count_nonzero(here), d + 1), piece[here]))
        place, node = place[there], node[there]
    place, length, piece = (np.concatenate(x) for x in zip(*found[::-1]))  # the longest first: of those into a place, the first to leave
    start = place + of[place]
    inner = start + length - first[of[place]]
    small = len(inner) == 0 or inner.max() < 1 << 16  # sorted in linear time
    order = np.argsort(inner.astype(np.uint16) if small else inner, kind="stable")  # by the end inside the word, so sums only use finished nodes
    return Lattices(len(words), first, last, start[order], (start + length)[order], piece[order], inner[order])


def forward_backward(x: Lattices, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each word, posterior of each edge).

    Sums of probabilities, each times one factor per character, which leaves posteriors as they are and keeps
    them within the range of numbers; sums of logarithms where words are too long for that.
    """
    nodes = int(x.last[-1]) + 1 if x.words else 0
    weight, length = score[x.piece], x.end - x.start
    cut = np.flatnonzero(np.r_[True, x.inner[1:] != x.inner[:-1], True]) if len(x.inner) else np.zeros(1, np.int64)
    of = np.searchsorted(x.last, x.end)  # the word of each edge
    each = weight / length
    low, high = (each.min(), each.max()) if len(each) else (0.0, 0.0)
    if x.words and (x.last - x.first).max() * ((high - low) / 2 + 1) < 600:
        shift = -(low + high) / 2
        p = np.exp(weight + shift * length)
        alpha, beta = np.zeros(nodes), np.zeros(nodes)
        alpha[x.first], beta[x.last] = 1.0, 1.0
        for a, b in zip(cut[:-1], cut[1:]):
            np.add.at(alpha, x.end[a:b], alpha[x.start[a:b]] * p[a:b])
        for a, b in zip(cut[-2::-1], cut[:0:-1]):  # edges into one place leave from different ones
            beta[x.start[a:b]] += beta[x.end[a:b]] * p[a:b]
        whole = alpha[x.last]
        with np.errstate(invalid="ignore", divide="ignore"):
            post = alpha[x.start] * p * beta[x.end] / whole[of]
            return np.log(whole) - shift * (x.last - x.first), np.nan_to_num(post, nan=0.0)
    alpha = np.full(nodes, -np.inf)
    beta = np.full(nodes, -np.inf)
    alpha[x.first], beta[x.last] = 0.0, 0.0
    for a, b in zip(cut[:-1], cut[1:]):
        np.logaddexp.at(alpha, x.end[a:b], alpha[x.start[a:b]] + weight[a:b])
    for a, b in zip(cut[-2::-1], cut[:0:-1]):
        np.logaddexp.at(beta, x.start[a:b], beta[x.end[a:b]] + weight[a:b])
    whole = alpha[x.last]
    with np.errstate(invalid="ignore"):
        post = np.exp(alpha[x.start] + weight + beta[x.end] - whole[of])
    return whole, np.nan_to_num(post, nan=0.0)


def best_edges(x: Lattices, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, word) of the likeliest pieces of all words, in order; ties as in ``best_path``."""
    best = np.full(int(x.last[-1]) + 1 if x.words else 0, -np.inf)
    back = np.full(len(best), -1, np.int64)
    best[x.first] = 0.0
    weight, length = score[x.piece], x.end - x.start
    cut = np.flatnonzero(np.r_[True, (np.diff(x.inner) != 0) | (np.diff(length) != 0), True]) if len(length) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):  # one edge into a place at a time
        v = weight[a:b] + best[x.start[a:b]]
        better = np.flatnonzero(v > best[x.end[a:b]])
        at = x.end[a:b][better]
        best[at], back[at] = v[better], a + better
    word, at, taken = np.arange(x.words), x.last, []
    while len(word):
        edge = back[at]
        word, edge = word[edge >= 0], edge[edge >= 0]
        taken.append((edge, word))
        at = x.start[edge]
    edge, word = (np.concatenate(v) for v in zip(*taken[::-1])) if taken else (x.piece[:0], x.piece[:0])
    order = np.argsort(word, kind="stable")
    return edge[order], word[order]


def best_path(s: str, score: dict[str, float], unknown: float, longest: int = LONGEST, barred: str | None = None) -> tuple[float, list[str]]:
    """The likeliest pieces of ``s``; of equally likely ones those whose last piece is longest, then the one before it.

    A character without a piece stands for itself at ``unknown``. ``barred`` may not be used as a piece.
    """
    n = len(s)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    get = score.get
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            p = s[i:j]
            v = get(p) if p != barred else None
            if v is None:
                if j - i > 1:
                    continue
                v = unknown
            v += best[i]
            if v > best[j]:
                best[j], back[j] = v, i
    out, j = [], n
    while j:
        out.append(s[back[j]:j])
        j = back[j]
    return best[n], out[::-1]


# ---- learning ---------------------------------------------------------------------

@dataclass
class Unigram:
    """Pieces with their natural-log probabilities, and the log-likelihood of the corpus after each round.

    ``rounds`` holds (pieces, log-likelihood) of every expectation step, in order; pieces fall where some were dropped.
    """

    score: dict[str, float]
    rounds: list[tuple[int, float]] = field(default_factory=list)

    @property
    def unknown(self) -> float:
        return min(self.score.values(), default=0.0) - UNKNOWN_BELOW


def _substrings(runs: DataFrame, least: int, most: int) -> DataFrame:
    """``(piece, n)``: all substrings of ``least`` to ``most`` characters of ``run, n``."""
    starts = F.sequence(F.lit(1), F.col("l") - least + 1)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(least), F.least(F.lit(most), F.col("l") - i + 1)), lambda k: F.substring(F.col("run"), i, k))))
    d = runs.withColumn("l", F.length("run")).where(F.col("l") >= least)
    return d.select("n", F.explode(parts).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


def _runs_of(runs: DataFrame, kept: list[str], size: int) -> DataFrame:
    """``(run, n)``: the longest parts of ``run, n`` all of whose substrings of ``size`` characters are ``kept``, longer than ``size``."""
    known = runs.sparkSession.sparkContext.broadcast(frozenset(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for b in batches:
            out, many = [], []
            for s, n in zip(b.column("run").to_pylist(), b.column("n").to_pylist()):
                first = 0
                for i in range(len(s) - size + 1):
                    if s[i:i + size] not in keep:
                        if i + size - 1 - first > size:
                            out.append(s[first:i + size - 1])
                            many.append(n)
                        first = i + 1
                if len(s) - first > size:
                    out.append(s[first:])
                    many.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(many, pa.int64())], ["run", "n"])
    return runs.select("run", "n").mapInArrow(run, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def seed_pieces(counts: DataFrame, seeds: int, longest: int = LONGEST) -> DataFrame:
    """``(piece, n)``: the ``seeds`` substrings of two characters or more with the most characters in all, seen twice at least.

    A substring is at most as frequent as those inside it. So longer ones are only looked for in runs whose shorter ones
    are frequent enough for ``longest`` characters to be among the best found so far.
    """
    runs = counts.select(F.concat(F.lit(WORD_START), "token").alias("run"), "n")
    value = F.col("n") * F.length("piece")
    tables, least, at, found = [], 2, 2, None
    for last in sorted({min(3, longest), min(6, longest), longest}):
        if at > 2:
            kept = found.where((F.length("piece") == at - 1) & (F.col("n") >= least)).select("piece").limit(MEETINGS + 1).collect()
            if len(kept) <= MEETINGS:  # else nothing is cut
                runs = materialize(_runs_of(runs, [r.piece for r in kept], at - 1), "runs")
                tables.append(runs)
        some = materialize(_substrings(runs, at, last).where(F.col("n") >= least), "substrings")
        tables.append(some)
        found = some if found is None else found.unionByName(some)
        best = found.select(value.alias("v")).orderBy(F.desc("v")).limit(max(seeds, 1)).agg(F.min("v").alias("v"), F.count("v").alias("k")).first()
        if best.k == seeds:
            least = max(least, -(-best.v // longest))
        at = last + 1
    out = materialize(found.orderBy(F.desc(value), "piece").limit(seeds), "seeds")
    for t in tables:
        release(t)
    return out


def expected_counts(counts: DataFrame, score: dict[str, float], longest: int = LONGEST) -> tuple[dict[str, int], float]:
    """Expected occurrences of each piece over all word types, in units, and the log-likelihood of the corpus."""
    pieces = list(score)
    model = counts.sparkSession.sparkContext.broadcast((pieces, np.array([score[p] for p in pieces])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, value = model.value
        trie = Trie(names)
        total = np.zeros(len(value) + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, STRIDE):
                part = b.slice(at, STRIDE)
                words = part.column("token").to_pylist()
                long = np.fromiter(map(len, words), np.int64, len(words)) > MIDDLING
                for rows in filter(len, (np.flatnonzero(~long), np.flatnonzero(long))):
                    n = part.column("n").to_numpy()[rows]
                    x = lattices([words[i] for i in rows.tolist()], trie, longest)
                    whole, post = forward_backward(x, value)
                    of = np.searchsorted(x.last, x.end)
                    np.add.at(total, x.piece, np.rint(post * n[of] * UNIT).astype(np.int64))
                    known = np.isfinite(whole)
                    total[-1] += np.rint(whole[known] * n[known] * UNIT).astype(np.int64).sum()
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["id", "c"])
    rows = counts.select("token", "n").mapInArrow(run, "id int, c bigint").groupBy("id").agg(F.sum("c").alias("c")).collect()
    model.unpersist()
    got = {r["id"]: r["c"] for r in rows}  # at most one row per piece
    return {p: got.get(i, 0) for i, p in enumerate(pieces)}, got.get(len(pieces), 0) / UNIT


def _probabilities(units: dict[str, int]) -> dict[str, float]:
    """Shares of the expected counts; a character that is never wanted keeps the least share."""
    kept = {p: max(c, 1) for p, c in units.items() if c > 0 or len(p) == 1}
    total = math.log(sum(kept.values()) or 1)
    return {p: math.log(c) - total for p, c in kept.items()}


def _least_missed(spark, score: dict[str, float], units: dict[str, int], size: int, longest: int) -> set[str]:
    """Pieces to drop down to ``size``: those whose next-best segmentation costs the corpus least."""
    model = spark.sparkContext.broadcast(score)
    unknown = min(score.values()) - UNKNOWN_BELOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for b in batches:
            pieces = b.column("piece").to_pylist()
            loss = [c * (table[p] - best_path(p, table, unknown, longest, barred=p)[0]) for p, c in zip(pieces, b.column("c").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(loss, pa.float64())], ["piece", "loss"])
    long = [(p, units[p]) for p in score if len(p) > 1]
    rows = spark.createDataFrame(long, "piece string, c bigint").mapInArrow(run, "piece string, loss double")
    gone = rows.orderBy("loss", "piece").limit(max(0, len(score) - size)).collect()
    model.unpersist()
    return {r["piece"] for r in gone}


def learn_unigram(counts: DataFrame, size: int, seeds: int | None = None, steps: int = 2, shrink: float = 0.75,
                  longest: int = LONGEST) -> Unigram:
    """A unigram model of at most ``size`` pieces (never below the alphabet) from word types ``token, n``.

    ``seeds`` substrings are tried (four times ``size`` unless given); each round takes ``steps`` expectation steps and then
    keeps the share ``shrink`` of all pieces. Word types are read as they are: no text normalisation.
    """
    if not 0 < shrink < 1:
        raise ValueError("shrink lies between 0 and 1")
    spark = counts.sparkSession
    stored = materialize(counts.select("token", "n").where("token <> ''"), "word-types")
    parts = max(1, -(-stored.count() // SPREAD))  # few bytes, much work
    types = materialize(stored.repartition(parts, "token"), "word-types")
    release(stored)
    single = alphabet(types).limit(ALPHABET + 1).collect()
    units = {r["piece"]: r["n"] for r in single}
    units |= {r["piece"]: r["n"] for r in seed_pieces(types, seeds or 4 * size, longest).collect()}
    model = Unigram(_probabilities(units))
    while single:
        for _ in range(steps):
            units, found = expected_counts(types, model.score, longest)
            model.rounds.append((len(model.score), found))
            model.score = _probabilities(units)
        if len(model.score) <= max(size, len(single)):
            break
        goal = max(size, len(single), int(len(model.score) * shrink))
        gone = _least_missed(spark, model.score, units, goal, longest)
        model.score = _probabilities({p: units[p] for p in model.score if p not in gone})
    release(types)
    return model


# ---- encoding ---------------------------------------------------------------------

class UnigramModel:
    """Pieces with ids by (probability, piece), sent to workers once; unknown characters become their UTF-8 bytes."""

    def __init__(self, spark, model: Unigram):
        order = sorted(model.score, key=lambda p: (-model.score[p], p))
        self.ids = {p: FIRST_PIECE + i for i, p in enumerate(order)}
        self.size = FIRST_PIECE + len(self.ids)
        self.data = spark.sparkContext.broadcast((self.ids, model.score, model.unknown, max(map(len, order), default=1)))

    def word_ids(self) -> WordIds:
        data = self.data

        def splitter():
            ids, score, unknown, longest = data.value
            names = list(score)
            trie, value = Trie(names), np.array([*score.values(), unknown])
            number = np.array([ids[p] for p in names], np.int32)

            def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
                x = lattices(words, trie, longest, strange=True)
                edge, word = best_edges(x, value)
                piece = x.piece[edge]
                strange = marked(words)[0][(x.start[edge] - word)[piece < 0]]  # characters without a piece
                own = [piece_ids([chr(c)], ids) for c in strange.tolist()]
                size = np.ones(len(piece), np.int64)
                size[piece < 0] = [len(o) for o in own]
                out = np.repeat(np.r_[number, np.int32(0)][piece], size)
                out[np.repeat(piece < 0, size)] = [i for o in own for i in o]
                return out, np.bincount(word, size, len(words)).astype(np.int64)
            return lambda words: split_by_length(
                words, together, lambda w: piece_ids(best_path(WORD_START + w, score, unknown, longest)[1], ids))
        return distinct_lookup(splitter)


def pieces_table(spark, model: Unigram) -> DataFrame:
    """``(id, piece, score)`` of a model."""
    order = sorted(model.score, key=lambda p: (-model.score[p], p))
    return spark.createDataFrame([(FIRST_PIECE + i, p, model.score[p]) for i, p in enumerate(order)], "id int, piece string, score double")

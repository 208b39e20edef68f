"""Repeated-phrase automata: substring deduplication on words (operator 2).

1. *Confirm.* Every text is streamed once for its anchors; grams that occur once leave (see
   ``repeats``). Among the distinct contexts of the others, windows with the same hash are
   nominated: the first and the last of each context, since all windows of a context overlap.
2. *Compile.* A shard is a run of grams in one partition. Its nominated windows become an
   Aho-Corasick automaton over word numbers.
3. *Stream.* The places of all documents that share a gram with the shard go through its
   automaton, which reports every occurrence of the words themselves; a window that occurs
   once after all is dropped.

A gram with more than ``HOT`` distinct contexts is not brought into one task: its windows are
counted by digest, combined on the map side, and its places are dealt over several shards;
each place brings its own first and last recurring window along as patterns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from . import arrays, repeats

HOT = 2000  # contexts of one gram that may meet in a task
SPREAD = 128  # contexts of a hotter gram in a shard
SHARD_ROWS = 4096  # places that share an automaton


def _cut(length: int, reach: int):
    def cut(data: np.ndarray, pos: list[int]) -> Iterator[tuple[bytes, bytes]]:
        starts, ends, _ = arrays.word_codes(data)
        for p in pos:
            a, b = max(0, p - reach), min(len(starts), p + length)
            yield data[starts[a]:starts[p]].tobytes(), data[starts[p]:ends[b - 1]].tobytes()
    return cut


def _windows(contexts: DataFrame, length: int, reach: int) -> DataFrame:
    """``(gram, ctx, n, o, h)``: digest of each window that starts ``o`` words before the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, c, n, left, right in zip(*(b.column(x).to_pylist() for x in ("gram", "ctx", "n", "left", "right"))):
                before = left.split()
                words = before + right.split()
                for o in range(min(reach, len(before)) + 1):
                    w = words[len(before) - o:len(before) - o + length]
                    if len(w) == length:
                        out.append((g, c, n, o, hashlib.blake2b(b" ".join(w), digest_size=16).digest()))
            for i in range(0, len(out), 50_000):
                g, c, n, o, h = zip(*out[i:i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array(o, pa.int32()), pa.array(h, pa.binary())], ["gram", "ctx", "n", "o", "h"])
    return contexts.mapInArrow(run, "gram bigint, ctx bigint, n bigint, o int, h binary")


def _nominate(grams: np.ndarray, words: list[list[bytes]], base: np.ndarray, length: int, skip: np.ndarray) -> list[tuple[int, int]]:
    """(row, start) of the first and last window of each row that its gram's rows have again.

    The same place before the anchor is asked for: a window may hold its gram twice.
    """
    count = np.array([len(w) for w in words])
    codes = arrays.word_codes(np.frombuffer(b" ".join(x for w in words for x in w), np.uint8))[2]
    begins = length + np.cumsum(count + length) - (count + length)
    u = np.full(int((count + length).sum()) + length, arrays.PAD)
    u[np.arange(len(codes)) + np.repeat(begins - (np.cumsum(count) - count), count)] = codes
    h = arrays.grams(u, length)
    size = np.array([max(0, len(w) - length + 1) for w in words]) * ~skip
    row = np.repeat(np.arange(len(words)), size)
    start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    keys = h[begins[row] + start], base[row] - start, grams[row]
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found = np.flatnonzero(twice)
    r = row[found]
    edge = np.ones(len(found), bool)
    edge[1:-1] = (r[1:-1] != r[:-2]) | (r[1:-1] != r[2:])
    return list(zip(r[edge].tolist(), start[found[edge]].tolist()))


def _locate(rows: DataFrame, length: int) -> DataFrame:
    """Places to ``(gram, ctx, s, e)``; ``offsets`` are windows of a place that were confirmed elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.sorted_runs(batches, ["gram", "salt"], SHARD_ROWS):
            gram, n, offsets = t["gram"].to_numpy(), t["n"].to_numpy(), t["offsets"].to_pylist()
            before = [x.split() for x in t["left"].to_pylist()]
            words = [a + z.split() for a, z in zip(before, t["right"].to_pylist())]
            hot = t["hot"].to_numpy(zero_copy_only=False)
            wanted = [(r, len(before[r]) - o) for r, x in enumerate(offsets) if x is not None for o in x]
            # a context that is there several times repeats from its first to its last window
            whole = [r for r in np.flatnonzero((n > 1) & ~hot) if len(words[r]) >= length]
            wanted += [(r, s) for r in whole for s in {0, len(words[r]) - length}]
            sure = len(wanted)
            base = np.array([len(x) for x in before])
            wanted += _nominate(gram, words, base, length, hot)
            if not wanted:
                continue
            number: dict[bytes, int] = {}
            asked = {r for r, _ in wanted}  # a place without a nominated window has no occurrence
            ids = {r: tuple([number.setdefault(w, len(number)) for w in words[r]]) for r in asked}
            auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            known: dict[tuple, int] = {}
            for k, (r, s) in enumerate(wanted):
                known.setdefault(ids[r][s:s + length], k)
            for key, k in known.items():
                auto.add_word(key, k)
            auto.make_automaton()
            times: dict[tuple[int, int, int], int] = {}
            matches = []
            for r in sorted(asked):
                for end, k in auto.iter(ids[r]):
                    same = k, gram[r], base[r] - end
                    matches.append((r, end, same))
                    times[same] = times.get(same, 0) + int(n[r])
            span: dict[int, tuple[int, int]] = {}
            for r, end, same in matches:
                if same[0] < sure or times[same] > 1:
                    span[r] = (span.get(r, (end, 0))[0], end)
            if span:
                at = pa.array(list(span))
                base = base[list(span)]
                ends = np.array(list(span.values()))
                yield pa.RecordBatch.from_arrays(
                    [t["gram"].combine_chunks().take(at), t["ctx"].combine_chunks().take(at),
                     pa.array((ends[:, 0] + 1 - length - base).astype(np.int32)), pa.array((ends[:, 1] + 1 - base).astype(np.int32))],
                    ["gram", "ctx", "s", "e"])
    return (rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
            .mapInArrow(run, "gram bigint, ctx bigint, s int, e int"))


def dedup_phrases(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a ``length``-word window that also starts anywhere else.

    Words are runs of anything but space and the characters 9 to 13. Returns one row per input
    row: ``id_col``, n_words, n_removed, spans (``[start, end)`` word numbers) and kept (the
    remaining words, one space between). Judged on the input. Null text has no words, a text
    shorter than ``length`` loses nothing, an empty table gives an empty result, repeated rows are
    copies of each other, and other columns are ignored. ``length`` is 5 or more.
    """
    if length < 5:
        raise ValueError("length must be 5 or more")
    cand = repeats.Candidates(repeats.texts(docs, id_col, text_col), length, words=True)
    hot = materialize(cand.hot(HOT), "hot")
    cut = _cut(length, cand.reach)
    few = cand.with_text(cand.distinct.join(hot, "gram", "left_anti"), cut)
    many = materialize(cand.with_text(cand.distinct.join(hot, "gram", "left_semi"), cut), "many")
    windows = _windows(many, length, cand.reach)
    again = windows.groupBy("gram", "o", "h").agg(F.sum("n").alias("k")).where("k > 1").drop("k").repartition("h")
    own = (windows.join(again, ["gram", "o", "h"]).groupBy("gram", "ctx")
           .agg(F.array_distinct(F.array(F.min("o"), F.max("o"))).alias("offsets")))
    shards = hot.select("gram", F.ceil(F.col("m") / SPREAD).cast("int").alias("r"))
    dealt = many.join(shards, "gram").join(own, ["gram", "ctx"])
    cols = ["gram", "ctx", "n", "salt", "hot", "offsets", "left", "right"]
    rows = (few.withColumns({"salt": F.lit(0), "hot": F.lit(False), "offsets": F.lit(None).cast("array<int>")}).select(cols)
            .unionByName(dealt.withColumns({"salt": F.pmod(F.hash("ctx"), F.col("r")), "hot": F.lit(True)}).select(cols)))
    settled = materialize(_locate(rows, length), "settled")
    release(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = arrays.utf8(b.column("text"))
            out = []
            for r in range(b.num_rows):
                words = data[off[r]:off[r + 1]].tobytes().split()
                spans = repeats.row_spans(b.column("spans"), r, len(words))
                keep, at = [], 0
                for s, e in spans:
                    keep += words[at:s]
                    at = e
                keep += words[at:]
                out.append((len(words), len(words) - len(keep), [{"s": s, "e": e} for s, e in spans], b" ".join(keep)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(cols[3], pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "spans", "kept"])

    schema = "id bigint, n_words bigint, n_removed bigint, spans array<struct<s:bigint,e:bigint>>, kept string"
    return cand.finish(cand.spans(settled), run, schema).withColumnRenamed("id", id_col)

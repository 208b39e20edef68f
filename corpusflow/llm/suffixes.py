"""Substring deduplication by a depth-limited radix sort of suffixes (operator 10).

A suffix only matters through its first ``length`` bytes. The most significant digit is the
gram at the anchor of that window (``repeats``), a pass in Spark; suffixes alone with their
digit leave. The next passes run inside a task on the few thousand contexts it holds, eight
bytes a digit, to the right and to the left of the anchor; members alone with their prefix
drop out of the next pass. Two windows are equal exactly when they share the group after
``length - o`` bytes to the right and ``o`` bytes to the left, so groups of equal suffixes
are exactly the repeated windows. No suffix is ever written out.

A gram with more than ``HOT`` distinct contexts is not brought into one task. Its next digits are
taken by Spark: first the ``length - gram`` bytes that any window shares with its neighbours, and of
contexts that still have company the windows themselves, both by a digest that is counted on
the map side (with the gram's hash it has 128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from . import arrays, repeats

HOT = 2000  # contexts of one gram that may meet in a task; more are counted by digest


def _digits(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of big-endian 8-byte digits, padded with zeros, and their lengths."""
    n = np.array([len(p) for p in parts])
    wide = -(-width // 8) * 8
    flat = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), ">u8")
    return flat.reshape(len(parts), wide // 8).astype(np.uint64), n


def _radix(group: np.ndarray, digits: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then digit after digit, then length; common bytes with the one before."""
    m = len(group)
    cls = group.copy()
    alive = np.arange(m)
    for d in range(digits.shape[1]):
        order = np.lexsort((digits[alive, d], cls[alive]))
        rows = alive[order]
        c, v = cls[rows], digits[rows, d]
        new = np.ones(len(rows), bool)
        new[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
        # a class is numbered by its first place, so the order of earlier digits is kept
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(rows) else np.zeros(0, int)
        begin = np.repeat(start, np.diff(np.r_[start, len(rows)]))
        place = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        cls[rows] = c + (place - begin)
        size = np.diff(np.r_[np.flatnonzero(new), len(rows)])
        alive = rows[np.repeat(size > 1, size)]
        if not len(alive):
            break
    order = np.lexsort((n, cls))
    same = np.zeros(m, np.int64)
    if m > 1:
        a, b = order[1:], order[:-1]
        x = digits[a].astype(">u8").view(np.uint8).reshape(m - 1, -1)
        y = digits[b].astype(">u8").view(np.uint8).reshape(m - 1, -1)
        differ = x != y
        common = np.where(differ.any(1), differ.argmax(1), x.shape[1])
        common = np.minimum(np.minimum(common, width), np.minimum(n[a], n[b]))
        same[1:] = np.where(group[a] == group[b], common, -1)
    same[0] = -1
    return order, same


def repeated_windows(group: np.ndarray, weight: np.ndarray, left: list[bytes], right: list[bytes],
                     length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes left of the anchor at which a repeated window starts.

    ``group`` is sorted and numbered so that members lie next to each other; ``weight`` over 1
    marks a context that occurs several times. -1 where no window repeats.
    """
    m = len(group)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    base = np.repeat(start, np.diff(np.r_[start, m]))  # room to number classes inside each group
    rd, rn = _digits(right, length)
    ld, ln = _digits([x[::-1] for x in left], max(reach, 1))
    r_order, r_same = _radix(base, rd, rn, length)
    l_order, l_same = _radix(base, ld, ln, reach)
    lo, hi = np.full(m, -1), np.full(m, -1)
    for o in range(reach + 1):
        ok = (ln >= o) & (rn >= length - o)
        if not ok.any():
            continue
        rc, lc = np.empty(m, np.int64), np.empty(m, np.int64)
        rc[r_order] = np.cumsum(r_same < length - o)
        lc[l_order] = np.cumsum(l_same < o)
        rows = np.flatnonzero(ok)
        key = rc[rows] * (m + 1) + lc[rows]
        by = np.argsort(key, kind="stable")
        k = key[by]
        again = np.zeros(len(k), bool)
        again[1:] = k[1:] == k[:-1]
        again[:-1] |= again[1:]
        twice = np.zeros(m, bool)
        twice[rows[by[again]]] = True
        twice |= ok & (weight > 1)
        lo[twice & (lo < 0)] = o
        hi[twice] = o
    return lo, hi


def _cut(length: int, reach: int):
    def cut(data: np.ndarray, pos: list[int]) -> Iterator[tuple[bytes, bytes]]:
        for p in pos:
            yield data[max(0, p - reach):p].tobytes(), data[p:p + length].tobytes()
    return cut


def _settle(contexts: DataFrame, length: int, reach: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.sorted_runs(batches, ["gram"]):
            lo, hi = repeated_windows(np.unique(t["gram"].to_numpy(), return_inverse=True)[1], t["n"].to_numpy(),
                                      t["left"].to_pylist(), t["right"].to_pylist(), length, reach)
            keep = np.flatnonzero(lo >= 0)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [t["gram"].combine_chunks().take(at), t["ctx"].combine_chunks().take(at),
                 pa.array((-hi[keep]).astype(np.int32)), pa.array((length - lo[keep]).astype(np.int32))],
                ["gram", "ctx", "s", "e"])
    return (contexts.repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(run, "gram bigint, ctx bigint, s int, e int"))


def _digests(contexts: DataFrame, size: int, places: str, reach: int) -> DataFrame:
    """``(gram, ctx, n, o, h)`` of the ``size`` bytes from ``o`` before the anchor, ``o`` in ``places``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_row, off, digest = [], [], []
            lefts, rights = b.column("left").to_pylist(), b.column("right").to_pylist()
            for r, (left, right, wanted) in enumerate(zip(lefts, rights, b.column(places).to_pylist())):
                text, at = left + right, len(left)
                for o in wanted:
                    if o <= at and at - o + size <= len(text):
                        at_row.append(r)
                        off.append(o)
                        digest.append(hashlib.blake2b(text[at - o:at - o + size], digest_size=8).digest())
            at = pa.array(at_row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("gram").take(at), b.column("ctx").take(at), b.column("n").take(at), pa.array(off, pa.int32()),
                 pa.array(np.frombuffer(b"".join(digest), np.int64))], ["gram", "ctx", "n", "o", "h"])
    return contexts.mapInArrow(run, "gram bigint, ctx bigint, n bigint, o int, h bigint")


def _with_company(digests: DataFrame, by: list[str]) -> DataFrame:
    """Digests that occur again. Dealt once more by ``h``, the join can be split where one is frequent."""
    again = digests.groupBy(by).agg(F.sum("n").alias("k")).where("k > 1").select(by).repartition("h")
    return digests.join(again, by)


def _settle_hot(contexts: DataFrame, length: int, reach: int) -> DataFrame:
    """Windows that start ``i * gram`` to ``(i + 1) * gram`` before the anchor share ``length - gram`` bytes."""
    step = length - reach
    # a context is small, its digests are not: dealt evenly before, as many parts as a shuffle has
    contexts = contexts.repartition(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gram", "ctx")
    cores = _digests(contexts.withColumn("at", F.lit(list(range(0, reach, step)))), reach, "at", reach)
    alive = (_with_company(cores, ["gram", "o", "h"]).groupBy("gram", "ctx")
             .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("o", F.least(F.col("o") + step, F.lit(reach)))))).alias("at")))
    windows = _digests(contexts.join(alive, ["gram", "ctx"]), length, "at", reach)
    return (_with_company(windows, ["gram", "o", "h"]).groupBy("gram", "ctx")
            .agg((-F.max("o")).alias("s"), (F.lit(length) - F.min("o")).cast("int").alias("e")))


def dedup_substrings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns one row per input row: ``id_col``, n_bytes, n_removed, n_spans (maximal removed
    runs), spans (``[start, end)`` byte positions) and kept (the remaining bytes). Judged on
    the input: overlaps count, and both copies go. Null text is empty, a text shorter than
    ``length`` loses nothing, an empty table gives an empty result, repeated rows are copies of
    each other, and other columns are ignored. ``length`` is 5 or more.
    """
    if length < 5:
        raise ValueError("length must be 5 or more")
    cand = repeats.Candidates(repeats.texts(docs, id_col, text_col), length, words=False)
    reach = cand.reach
    hot = materialize(cand.hot(HOT), "hot")
    few = cand.with_text(cand.distinct.join(hot, "gram", "left_anti"), _cut(length, reach))
    many = materialize(cand.with_text(cand.distinct.join(hot, "gram", "left_semi"), _cut(length, reach)), "many")
    settled = materialize(_settle(few, length, reach), "settled")
    settled = settled.unionByName(materialize(_settle_hot(many, length, reach), "settled"))
    release(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = arrays.utf8(b.column("text"))
            out = []
            for r in range(b.num_rows):
                text = data[off[r]:off[r + 1]]
                spans = repeats.row_spans(b.column("spans"), r, len(text))
                keep, at = [], 0
                for s, e in spans:
                    keep.append(text[at:s].tobytes())
                    at = e
                keep.append(text[at:].tobytes())
                kept = b"".join(keep)
                out.append((len(text), len(text) - len(kept), len(spans),
                            [{"s": s, "e": e} for s, e in spans], kept))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(cols[4], pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<s:bigint,e:bigint>>, kept binary"
    return cand.finish(cand.spans(settled), run, schema).withColumnRenamed("id", id_col)

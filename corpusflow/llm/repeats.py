"""Which windows of ``length`` units occur twice: the Spark side shared by both substring operators.

1. Every text is streamed once; its anchors (see ``arrays``) become rows of two hashes.
2. Gram hashes that occur once leave: their windows cannot repeat. Counting is combined on
   the map side, and the join back can be split by AQE, so a phrase in every third text is
   no single task.
3. A gram whose contexts are all equal is settled: each of its windows repeats.
4. Of the other grams each distinct context is kept once and its text fetched; the operator
   says which windows of it repeat.

Repeated means gram *and* context hash agree, 128 bits together; step 4 compares the texts.
A row is known by its id and the hash of its text, so repeated and null ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from . import arrays

ROW = ["id", "th"]


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, text)``; null text is empty, other columns are left behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & a["th"].eqNullSafe(b["th"])


def anchor_rows(rows: DataFrame, length: int, words: bool) -> DataFrame:
    """``(id, th, pos, gram, ctx)`` for every anchor of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = arrays.utf8(b.column("text"))
            ids, th = b.column("id"), b.column("th")
            if words:
                units, cuts = arrays.row_words(data, off)
                found = arrays.anchors(units, cuts, length)
            else:
                found = arrays.anchors(data, off, length, arrays.BYTE_CODES)
            for r, pos, gram, ctx in found:
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), th.take(at), pa.array(pos.astype(np.int32)), pa.array(gram.view(np.int64)),
                     pa.array(ctx.view(np.int64))], ["id", "th", "pos", "gram", "ctx"])
    return rows.mapInArrow(run, "id bigint, th bigint, pos int, gram bigint, ctx bigint")


class Candidates:
    """Settled spans, and the contexts the operator must still look at."""

    def __init__(self, rows: DataFrame, length: int, words: bool):
        self.rows, self.length, self.words = rows, length, words
        found = materialize(anchor_rows(rows, length, words), "anchors")
        grams = (found.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
                 .where("n > 1").select("gram", (F.col("lo") == F.col("hi")).alias("whole")))
        # stored, so that the join has a shuffle of its own on both sides, which AQE can split
        grams = materialize(grams, "grams")
        hits = materialize(found.join(grams, "gram"), "repeated")
        release(found)
        release(grams)
        self.whole = hits.where("whole").select(*ROW, (F.col("pos") - self.reach).alias("s"),
                                                (F.col("pos") + length).alias("e"))
        self.open = hits.where("not whole").drop("whole")
        # one anchor for each distinct context: (gram, ctx, n, id, th, pos)
        self.distinct = materialize(
            self.open.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "pos")).alias("a"))
            .select("gram", "ctx", "n", "a.*"), "contexts")

    @property
    def reach(self) -> int:
        return self.length - arrays.gram_size(self.length)

    def hot(self, most: int) -> DataFrame:
        """Grams with more than ``most`` distinct contexts: ``(gram, m)``."""
        return self.distinct.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > most)

    def with_text(self, wanted: DataFrame, cut: Callable[[bytes, list[int]], Iterator[tuple[bytes, bytes]]]) -> DataFrame:
        """``(gram, ctx, n, left, right)`` of ``wanted``: units before and from the anchor on, as bytes."""
        per_row = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("pos", "gram", "ctx", "n")).alias("want"))
        joined = self.rows.join(per_row, same_row(self.rows, per_row)).select(self.rows["text"], "want")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, off = arrays.utf8(b.column("text"))
                want = b.column("want")
                for r in range(b.num_rows):
                    w = want[r].values
                    pos = w.field("pos").to_numpy(zero_copy_only=False)
                    left, right = zip(*cut(data[off[r]:off[r + 1]], pos))
                    yield pa.RecordBatch.from_arrays(
                        [w.field("gram"), w.field("ctx"), w.field("n"), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                        ["gram", "ctx", "n", "left", "right"])
        return joined.mapInArrow(run, "gram bigint, ctx bigint, n bigint, left binary, right binary")

    def spans(self, settled: DataFrame) -> DataFrame:
        """All removed spans. ``settled``: (gram, ctx, s, e) relative to the anchor."""
        more = (self.open.join(settled, ["gram", "ctx"])
                .select(*ROW, (F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e")))
        return self.whole.unionByName(more)

    def finish(self, spans: DataFrame, run, schema: str) -> DataFrame:
        """Join the spans of each text to it and apply the Arrow function ``run``.

        Rows equal in id and text share their spans, which are kept once however many rows there are.
        """
        per_row = spans.groupBy(*ROW).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        joined = (self.rows.join(per_row, same_row(self.rows, per_row), "left")
                  .select(self.rows["id"], self.rows["text"], "spans"))
        return joined.mapInArrow(run, schema)


def row_spans(col: pa.Array, r: int, n: int) -> list[tuple[int, int]]:
    if not col[r].is_valid:
        return []
    v = col[r].values
    return arrays.merge_spans(list(zip(v.field("s").to_pylist(), v.field("e").to_pylist())), n)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` into tables that never cut a group of equal keys.

    A group is kept whole, so the caller bounds its size before.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        diff = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            diff[1:] |= v[1:] != v[:-1]
        cut = np.flatnonzero(diff)
        if len(cut):
            yield t.slice(0, int(cut[-1]))
            t = t.slice(int(cut[-1]))
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()

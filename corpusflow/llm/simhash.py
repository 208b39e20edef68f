"""SimHash near-duplicates by anchor-point covering (operator 1).

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their
32-bit halves, so the covering works on halves with threshold 1. The anchors are the words of
a covering code: the perfect Hamming code on 31 bits (each word is within 1 of exactly one code
word) times the free 32nd bit. A fingerprint's *home* is the anchor within the covering radius
1; it is replicated to every anchor within radius + threshold = 2 (17 a half at most). If two
halves are within 1, each is seen at the other's home, so comparing homes with visitors, per
anchor, misses no link. There are 2**27 anchors a half, so unrelated fingerprints rarely meet.

Equal fingerprints are one vertex from the start. Inside an anchor only a spanning forest of
the links is emitted. Anchors with many visitors are cut into blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import arrays, repeats
from .components import components

BLOCK = 4096  # visitors, or homes, of one anchor that are compared in one piece
_PAIRS = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STRIDE = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles; a bit is set when over half of the hashes have it."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    end = (begin + size)[shingle - 1:].tolist()
    begin = begin[:len(end)].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(end), _STRIDE):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin[i:i + _STRIDE], end[i:i + _STRIDE])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(end), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, fp)``, one row per document: hash of the text, fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = arrays.utf8(b.column("text"))
            fp = np.array([fingerprint(data[off[r]:off[r + 1]].tobytes(), shingle) for r in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp.view(np.int64))], ["id", "th", "fp"])
    return repeats.texts(docs, id_col, text_col).mapInArrow(run, "id bigint, th bigint, fp bigint")


_SYN = np.zeros((4, 256), np.uint8)  # syndrome of each byte of a half: xor of the places 1..31 of its bits
for _k in range(4):
    for _v in range(256):
        for _b in range(8):
            if _v >> _b & 1 and _k * 8 + _b < 31:
                _SYN[_k, _v] ^= _k * 8 + _b + 1


def covering(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within radius 2 of either half of each fingerprint."""
    rows, keys, home = [], [], []
    n = np.arange(len(fp))
    bit = np.concatenate([[0], 1 << np.arange(31)]).astype(np.int64)  # bit of place i, none for 0
    for half in (0, 1):
        x = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = np.zeros(len(x), np.int64)
        for k in range(4):
            s ^= _SYN[k, (x >> (8 * k)) & 255]
        near = x ^ bit[s]
        tag = np.int64(half) << 32
        for flip in (0, 1 << 31):  # the free bit, kept or changed
            rows.append(n)
            keys.append(tag | (near ^ flip))
            home.append(np.full(len(x), not flip))
        for i in range(1, 32):  # error patterns of two places i, j with i xor j = s
            j = i ^ s
            ok = np.flatnonzero((s > 0) & (i < j))
            rows.append(ok)
            keys.append(tag | (x[ok] ^ bit[i] ^ bit[j[ok]]))
            home.append(np.zeros(len(ok), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _visits(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            rows, keys, home = covering(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows]), pa.array(home)], ["anchor", "fp", "home"])
    return fps.mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each vertex with the least one it reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    move = np.flatnonzero(root != np.arange(len(names)))
    return names[move], names[root[move]]


def _links(group: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the homes and the visitors of each (sorted) group."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    first, count = np.repeat(start, size), np.repeat(size, size)
    rows = np.flatnonzero(home & (count > 1))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done = 0
    total = np.cumsum(count[rows])
    while done < len(rows):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, "right")))
        part = rows[done:to]
        c = count[part]
        i = np.repeat(part, c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[part], c)
        near = (np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)) <= bits) & (fp[i] != fp[j])
        a, b = _forest(fp[i[near]], fp[j[near]])
        out_a.append(a)
        out_b.append(b)
        done = to
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """``(u, v)``: links that connect all distinct fingerprints ``fp`` within ``bits`` bits (up to 3)."""
    visits = _visits(fps)
    hot = (visits.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(F.col("home").cast("int")).alias("h"))
           .where((F.col("m") > BLOCK) & (F.col("h") > 0))
           .select("anchor", F.ceil(F.col("m") / BLOCK).cast("int").alias("mv"), F.ceil(F.col("h") / BLOCK).cast("int").alias("mh"))
           .repartition("mv", "mh"))
    v = (visits.join(hot, "anchor", "left")
         .withColumns({"mv": F.coalesce("mv", F.lit(1)), "mh": F.coalesce("mh", F.lit(1)), "x": F.hash("fp")}))
    # in a hot anchor every block of homes meets every block of visitors; elsewhere both are block 0
    zero = F.lit(0)
    as_home = (v.where("home and mv > 1").withColumn("hb", F.pmod("x", "mh"))
               .withColumn("vb", F.explode(F.sequence(zero, F.col("mv") - 1))))
    as_seen = (v.where("mv > 1").withColumn("vb", F.pmod("x", "mv")).withColumn("home", F.lit(False))
               .withColumn("hb", F.explode(F.sequence(zero, F.col("mh") - 1))))
    cold = v.where("mv = 1").withColumns({"hb": zero, "vb": zero})
    cols = ["anchor", "hb", "vb", "fp", "home"]
    met = cold.select(cols).unionByName(as_home.select(cols)).unionByName(as_seen.select(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in repeats.sorted_runs(batches, ["anchor", "hb", "vb"], 100_000):
            key = np.ones(t.num_rows, bool)
            for c in ("anchor", "hb", "vb"):
                x = t[c].to_numpy()
                key[1:] &= x[1:] == x[:-1]
            group = np.cumsum(~key)
            a, b = _links(group, t["fp"].to_numpy(), t["home"].to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
    return (met.repartition("anchor", "hb", "vb").sortWithinPartitions("anchor", "hb", "vb")
            .mapInArrow(run, "u bigint, v bigint"))


def _classes(docs: DataFrame, shingle: int, bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, th, fp)`` of every row, and ``(fp, component_id, first)``: the least id and the first row of its class."""
    if not 0 <= bits <= 3:
        raise ValueError("the covering holds for 0 to 3 bits")
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    fps = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    root = components(links(fps.select("fp"), bits))
    named = fps.join(root, fps["fp"] == root["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return rows, named.select("fp", "root").join(least, "root").select("fp", F.col("first.id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits) and component_id.

    Documents whose fingerprints differ in at most ``bits`` (0 to 3) bits are linked;
    component_id is the least id reachable. A text of fewer words than a shingle is one
    shingle; null, empty and blank texts have fingerprint 0, linked like any other. Null ids are
    kept and never the least unless all are null. Repeated rows share a fingerprint; an empty
    table gives an empty result; other columns are ignored.
    """
    rows, classes = _classes(docs, shingle, bits, id_col, text_col)
    return (rows.join(classes, "fp", "left")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one of each class: the least id, then the least hash of the text.

    Of rows equal in id and text any one stays.
    """
    _, classes = _classes(docs, shingle, bits, id_col, text_col)
    kept = classes.select(F.col("first.id").alias("__id"), F.col("first.th").alias("__th")).distinct()
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    d = docs.withColumn("__text", th).join(kept, docs[id_col].cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__th")))
    one = Window.partitionBy("__id", "__th").orderBy(F.lit(0))
    return d.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)

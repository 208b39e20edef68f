"""Exact top-k inner products by ball-tree branch and bound (operator 5).

Vectors are dealt to shards by space: level by level, a cell of more than ``SHARD`` rows is split
around up to ``FAN`` of its own rows, each row going to the nearest. A cell that stays too large (many
equal vectors) is cut by hash, so no task ever holds more. The root ball of each shard goes to a
table of its own.

Each query first meets the shard it lies in; its kth score there is the floor all other shards share.
Blocks of queries then meet blocks of root balls, and only the (query, shard) pairs whose bound
``q . centre + |q| * radius`` reaches the floor go on: neither vectors nor queries are shuffled for
the others. A task holds one shard and one block of queries. It walks the shard's ball tree, inner
nodes included, always the open node with the greatest bound of a query first, raises that query's
kth score with every leaf, and stops when no open node reaches it.

Vectors are turned to whole numbers. Products are summed in double precision where the sums
stay below 2**53, which is exact, and in 64-bit integers otherwise.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, release

SHARD = 4096
LEAF = 64
FAN = 64  # parts a cell is split into at most
ROOTS = 512  # root balls that meet a block of queries at a time
SLACK = 1e-9  # rounding of the bounds, relative to the lengths they are made of
LOWEST = np.iinfo(np.int64).min
NOBODY = np.iinfo(np.int64).max


def to_integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``(id, v, dim)``: ``floor(scale * x)``; rows that are null, empty or hold null, NaN or infinity go."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where((F.size(vec_col) > 0) & fine)
    return rows.select(F.col(id_col).cast("bigint").alias("id"),
                       F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("v"),
                       F.size(vec_col).alias("dim"))


class Tree(NamedTuple):
    """Balls of a shard. Node 0 is the root; ``child`` is (-1, -1) at leaves, whose rows are in ``rows``."""
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    rows: list[np.ndarray]


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(0)
    return centre, float(((x - centre) ** 2).sum(1).max() ** 0.5)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Each split halves a ball along its widest line."""
    rows, child, balls = [np.arange(len(x))], [[-1, -1]], []
    node = 0
    while node < len(rows):
        at = rows[node]
        p = x[at]
        balls.append(ball(p))
        if len(at) > leaf:
            far = p[((p - balls[-1][0]) ** 2).sum(1).argmax()]
            other = p[((p - far) ** 2).sum(1).argmax()]
            order = np.argsort(p @ (other - far), kind="stable")
            child[node] = [len(rows), len(rows) + 1]
            rows += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
            child += [[-1, -1], [-1, -1]]
        node += 1
    return Tree(np.array([c for c, _ in balls]), np.array([r for _, r in balls]), np.array(child), rows)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No vector of a ball has a greater inner product with ``q``; one row per query, one column per ball."""
    length = np.sqrt((q ** 2).sum(1))[:, None]
    return q @ centre.T + length * (radius + SLACK * (np.sqrt((centre ** 2).sum(1)) + radius)) + SLACK


def search(q_id: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF):
    """The ``k`` best (query, vector, score) of one shard at or above each query's floor, ties to the smaller id."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0 ** 52
    qf, xf = q.astype(float), x.astype(float)
    tree = ball_tree(xf, leaf)
    best, best_id = np.full((len(q), k), LOWEST), np.full((len(q), k), NOBODY)
    low = floor.copy()  # a score below it is of no use
    open_ = np.full((len(q), len(tree.radius)), -np.inf)  # bounds of the nodes a query may still enter
    open_[:, 0] = bounds(qf, tree.centre[:1], tree.radius[:1])[:, 0]
    active = np.arange(len(q))
    while True:
        node = open_[active].argmax(1)
        go = open_[active, node] >= low[active].astype(float)
        active, node = active[go], node[go]
        if not len(active):
            break
        open_[active, node] = -np.inf
        by = np.argsort(node, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
            rows, n = active[part], node[part[0]]
            if tree.child[n, 0] >= 0:
                open_[rows[:, None], tree.child[n]] = bounds(qf[rows], tree.centre[tree.child[n]], tree.radius[tree.child[n]])
                continue
            at = tree.rows[n]
            s = np.rint(qf[rows] @ xf[at].T).astype(np.int64) if exact else q[rows] @ x[at].T
            own = ids[at] == q_id[rows, None]
            cand = np.concatenate([best[rows], np.where(own, LOWEST, s)], 1)
            name = np.concatenate([best_id[rows], np.where(own, NOBODY, ids[at])], 1)
            top = np.lexsort((name, -cand.astype(float) if exact else ~cand), axis=1)[:, :k]
            best[rows] = np.take_along_axis(cand, top, 1)
            best_id[rows] = np.take_along_axis(name, top, 1)
            low[rows] = np.maximum(low[rows], best[rows, -1])
    i, j = np.nonzero((best_id != NOBODY) & (best >= floor[:, None]))
    return q_id[i], best_id[i, j], best[i, j]


def _cogroup(left: DataFrame, right: DataFrame, keys: list[str]):
    # new names for old columns: both sides may come from one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(keys).cogroup(right.groupBy(keys))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list())


def _split(rows: DataFrame, shard: int, level: int) -> DataFrame:
    """The next level: rows of cells over ``shard`` go to the nearest of some rows of their cell."""
    cells = rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    parts = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / shard)).cast("int")
    cells = cells.withColumns({"parts": parts, "salts": F.ceil(F.col("n") / shard).cast("int")})
    big = rows.join(cells, ["dim", "cell"])
    # about four times as many as are taken, of a cell of any size
    drawn = big.withColumn("h", F.xxhash64("id", F.lit(level))).where(
        F.pmod("h", F.greatest(F.lit(1), F.floor(F.col("n") / (4 * F.col("parts"))))) == 0)
    first = Window.partitionBy("dim", "cell").orderBy("h", "id", "v")
    pivots = (drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= F.col("parts"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
              .select("dim", "cell", "salt", "r", F.col("v").alias("p")))
    big = big.select("dim", "cell", F.pmod(F.xxhash64("id", F.lit(-1)), "salts").cast("int").alias("salt"), "id", "v")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(len(left), np.int64)
        if len(left) and len(right):
            x, p = _stack(left["v"]).astype(float), _stack(right.sort_values("r")["p"]).astype(float)
            part = ((p ** 2).sum(1) - 2 * (x @ p.T)).argmin(1)
        return pd.DataFrame({"id": left["id"], "v": left["v"], "dim": left["dim"], "cell": left["cell"] * FAN + part})
    moved = _cogroup(big, pivots, ["dim", "cell", "salt"]).applyInPandas(nearest, "id bigint, v array<bigint>, dim int, cell bigint")
    stay = rows.join(cells, ["dim", "cell"], "left_anti").select("id", "v", "dim", (F.col("cell") * FAN).alias("cell"))
    return stay.unionByName(moved)


def to_shards(rows: DataFrame, shard: int) -> DataFrame:
    """``(id, v, dim, cell, shard)``: near vectors share a cell; ``shard`` numbers the parts of all cells."""
    n = rows.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("cell", F.lit(0).cast("bigint"))
    # one level more than even splits need; what is larger then is mostly equal vectors
    for level in range(1 + math.ceil(math.log(n / shard, FAN)) if n > shard else 0):
        before, rows = rows, materialize(_split(rows, shard, level), "cells")
        release(before)
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).alias("parts"))
    sub = F.pmod(F.xxhash64("id"), F.col("parts"))
    return rows.join(parts, ["dim", "cell"]).select("id", "v", "dim", "cell", (F.shiftleft("cell", 20) + sub).alias("shard"))


def _roots(rows: DataFrame) -> DataFrame:
    """``(dim, shard, centre, radius)``: the root ball of each shard."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        centre, radius = ball(_stack(part["v"]).astype(float))
        return pd.DataFrame({"dim": part["dim"][:1], "shard": part["shard"][:1], "centre": [centre], "radius": [radius]})
    return rows.groupBy("dim", "shard").applyInPandas(run, "dim int, shard bigint, centre array<double>, radius double")


def _worth(roots: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Queries (dim, block, id, v, low, shard) with ``others``: the other shards whose ball reaches ``low``.

    One row for each stretch of ``ROOTS`` root balls that holds any.
    """
    stretches = max(1, -(-roots.count() // ROOTS))
    roots = (roots.withColumn("stretch", F.pmod(F.xxhash64("shard"), F.lit(stretches)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    queries = queries.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = right[["dim", "block", "id", "v", "low"]].copy()
        if not len(left) or not len(right):
            return out[:0].assign(others=pd.Series([], dtype=object))
        shards = left["shard"].to_numpy()
        reach = bounds(_stack(right["v"]).astype(float), _stack(left["centre"]), left["radius"].to_numpy())
        reach = (reach >= right["low"].to_numpy(float)[:, None]) & (shards != right["shard"].to_numpy()[:, None])
        out["others"] = [shards[r] for r in reach]
        return out[reach.any(1)]
    return _cogroup(roots, queries, ["dim", "block", "stretch"]).applyInPandas(
        run, "dim int, block int, id bigint, v array<bigint>, low bigint, others array<bigint>")


def _meet(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: both sides have (dim, shard, block, id, v), queries also ``low``."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        a, b, c = search(right["id"].to_numpy(), _stack(right["v"]), right["low"].to_numpy(),
                         left["id"].to_numpy(), _stack(left["v"]), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})
    keys = ["dim", "shard", "block"]
    return (_cogroup(vectors.select(*keys, "id", "v"), queries.select(*keys, "id", "v", "low"), keys)
            .applyInPandas(run, "query_id bigint, vec_id bigint, score bigint"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, shard: int = SHARD,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows where ``is_query`` holds, the ``k`` best other rows.

    Score is the inner product of ``floor(scale * x)``; ties go to the smaller id; fewer rows where there
    are fewer. Null ids and vectors that are null, empty or hold null or non-finite components take no part;
    only vectors of the same length are compared. Ids are cast to bigint; text ids are an error. Inner
    products must fit 64 bits. Ids are unique; of repeated ids each row counts, and none is compared with
    its own id. An empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(to_shards(materialize(to_integers(vectors, id_col, vec_col, scale), "vectors"), shard), "shards")
    asked = rows.where(is_query(F.col("id")))
    m = asked.count()
    zero = F.lit(0)
    home = asked.withColumns({"block": zero, "low": F.lit(LOWEST).cast("bigint")})
    first = materialize(_ranked(_meet(rows.join(asked.select("dim", "shard").distinct(), ["dim", "shard"]).withColumn("block", zero),
                                      home, k), k), "first")
    floor = first.where(F.col("rank") == k).groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("low"))
    # queries of one parent cell share a block, as they need the same shards; a crowded one has several
    blocks = max(1, -(-m // shard))
    near = asked.withColumn("parent", F.floor(F.col("cell") / FAN))
    crowd = near.groupBy("dim", "parent").agg(F.ceil(F.count("*") / shard).alias("parts"))
    block = F.pmod(F.xxhash64("parent", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))), F.lit(blocks)).cast("int")
    near = (near.join(crowd, ["dim", "parent"]).withColumn("block", block).join(floor, "id", "left")
            .withColumn("low", F.coalesce("low", F.lit(LOWEST).cast("bigint"))))
    roots = materialize(_roots(rows), "roots")
    worth = materialize(_worth(roots, near, blocks), "worth")
    release(roots)
    pairs = worth.withColumn("shard", F.explode("others"))
    needed = pairs.select("dim", "shard", "block").distinct()
    found = first.drop("rank").unionByName(_meet(rows.join(needed, ["dim", "shard"]), pairs, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")

"""Stable global positions without a one-partition window.

Spark rows have no order, so "first N", "row number" and "running total" need a
key. A window without ``partitionBy`` would pull everything into one task.
Here the order key is cut into blocks of consecutive values:

* inside a block a window adds up the rows of 2**bits key values (the key is unique);
* block totals are a small table, and *their* running total is taken the same
  way, 2**20 narrow rows at a time, so no level ever has a larger group.

The bound holds for any key distribution: dense ids give few blocks, sparse ids
give many small ones, and a hot group is only ever a list of such blocks.

One contract for all functions and every ``n``: ``order`` is unique within a group; nulls
come first; the first order column is a whole number, or ``block`` gives a whole number
that never falls along the order. Anything else raises before a job runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

BLOCK_BITS = 16
UPPER_BITS = 20
WIDE_BITS = 10  # for rows that carry long arrays or texts
KEY_BITS = 63
LOWEST = -(1 << 63)


def int_div(a: Column | str, b: int | Column) -> Column:
    """Whole-number division; plain ``/`` goes through double and loses large keys."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a,
                           F.lit(b) if isinstance(b, int) else b)


def join_whole(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where null matches null; keeps one copy of the keys."""
    b = b.select(*[F.col(c).alias(f"__j_{c}") for c in cols],
                 *[c for c in b.columns if c not in cols])
    cond = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__j_{c}"]) for c in cols])
    out = a.join(b, cond, how)
    return out.drop(*[f"__j_{c}" for c in cols])


def block_of(order: Column | str, bits: int = BLOCK_BITS) -> Column:
    c = F.col(order) if isinstance(order, str) else order
    return F.shiftright(c.cast("bigint"), bits)


def _blocks(df: DataFrame, order: list[str], group: list[str], block: Column | None,
            bits: int) -> tuple[DataFrame, list[str]]:
    """Add the block ``__b``, never null, and for grouped use the group as one struct ``__g``.

    A struct is never null itself, so groups with null members still meet in a plain
    equi-join, and window, totals and join all share one hash partitioning.
    """
    if block is None:
        kind = df.schema[order[0]].dataType
        if not isinstance(kind, IntegralType):
            raise TypeError(f"order column {order[0]!r} is {kind.simpleString()}: give a block")
        block = block_of(order[0], bits)
    # a null key sorts first, so its block is the lowest
    d = df.withColumn("__b", F.coalesce(block.cast("bigint"), F.lit(LOWEST >> bits)))
    return (d.withColumn("__g", F.struct(*group)), ["__g"]) if group else (d, [])


def _bases(totals: DataFrame, g: list[str], bits: int) -> DataFrame:
    """``(g, __b, __s)`` to the exclusive running total ``__base`` per block."""
    if bits <= UPPER_BITS:
        w = (Window.partitionBy(*(g or [F.lit(0)])).orderBy("__b")
             .rowsBetween(Window.unboundedPreceding, -1))
        return totals.select(*g, "__b", "__s",
                             F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__base"))
    t = totals.withColumn("__p", block_of("__b", UPPER_BITS))
    w = (Window.partitionBy(*g, "__p").orderBy("__b")
         .rowsBetween(Window.unboundedPreceding, -1))
    local = t.withColumn("__base", F.coalesce(F.sum("__s").over(w), F.lit(0)))
    up = _bases(t.groupBy(*g, "__p").agg(F.sum("__s").alias("__s"))
                .withColumnRenamed("__p", "__b"), g, bits - UPPER_BITS)
    up = up.select(*g, F.col("__b").alias("__p"), F.col("__base").alias("__up"))
    return (local.join(up, [*g, "__p"], "left")
            .select(*g, "__b", "__s", (F.col("__base") + F.col("__up")).alias("__base")))


def prefix_sum(df: DataFrame, value: Column, out: str, order: str | Sequence[str],
               group: Sequence[str] = (), block: Column | None = None,
               key_bits: int = KEY_BITS, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all earlier rows (of the group).

    ``block`` is for instance the leading bits of a hash; ``key_bits`` then counts the bits of
    ``block`` plus ``bits``. Rows that carry long arrays take fewer ``bits`` a block.

    The totals branch reads only the columns ``value`` needs, so pass a value
    that is cheap to recompute, or a stored column. The rows are shuffled once: window
    and join use the same partitioning, and as the left side of an outer join they
    are never the side that is broadcast.
    """
    group, order = list(group), [order] if isinstance(order, str) else list(order)
    d, g = _blocks(df, order, group, block, bits)
    d = d.withColumn("__v", value.cast("bigint"))
    totals = d.groupBy(*g, "__b").agg(F.sum("__v").alias("__s"))
    base = _bases(totals, g, key_bits - bits).drop("__s")
    w = (Window.partitionBy(*g, "__b").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__l", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return (d.join(base, [*g, "__b"], "left")
            .withColumn(out, F.col("__l") + F.col("__base"))
            .select(*df.columns, out))


def row_index(df: DataFrame, order: str | Sequence[str], out: str = "idx",
              group: Sequence[str] = (), **kw) -> DataFrame:
    """Add a 0-based position (within the group)."""
    return prefix_sum(df, F.lit(1), out, order, group, **kw)


def first_n(df: DataFrame, n: int | DataFrame, order: str | Sequence[str],
            group: Sequence[str] = (), block: Column | None = None,
            key_bits: int = KEY_BITS, index: str | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """The first ``n`` rows (per group) in order, exactly; ``index`` adds their position.

    ``n`` may be a DataFrame ``(group..., k)`` of quotas. Block counts decide which blocks
    can hold a wanted row; only those rows are shuffled and ranked, so a group of
    any size is neither sorted nor collected as a whole, whatever ``n`` is.
    """
    group, order = list(group), [order] if isinstance(order, str) else list(order)
    d, g = _blocks(df, order, group, block, bits)
    totals = d.groupBy(*g, "__b").agg(F.count("*").alias("__s"))
    base = _bases(totals, g, key_bits - bits)
    if isinstance(n, int):
        base = base.withColumn("__k", F.lit(n).cast("bigint"))
    else:
        quota = n.select(F.struct(*group).alias("__g"), F.col("k").cast("bigint").alias("__k"))
        base = base.join(quota, "__g")
    wanted = base.filter(F.col("__base") < F.col("__k")).drop("__s")
    w = Window.partitionBy(*g, "__b").orderBy(*order)
    d = (d.join(wanted, [*g, "__b"])
         .withColumn("__r", F.col("__base") + F.row_number().over(w))
         .filter(F.col("__r") <= F.col("__k")))
    if index is None:
        return d.select(*df.columns)
    return d.select(*df.columns, (F.col("__r") - 1).alias(index))

"""Positions and heads against brute force: sparse keys, hot groups, any layout."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import index as I
from corpusflow.operators import mixing as M

KEYS = {
    "dense": list(range(300)),
    "sparse": [random.Random(1).randrange(-2 ** 62, 2 ** 62) for _ in range(300)],
    "clustered": list(range(2 ** 40, 2 ** 40 + 150)) + list(range(-5, 145)),
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("parts", [1, 32])
def test_prefix_sum(spark, kind, parts):
    keys = sorted(set(KEYS[kind]))
    rows = [(k, (k * 7) % 13) for k in keys]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "k bigint, n bigint").repartition(parts)
    got = {r.k: r.s for r in I.prefix_sum(df, F.col("n"), "s", "k").collect()}
    total, want = 0, {}
    for k, n in rows:
        want[k], total = total, total + n
    assert got == want


def test_row_index_in_groups_with_a_hot_and_a_null_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    got = {(r.g, r.k): r.idx for r in I.row_index(df, "k", group=["g"], block=F.shiftright("k", 3), key_bits=48).collect()}
    want, seen = {}, {}
    for g, k in rows:
        want[g, k] = seen.get(g, 0)
        seen[g] = want[g, k] + 1
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 77, 499, 500, 900])
def test_first_n_by_blocks(spark, n):
    ks = [k * 3 for k in range(500)]
    df = spark.createDataFrame([(k,) for k in random.Random(4).sample(ks, 500)], "k bigint")
    got = sorted(r.k for r in I.first_n(df, n, "k", block=F.shiftright("k", 5), key_bits=48).collect())
    assert got == ks[:n]
    withi = I.first_n(df, n, "k", block=F.shiftright("k", 5), key_bits=48, index="i").collect()
    assert sorted((r.k, r.i) for r in withi) == [(k, i) for i, k in enumerate(ks[:n])]


def test_quotas_per_group(spark):
    rows = [(("hot" if k % 3 else "cold"), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    quota = spark.createDataFrame([("hot", 1200), ("cold", 10)], "g string, k bigint")
    got = M.sample_n(df, quota, 5, "k", ["g"])
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"hot": 1200, "cold": 10}
    import hashlib
    order = lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest()
    want = sorted((k for g, k in rows if g == "cold"), key=order)[:10]
    assert sorted(r.k for r in got.filter("g = 'cold'").collect()) == sorted(want)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_dedup_keeps_the_first_of_a_hot_text(spark, parts):
    rows = [(k, "same" if k % 3 == 0 else f"t{k % 50}") for k in range(900)]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(parts)
    first = {}
    for k, t in rows:
        first.setdefault(t, k)
    got = M.dedup_exact(df, ["t"], "k")
    assert {r.t: r.k for r in got.collect()} == first
    assert M.dedup_exact(got, ["t"], "k").count() == len(first)


def test_block_shuffle_moves_rows_only_inside_full_buffers(spark):
    df = spark.createDataFrame([(k * 10,) for k in range(300)], "k bigint")
    got = {r.k // 10: (r.block, r.pos) for r in M.block_shuffle(df, "k", 9, buffer=128).collect()}
    assert sorted(p for _, p in got.values()) == list(range(300))
    assert all(b == i // 128 and p // 128 == b for i, (b, p) in got.items())
    assert all(got[i][1] == i for i in range(256, 300))
    assert any(got[i][1] != i for i in range(128))


def test_splits_are_disjoint_and_whole(spark):
    df = spark.createDataFrame([(k, "" if k % 7 == 0 else "x") for k in range(400)], "k bigint, text string")
    d = M.head_split(df, 300, 0.01, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in d} == {"validation": 2, "train": 300 - 3 - (43 - 1)}
    assert M.head_split(df, 50, 0.01, "k", at_least_one=False).filter("split = 'validation'").count() == 0
    e = M.exact_split(df, 0.2, 42, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in e} == {"test": 80, "train": 320}


def test_temperature_weights(spark):
    spec = spark.createDataFrame([(str(i), w) for i, w in enumerate([.6, .1, .1, .1, .1])], "source string, weight double")
    probs = lambda t: [round(r.prob, 9) for r in M.temperature_weights(spec, t).orderBy("source").collect()]
    assert probs(0.5) == [.9, .025, .025, .025, .025]
    assert probs(0) == probs(None) == [.6, .1, .1, .1, .1]
    assert sum(probs(2.0)) == pytest.approx(1)


def test_interleave_uses_every_row_and_keeps_shares(spark):
    rows = [("big", k) for k in range(900)] + [("small", k) for k in range(900, 930)]
    df = spark.createDataFrame(rows, "source string, k bigint")
    probs = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "source string, prob double")
    d = M.interleave(df, probs, "k")
    assert d.select("k").distinct().count() == 930
    n = {r.source: r["count"] for r in d.groupBy("source").count().collect()}
    assert n == {"big": 900, "small": 900}
    head = [r.source for r in d.orderBy("at", "source").limit(100).collect()]
    assert head.count("small") == 50


@pytest.mark.parametrize("n", [1, 2, 10, 1000, 20_000])
def test_null_keys_come_first_for_every_n(spark, n):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c"), (-(2 ** 63), "d"), (2 ** 62, "e")], "k bigint, t string")
    got = [r.t for r in I.first_n(df, n, "k", index="i").orderBy("i").collect()]
    assert got == ["a", "d", "b", "c", "e"][:n]
    assert sorted(r.t for r in I.first_n(df, n, "k").collect()) == sorted(got)


@pytest.mark.parametrize("n", [10, 20_000])
def test_text_keys_need_a_block_for_every_n(spark, n):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    with pytest.raises(TypeError, match="block"):
        I.first_n(df, n, "k")
    got = I.first_n(df, n, "k", block=F.ascii(F.substring("k", 1, 1)), index="i").orderBy("i").collect()
    assert [r.k for r in got] == [None, "a", "b"]


def test_a_null_key_loses_no_tokens(spark):
    from corpusflow.operators import packing as P
    df = spark.createDataFrame([(None, list(range(10))), (1, list(range(10, 20))), (2, list(range(20, 30)))], "k bigint, ids array<int>")
    got = P.pack(df, 5, "k").orderBy("seq_id").collect()
    assert [x for r in got for x in r.input_ids] == list(range(30))


def test_tied_first_columns_use_the_next(spark):
    df = spark.createDataFrame([(k // 5, k % 5) for k in range(50)], "a bigint, b int")
    assert sorted((r.a, r.b) for r in I.first_n(df, 7, ["a", "b"]).collect()) == [(0, i) for i in range(5)] + [(1, 0), (1, 1)]


def test_interleave_cuts_long_repeats(spark, monkeypatch):
    rows = [(k, "big") for k in range(40)] + [(100, "one")]
    df = spark.createDataFrame(rows, "k bigint, source string")
    probs = spark.createDataFrame([("big", 0.5), ("one", 0.5)], "source string, prob double")
    want = sorted(tuple(r) for r in M.interleave(df, probs, "k").collect())
    monkeypatch.setattr(M, "REPEATS", 7)
    assert sorted(tuple(r) for r in M.interleave(df, probs, "k").collect()) == want and len(want) == 80

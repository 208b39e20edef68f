"""Packing, collation and masking against plain Python."""

import random

import pytest
from corpusflow.operators import packing as P

L = 8


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "k bigint, ids array<int>").repartition(parts)


def packed(rows, n=L):
    flat = [x for _, ids in sorted(rows) for x in ids]
    return [flat[i:i + n] for i in range(0, len(flat) - n + 1, n)]


def random_rows(seed, n=60):
    rng = random.Random(seed)
    return [(k * rng.choice([1, 100_000]) + k, [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 8, 16, 30]))])
            for k in range(n)]


@pytest.mark.parametrize("lens", [[], [L - 1], [L], [L + 1], [3 * L + 2], [L, L], [5, 3, 8, 1], [0, 0, 9]])
def test_boundaries(spark, lens):
    rows = [(k, [k * 100 + i for i in range(n)]) for k, n in enumerate(lens)]
    got = P.pack(frame(spark, rows), L, "k").orderBy("seq_id").collect()
    assert [r.input_ids for r in got] == packed(rows)
    assert [r.seq_id for r in got] == list(range(len(got)))


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_any_layout(spark, parts):
    rows = random_rows(5)
    got = P.pack(frame(spark, rows, parts), L, "k").orderBy("seq_id").collect()
    assert [r.input_ids for r in got] == packed(rows)


def test_one_row_holding_a_third_of_all_tokens(spark):
    rows = [(k, list(range(10))) for k in range(40)] + [(40, list(range(200)))] + [(k, [1]) for k in range(41, 60)]
    assert [r.input_ids for r in P.pack(frame(spark, rows), L, "k").orderBy("seq_id").collect()] == packed(rows)


def test_batches_drop_their_tails(spark):
    rows = sorted(random_rows(6))
    want = []
    for g in range(0, len(rows), 7):
        want += [(g // 7, i, s) for i, s in enumerate(packed(rows[g:g + 7]))]
    got = P.pack_by_batch(frame(spark, rows), L, "k", batch_rows=7).orderBy("batch", "seq_id").collect()
    assert [tuple(r) for r in got] == want


def test_training_pack_keeps_all_tokens(spark):
    rows = random_rows(7)
    d = P.pack_training(frame(spark, rows), L, "k", 1, buffer=16)
    got = d.collect()
    total = sum(len(i) for _, i in rows)
    assert len(got) == total // L
    assert all(r.labels == r.input_ids and r.attention_mask == [1] * L for r in got)


def test_collate(spark):
    rows = [(0, [1, 0, 2]), (1, []), (2, list(range(1, 12)))]
    d = frame(spark, rows).withColumnRenamed("ids", "input_ids")
    fixed = {r.k: r for r in P.collate_fixed(d, 5).collect()}
    assert fixed[0].input_ids == [1, 0, 2, 0, 0] and fixed[0].attention_mask == [1, 0, 1, 0, 0]
    assert fixed[2].input_ids == [1, 2, 3, 4, 5] == fixed[2].labels and fixed[1].input_ids == [0] * 5
    dyn = {r.k: r for r in P.collate_dynamic(P.with_batches(d, 2, "k"), pad=9).collect()}
    assert dyn[1].input_ids == [9, 9, 9] and dyn[1].attention_mask == [0, 0, 0]
    assert len(dyn[2].input_ids) == 11


def reference_mask(p, c, n, min_resp, whole=False):
    if len(p) + len(c) > n:
        keep = min(max(0, len(p) - (len(p) + len(c) - n)), max(0, n - min_resp - 1))
        p = (p if whole else []) if keep == 0 else p[len(p) - keep:]
    if len(p) + len(c) > n:
        c = c[:max(min_resp, n - len(p))]
    return p + c, [-100] * len(p) + c


@pytest.mark.parametrize("whole", [False, True])
def test_masks(spark, whole):
    lens = [(0, 0), (3, 0), (0, 4), (10, 10), (30, 5), (5, 30), (30, 30), (15, 16), (16, 16), (20, 12), (33, 1)]
    rows = [(i, list(range(a)), list(range(100, 100 + b))) for i, (a, b) in enumerate(lens)]
    d = spark.createDataFrame(rows, "k bigint, p array<int>, c array<int>")
    for n, r in ((20, 8), (8, 8), (6, 8)):
        out = P.mask_completion(d, "p", "c", n, r, whole_prompt_at_zero=whole)
        got = {x.k: x for x in out.withColumn("sup", P.supervised_tokens("labels")).collect()}
        for k, p, c in rows:
            ids, labels = reference_mask(p, c, n, r, whole)
            assert got[k].input_ids == ids and got[k].labels == labels, (k, n, r)
            assert got[k].sup == sum(x != -100 for x in labels)


def test_mask_padding_modes(spark):
    d = spark.createDataFrame([(0, [1], [2, 3], 0), (1, [1, 1], [4, 5, 6], 0)], "k bigint, p array<int>, c array<int>, b int")
    new = {r.k: r for r in P.mask_completion(d, "p", "c", 50, batch="b", pad=2).collect()}
    assert new[0].input_ids == [1, 2, 3, 2, 2] and new[0].labels == [-100, 2, 3, -100, -100]
    assert new[0].attention_mask == [1, 1, 1, 0, 0]
    old = {r.k: r for r in P.mask_completion(d, "p", "c", 50, batch="b", pad=2, legacy_pad_labels=True).collect()}
    assert old[0].labels == [-100, 2, 3, 2, 2]


def test_truncate_pair(spark):
    d = spark.createDataFrame([(list(range(10)), list(range(20)))], "p array<int>, c array<int>")
    t = d.select(P.truncate_pair("p", "c", 4, 10).alias("t")).first().t
    assert t.prompt_ids == [6, 7, 8, 9] and t.completion_ids == list(range(6))


@pytest.mark.parametrize("seed", range(4))
def test_repeated_rows_are_packed_from_places_alone(spark, seed, monkeypatch):
    rng = random.Random(seed)
    ids = {k: [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 16, 17, 60]))] for k in range(20)}
    order = [rng.randrange(20) for _ in range(rng.choice([1, 40, 150]))]
    starts = spark.createDataFrame([(place, k, len(ids[k])) for place, k in enumerate(order)], "place bigint, k bigint, n_tok int")
    rows = spark.createDataFrame(list(ids.items()), "k bigint, ids array<int>")
    whole = spark.createDataFrame([(place, ids[k]) for place, k in enumerate(order)], "place bigint, ids array<int>")
    want = P.pack_training(whole, L, "place", 3, buffer=16).orderBy("seq_id").collect()
    sent = []
    monkeypatch.setattr(P, "_assemble", lambda d, *a, f=P._assemble: sent.append(d) or f(d, *a))
    got = P.pack_placed(P.shuffled_starts(starts, "place", 3, "n_tok", buffer=16), rows, ["k"], L).orderBy("seq_id").collect()
    assert got == want
    assert all(len(r.piece) < L for r in sent[0].collect())

"""Scoring and metrics against plain Python, with hot keys and ties."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusflow.operators import diagnostics as D
from corpusflow.operators import evaluation as E
from corpusflow.operators import ngrams as N


def test_bigram_scores_with_a_hot_bigram(spark):
    rng = random.Random(0)
    docs = {k: ([7, 7, 7, 7] * 20 if k % 3 == 0 else [rng.randrange(30) for _ in range(40)]) for k in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, ids array<int>")
    bigrams, ctx = Counter(), Counter()
    for ids in docs.values():
        for a, b in zip([1, *ids], ids):
            bigrams[a, b] += 1
            ctx[a] += 1
    got = N.score_tokens(N.transitions(df, ["doc_id"]), N.bigram_counts(df), 50, k=0.5)
    rows = got.collect()
    assert len(rows) == sum(map(len, docs.values()))
    for r in rows:
        ids = docs[r.doc_id]
        a, b = ([1, *ids])[r.pos], ids[r.pos]
        assert (r.ctx, r.tok) == (a, b)
        assert r.logp == pytest.approx(math.log((bigrams[a, b] + .5) / (ctx[a] + .5 * 50)))
    far = N.score_tokens(N.transitions(df, ["doc_id"]), N.bigram_counts(df), 2_000_000)
    assert far.count() == len(rows)


def test_unseen_and_prompt_cut(spark):
    train = spark.createDataFrame([(0, [3, 4])], "doc_id bigint, ids array<int>")
    items = spark.createDataFrame([(9, [5, 3, 4], 1)], "doc_id bigint, ids array<int>, plen int")
    sc = N.score_tokens(N.transitions(items, ["doc_id", "plen"]), N.bigram_counts(train), 10)
    r = N.seq_logprob(sc, ["doc_id"], "plen").first()
    assert r.n_tok == 2 and r.logp == pytest.approx(math.log(1 / 10) + math.log(2 / 11))


@pytest.mark.parametrize("share,salts", [(0.0, 4), (0.3, 8), (1.0, 8)])
def test_salted_join_is_a_left_join(spark, share, salts):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(300)], "i bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    key = lambda rows: sorted((r.i, r.k, r.v or 0) for r in rows)
    got = N.salted_join(left, right, ["k"], ["i"], share=share, salts=salts)
    assert key(got.collect()) == key(left.join(right, "k", "left").collect())


def test_ngrams_topk_nucleus(spark):
    df = spark.createDataFrame([([1, 2, 1, 2, 3],), ([4],), ([],)], "ids array<int>")
    assert {tuple(r.gram): r.n for r in N.ngram_counts(df, 2).collect()} == {(1, 2): 2, (2, 1): 1, (2, 3): 1}
    bg = spark.createDataFrame([(0, t, n) for t, n in [(1, 50), (2, 30), (3, 15), (4, 5)]] + [(9, 1, 3)],
                               "ctx int, tok int, n bigint")
    top = [(r.tok, r.rank) for r in N.next_token_topk(bg, 2).filter("ctx = 0").orderBy("rank").collect()]
    assert top == [(1, 1), (2, 2)]
    kept = lambda p: {r.tok: round(r.p, 6) for r in N.nucleus(bg, p).filter("ctx = 0").collect()}
    assert kept(0.9) == {1: .625, 2: .375} and kept(0.1) == {1: 1.0}
    assert set(kept(0.95)) == {1, 2, 3}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"ties": np.repeat([1.0, 2.0, 5.0], [700, 10, 290]), "one": np.array([3.5]),
              "two": np.array([1.0, 2.0]), "wide": rng.normal(size=5000) * 1e6}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q0": 0.0, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    for blocks in (4, 1000):
        got = {r.g: r for r in E.exact_quantiles(df, "v", probs, ["g"], blocks).collect()}
        for g, xs in groups.items():
            for name, p in probs.items():
                assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12), (g, name, blocks)
    whole = E.exact_quantiles(df, "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))


def test_pair_metrics(spark):
    rows = [("m", 1.0, 1.0, 3, 4), ("m", 2.0, 1.0, 5, 6), ("m", 0.0, 4.0, 1, 2), ("n", -1.0, -2.0, 1, 1)]
    df = spark.createDataFrame(rows, "model string, lp_chosen double, lp_rejected double, len_chosen int, len_rejected int")
    got = {r.model: r for r in E.pair_metrics(df, ["model"]).collect()}
    margins = [0.0, 1.0, -4.0]
    assert got["m"].n == 3 and got["m"].acc == pytest.approx(1 / 3)
    assert got["m"].margin_median == 0.0 and got["m"].margin_p95 == pytest.approx(np.percentile(margins, 95))
    assert got["m"].len_chosen_tokens_mean == 3 and got["n"].margin_p95 == 1.0
    assert E.pair_metrics(df).first().n == 4


def test_perplexity_edges(spark):
    df = spark.createDataFrame([("a", 60.0, 2), ("b", 0.0, 0), ("c", 2.0, 1), ("c", 2.0, 3)],
                               "model string, nll double, n_tok bigint")
    got = {r.model: r for r in E.ppl_completion(df, group=["model"]).collect()}
    assert got["a"].ppl == math.inf and got["a"].loss == 30.0
    assert math.isnan(got["b"].loss) and got["b"].ppl == math.inf
    assert got["c"].ppl == pytest.approx(math.e)
    ranks = {r.model: r["rank"] for r in E.leaderboard_loss(E.ppl_completion(df, group=["model"])).collect()}
    assert ranks == {"c": 1, "a": 2, "b": 3}
    w = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 3)], "model string, loss double, n_tok bigint")
    assert E.ppl_weighted(w, group=["model"]).first().loss == pytest.approx(7 / 4)
    assert E.ppl_unweighted(w, group=["model"]).first().loss == pytest.approx(1.5)


def test_diagnostics(spark):
    d = spark.createDataFrame([(0, [1, 5]), (1, []), (2, [9])], "seq_id bigint, input_ids array<int>")
    assert tuple(D.id_range(d, 10).first()) == (1, 9, True)
    assert D.id_range(d, 9).first().vocab_ok is False
    assert D.id_range(d, 9, n=2).first().vocab_ok is True
    f = D.dataset_facts(d, seq_len=2).first()
    assert (f.rows, f.min_len, f.max_len, f.tokens, f.mismatched) == (3, 0, 2, 3, 2)
    v = spark.createDataFrame([([1.0, float("nan")],), ([float("-inf"), 2.0],)], "x array<double>")
    s = D.vector_stats(v, "x").first()
    assert s.has_nan and s.has_inf and s.n == 4
    loss = spark.createDataFrame([(float("nan"),), (float("-inf"),), (101.0,), (3.0,)], "l double")
    assert [r.x for r in loss.select(D.sanitize_loss("l").alias("x")).collect()] == [10.0, 10.0, 100.0, 3.0]
    b = D.token_budget(d, 100_000_000, 1024).first()
    assert (b.tokens_per_step, b.steps, b.rows_needed) == (32768, 3052, 3052 * 32)
    assert round(D.expected_fresh_loss(32000), 2) == 10.37

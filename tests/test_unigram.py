"""Likelihood pieces against all segmentations, merges on blocks against plain merging."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.operators import bpe as B
from corpusflow.operators import tokens as K
from corpusflow.operators import unigram as U
from tests.test_tokens import plain_bpe


def cuts(s):
    """All segmentations of a text."""
    for mask in itertools.product([0, 1], repeat=len(s) - 1):
        out, at = [], 0
        for i, m in enumerate(mask, 1):
            if m:
                out.append(s[at:i])
                at = i
        yield [*out, s[at:]]


COUNTS = {"abab": 9, "aba": 4, "bab": 3, "cab": 5, "c": 2, "éa": 1, "abcab": 6}


def table(spark, counts, parts=3):
    return spark.createDataFrame(list(counts.items()), "token string, n bigint").repartition(parts)


def expected(counts, score):
    units, ll = {}, 0.0
    for w, n in counts.items():
        ways = [(math.exp(sum(score[p] for p in c)), c) for c in cuts(B.WORD_START + w) if all(p in score for p in c)]
        total = sum(v for v, _ in ways)
        ll += n * math.log(total)
        for v, c in ways:
            for p in c:
                units[p] = units.get(p, 0.0) + n * v / total
    return units, ll


def test_expected_counts_equal_all_segmentations(spark):
    score = {p: math.log(w / 20) for p, w in zip(["▁", "a", "b", "c", "é", "ab", "▁a", "aba", "▁ab", "cab"], [3, 3, 3, 2, 1, 2, 2, 1, 1, 2])}
    want, ll = expected(COUNTS, score)
    got, found = U.expected_counts(table(spark, COUNTS), score)
    assert found == pytest.approx(ll, abs=1e-3)
    assert {p: c / U.UNIT for p, c in got.items()} == pytest.approx({p: want.get(p, 0.0) for p in score}, abs=1e-2)


def test_likelihood_never_falls_while_pieces_stay(spark):
    r = random.Random(4)
    counts = {"".join(r.choice("abcde") for _ in range(r.randrange(1, 9))): r.randrange(1, 30) for _ in range(300)}
    m = U.learn_unigram(table(spark, counts), 40, steps=4)
    assert len(m.score) <= 40
    for (n, a), (k, b) in zip(m.rounds, m.rounds[1:]):
        if n == k:
            assert b >= a - 1e-3 * abs(a) * 1e-3
    assert sum(math.exp(v) for v in m.score.values()) == pytest.approx(1.0)


def test_a_model_does_not_depend_on_the_layout(spark):
    a, b = (U.learn_unigram(table(spark, COUNTS, n), 9) for n in (1, 5))
    assert a == b
    assert {"▁", "a", "b", "c", "é"} <= set(a.score)


def test_best_path_equals_all_segmentations():
    r = random.Random(2)
    for _ in range(200):
        pieces = {"".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(7)}
        score = {p: -r.randrange(1, 40) / 4 for p in pieces}
        s = "".join(r.choice("abcx") for _ in range(r.randrange(1, 9)))
        value = lambda c: sum(score.get(p, -20.0 if len(p) == 1 else -math.inf) for p in c)
        got, path = U.best_path(s, score, -20.0)
        ways = [c for c in cuts(s) if value(c) > -math.inf]
        assert "".join(path) == s and got == pytest.approx(max(map(value, ways)))
        best = [c for c in ways if value(c) == pytest.approx(got)]
        assert path == max(best, key=lambda c: [len(p) for p in reversed(c)])


def test_dropped_piece_costs_its_next_best_segmentation():
    score = {"ab": -1.0, "a": -2.0, "b": -3.0, "abab": -1.5}
    assert U.best_path("abab", score, -30.0, barred="abab") == (-2.0, ["ab", "ab"])
    assert U.best_path("ab", score, -30.0, barred="ab") == (-5.0, ["a", "b"])


def test_encoding_falls_back_to_bytes_and_keeps_every_word(spark):
    m = U.learn_unigram(table(spark, COUNTS), 12)
    model = U.UnigramModel(spark, m)
    words = ["abab", "zé", "日本", "a" * 300, "😀"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in K.encode_text(df, model).collect()}
    back = {i: p.encode() for p, i in model.ids.items()} | {B.FIRST_BYTE + b: bytes([b]) for b in range(256)}
    assert b"".join(back[i] for i in got[1]).decode() == "".join(B.WORD_START + w for w in words)
    assert got[2] == [] and got[3] == []
    assert [i for i in got[1] if i < B.FIRST_PIECE] == [B.FIRST_BYTE + b for b in "z日本😀".encode()]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_merges_on_blocks_equal_plain_merging(spark, block):
    r = random.Random(block)
    counts = {"".join(r.choice("aabcé") for _ in range(r.randrange(1, 12))): r.randrange(1, 40) for _ in range(60)}
    assert B.learn_bpe(table(spark, counts), 30, batch=6, every=2, block=block) == plain_bpe(counts, 30)


def test_the_index_touches_only_types_that_hold_the_pair():
    block, keys, count = B.Block.of([[0, 1, 2], [1, 1, 1, 1], [2, 0, 1], [3]], [5, 2, 1, 9])
    assert dict(zip(keys.tolist(), count.tolist())) == {1: 6, 1 << 32 | 2: 5, 1 << 32 | 1: 6, 2 << 32: 1}
    assert block.holders(np.array([1])).tolist() == [0, 2]
    pairs, change = block.merge([(1, 1, 4)])
    assert dict(zip(pairs.tolist(), change.tolist())) == {1 << 32 | 1: -6, 4 << 32 | 4: 2}
    assert block.flat[block.first[1]:block.first[1] + block.size[1]].tolist() == [4, 4]
    assert block.holders(np.array([4 << 32 | 4])).tolist() == [1]


def test_merges_of_no_words(spark):
    assert B.learn_bpe(table(spark, {}, 1), 5) == []
    assert U.learn_unigram(table(spark, {}, 1), 5).score == {}


def random_types(seed, n, letters="aaabbcdefghé▁", longest=14):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randrange(1, longest))): r.randrange(1, 40) for _ in range(n)}


def written(monkeypatch, module, name):
    """Rows of every table the module writes by that name."""
    rows, write = [], module.materialize

    def seen(df, to):
        out = write(df, to)
        if to == name:
            rows.append(out.count())
        return out
    monkeypatch.setattr(module, "materialize", seen)
    return rows


@pytest.mark.parametrize("n_merges", [3, 12, 60])
def test_merges_are_learned_from_runs_of_frequent_pairs(spark, monkeypatch, n_merges):
    counts = random_types(n_merges, 400) | {"é": 3, "aaaaaaa": 50, "日本日本": 2}
    rows = written(monkeypatch, B, "runs")
    assert B.learn_bpe(table(spark, counts), n_merges, batch=6) == plain_bpe(counts, n_merges)
    assert rows and (n_merges > 3 or max(rows) < 250)


def test_words_are_split_together_like_one_by_one(spark, monkeypatch):
    counts = random_types(5, 200)
    words = [*random_types(6, 300, "aabcdéxyz日▁"), "a" * 64, "ab" * 90, "", "é" * 65]
    merges = [(a, b) for a, b, _ in plain_bpe(counts, 40)]
    pieces = B.BpeModel(spark, ["a", "b", "é"], merges)
    likely = U.UnigramModel(spark, U.Unigram({p: -1.0 - k % 5 / 4 for k, p in enumerate(["▁", "a", "b", "ab", "aab", "▁a", "é", "da", "bcd"])}))
    ids, score, unknown, longest = likely.data.value
    want = [[B.piece_ids(B.bpe_pieces(w, pieces.ranks), pieces.ids) for w in words],
            [B.piece_ids(U.best_path(B.WORD_START + w, score, unknown, longest)[1], ids) for w in words]]
    asked = []
    for module, name in ((B, "bpe_pieces"), (U, "best_path")):
        one = getattr(module, name)
        monkeypatch.setattr(module, name, lambda w, *rest, one=one: asked.append(w) or one(w, *rest))
    for model, ids_of in zip((pieces, likely), want):
        got, size = model.word_ids()(pa.array(words))
        assert got.tolist() == [i for w in ids_of for i in w] and size.tolist() == [len(w) for w in ids_of]
    assert all(len(w) > B.LONG for w in asked)


@pytest.mark.parametrize("seeds", [5, 40, 5000])
def test_seeds_are_looked_for_in_frequent_runs_only(spark, monkeypatch, seeds):
    counts = random_types(seeds, 300) | {"abcabcabcabcabcabc": 90, "é": 1}
    n = {}
    for w, c in counts.items():
        s = B.WORD_START + w
        for i, j in itertools.combinations(range(len(s) + 1), 2):
            if 2 <= j - i <= U.LONGEST:
                n[s[i:j]] = n.get(s[i:j], 0) + c
    want = sorted(((p, c) for p, c in n.items() if c > 1), key=lambda x: (-x[1] * len(x[0]), x[0]))[:seeds]
    rows = written(monkeypatch, U, "substrings")
    got = [tuple(r) for r in U.seed_pieces(table(spark, counts), seeds).collect()]
    assert sorted(got) == sorted(want)
    assert rows and (seeds > 5 or sum(rows) < len(n) / 4)


@pytest.mark.parametrize("steps", [0, U.TABLE])
def test_sums_of_probabilities_equal_sums_of_logarithms(monkeypatch, steps):
    monkeypatch.setattr(U, "TABLE", steps)
    words = list(random_types(9, 200, "abcdx", 12))
    trie = U.Trie(["▁", "a", "b", "c", "d", "ab", "abc", "▁a", "cd", "dd"])
    score = np.linspace(-1.5, -9, 10)
    x, y = U.lattices(words, trie), U.lattices([*words, "ab" * 300], trie)  # the long one makes the other sum needed
    (whole, post), (logs, more) = U.forward_backward(x, score), U.forward_backward(y, score)
    assert whole == pytest.approx(logs[:-1], abs=1e-9) and np.isinf(whole).any() and np.isfinite(whole).any()
    own = np.searchsorted(y.last, y.end) < len(words)
    assert post == pytest.approx(more[own], abs=1e-9)

"""Encoding and merge learning against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpusflow.functions import arrow_text as T
from corpusflow.operators import bpe as B
from corpusflow.operators import tokens as K

TEXTS = ["a b\nc", "", " \n \n", "a  a\tb\n\nzz 　q", "é a b", None, "x\n", "\nlast"]


@pytest.fixture(scope="module")
def vocab_rows():
    return [("a", 3), ("b", 4), ("é", 5)]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, text string")


def test_encode_lines(spark, vocab_rows):
    ids = dict(vocab_rows)
    v = K.Vocab(spark.createDataFrame(vocab_rows, "token string, id int"))
    for keep_blank in (False, True):
        want = []
        for t in TEXTS:
            out = []
            for line in (t or "").split("\n"):
                if (line if keep_blank else line.strip()):
                    out += [ids.get(w, 0) for w in line.split()] + [2]
            want.append(out)
        got = K.encode_lines(frame(spark), v, keep_blank=keep_blank).orderBy("k").collect()
        assert [r.ids for r in got] == want
        assert [r.n_tok for r in got] == [len(w) for w in want]


def test_encode_text_with_bytes(spark, vocab_rows):
    ids = dict(vocab_rows)
    v = K.Vocab(spark.createDataFrame(vocab_rows, "token string, id int"), first_byte=10)
    want = [[x for w in (t or "").split() for x in ([ids[w]] if w in ids else [10 + b for b in w.encode()])]
            for t in TEXTS]
    assert [r.ids for r in K.encode_text(frame(spark), v).orderBy("k").collect()] == want


def test_encode_token_lists(spark, vocab_rows):
    v = K.Vocab(spark.createDataFrame(vocab_rows, "token string, id int"))
    d = spark.createDataFrame([(0, ["a", "\n", "q"]), (1, []), (2, None), (3, ["b"])], "k int, w array<string>")
    got = d.select("k", K.encode("w", v).alias("ids")).orderBy("k").collect()
    assert [r.ids for r in got] == [[3, 2, 0], [], [], [4]]


def test_vocab_limit(spark, vocab_rows):
    with pytest.raises(ValueError):
        K.Vocab(spark.createDataFrame(vocab_rows, "token string, id int"), limit=2)


def plain_bpe(counts, n):
    words = {tuple([B.WORD_START, *w]): c for w, c in counts.items()}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((*best, pairs[best]))
        new = Counter()
        for w, c in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i:i + 2] == best:
                    out.append(w[i] + w[i + 1])
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            new[tuple(out)] += c
        words = new
    return merges


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batched_merges_equal_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("ab\\$cdé" if seed else "ab") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 40)
              for _ in range(60)}
    df = spark.createDataFrame(list(counts.items()), "token string, n bigint")
    assert B.learn_bpe(df, 25, batch=8, every=3) == plain_bpe(counts, 25)


def test_merges_run_out(spark):
    df = spark.createDataFrame([("ab", 2)], "token string, n bigint")
    assert B.learn_bpe(df, 10) == [("a", "b", 2), (B.WORD_START, "ab", 2)]


def test_encode_bpe(spark):
    merges = [("a", "b", 9), (B.WORD_START, "ab", 5), ("ab", "ab", 2)]
    m = B.BpeModel(spark, ["a", "b"], merges)
    got = K.encode_lines(spark.createDataFrame([("ab abab\nz aab",)], "text string"), m).first().ids
    name = {i: p for p, i in m.ids.items()}
    byte = lambda s: [B.FIRST_BYTE + b for b in s.encode()]
    text = [name.get(i, i) for i in got]
    assert text == ["▁ab", "▁ab", "ab", 2, "▁", *byte("z"), "▁", "a", "ab", 2]


def test_coverage_and_padding(spark):
    d = spark.createDataFrame([("aaaa bbb c",)], "text string")
    assert {r.ch for r in K.char_coverage(d, 0.8).collect()} == {"a", "b"}
    assert {r.ch for r in K.char_coverage(d, 1.0).collect()} == {"a", "b", "c"}
    p = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    r = K.padded_with_labels(p, max_length=5).first()
    assert r.input_ids == [1, 2, 3, 2, 2] == r.labels and r.attention_mask == [1, 1, 1, 0, 0]
    assert p.select(K.keep_right("ids", 10, 8).alias("x")).first().x == [1, 2, 3]
    long = spark.createDataFrame([(list(range(20)),)], "ids array<int>")
    assert long.select(K.keep_right("ids", 18, 8).alias("x")).first().x == list(range(10, 20))


def test_a_batch_is_encoded_in_parts_of_bounded_bytes(monkeypatch):
    rng = random.Random(1)
    texts = [rng.choice(["", " ", "\n", "ä b\nc  d", "a " * rng.randrange(400)]) for _ in range(300)]
    seen = []

    def known(words):
        seen.append(sum(map(len, words.to_pylist())))
        return np.array([len(w) for w in words.to_pylist()], np.int32), np.ones(len(words), np.int64)
    lists = pa.array([t.split() if t else None for t in texts], pa.list_(pa.string()))
    calls = [lambda: T.line_ids(pa.array(texts), known, 2, False), lambda: T.line_ids(pa.array(texts).slice(7, 200), known, 2, True),
             lambda: T.text_ids(pa.array(texts), known), lambda: T.list_ids(lists, known), lambda: T.list_ids(lists.slice(5), known),
             lambda: T.count_line_tokens(pa.array(texts), True), lambda: T.text_ids(pa.array([], pa.string()), known)]
    want = [c() for c in calls]
    seen.clear()
    monkeypatch.setattr(T, "PART_BYTES", 1000)
    assert [c() for c in calls] == want
    assert max(seen) < 1000 + 800 and len(seen) > 50

"""Best-fit packing: ids against the library, packing against its rules, bounds against exhaustive packings."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tokenizers

from corpusflow.llm import best_fit
from tests.llm import cases

PATH = P.path("word_bpe_49k.json")
ODD = ["<|endoftext|> x <|startoftext|>y.", "İ. İstanbul. ΑΣ. ΣΑΣ, क़. é. É!", "don't CAN'T 12.5 3,4", "日本語 のテキスト。 😀.", "a\tb c d\r\ne",
       "tail... end?! (x). \"q\".", "K Å ﬁ ſ", "\x00 \x1c x", "x" * 300, " . , ; "]


def least_bins(sizes, capacity):
    """Fewest bins by trying every placement."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1:])
        place(i + 1, bins + [sizes[i]])
    place(0, [])
    return best


def test_bounds_never_exceed_and_bins_never_undercut_the_least():
    r = random.Random(1)
    met = 0
    for _ in range(300):
        capacity = r.choice([6, 10, 12])
        sizes = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 8))), reverse=True)
        least = least_bins(sizes, capacity)
        bound, _ = best_fit.lower_bound(*np.unique(np.array(sizes), return_counts=True), capacity)
        bins, at, n = best_fit.best_fit(sizes, capacity)
        assert bound <= least <= n
        met += bound == n
        fill = {}
        for s, b, o in zip(sizes, bins, at):
            assert fill.get(b, 0) == o
            fill[b] = o + s
        assert len(fill) == n and max(fill.values()) <= capacity
    assert met > 250


def check(rows, texts, capacity):
    """Every piece of every text once, sequences without holes, nothing too long."""
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s:s + capacity], "<u4")
            want.append((str(i), k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end = o + n
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("capacity,tokens", [(16, 1 << 22), (64, 512), (2048, 1 << 22)])
def test_pieces_and_sequences(spark, monkeypatch, capacity, tokens):
    monkeypatch.setattr(best_fit, "TOKENS", tokens)
    docs = cases.table(spark, cases.texts(5, 40, 30) + ODD)
    rows = best_fit.pack_documents(docs, PATH, capacity).collect()
    n = check(rows, cases.pairs(docs), capacity)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // capacity) + 2 + total // tokens // 4  # a quarter of a sequence a partition at most


def test_exchange_saves_sequences(spark, monkeypatch):
    r = random.Random(2)
    pieces = [(i, 0, 0, r.choice([700, 1100, 1500, 300, 90]), i) for i in range(3000)]
    df = spark.createDataFrame(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    monkeypatch.setattr(best_fit, "TOKENS", 1 << 15)
    count = lambda rounds: best_fit.pack(df, 2048, rounds=rounds).select("sequence_id").distinct().count()
    alone, exchanged = count(0), count(4)
    bound, _ = best_fit.lower_bound(*np.unique(np.array([p[3] for p in pieces]), return_counts=True), 2048)
    assert bound <= exchanged < alone
    assert best_fit.pack(df, 2048, rounds=4).count() == 3000


def test_one_text_on_many_rows_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "TOKENS", 1 << 12)
    docs = spark.createDataFrame([(5, "the same text again")] * 4000, "doc_id bigint, text string").repartition(3)
    rows = best_fit.pack_documents(docs, PATH, 64).collect()
    per = {}
    for r in rows:
        per[r["sequence_id"] >> 22] = per.get(r["sequence_id"] >> 22, 0) + 1
    assert len(rows) == 4000 and max(per.values()) < 4000 / 3


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (None, "four five " * 60)], "doc_id bigint, text string")
    packed = best_fit.pack_documents(docs, PATH, 32)
    out = best_fit.sequences(packed, best_fit.token_pieces(docs, PATH, 32, keep_ids=True)).collect()
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = sorted(itertools.chain(*[lib.encode(t or "", add_special_tokens=False).ids + [0] for t in ("one two three", None, "four five " * 60)]))
    assert sorted(i for r in out for i in r["input_ids"]) == want
    assert all(len(r["input_ids"]) <= 32 and r["starts"][0] == 0 for r in out)


def test_empty_table_and_text_ids(spark):
    assert best_fit.pack_documents(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0
    (r,) = best_fit.pack_documents(spark.createDataFrame([("x", "")], "doc_id string, text string"), PATH).collect()
    assert (r["doc_id"], r["length"], r["ids_crc32"], r["offset"]) == ("x", 1, zlib.crc32(bytes(4)), 0)


def test_words_of_letters_are_encoded_in_few_calls_and_as_by_the_library():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = best_fit.Encoder(f.read())
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghéñİßЖΣσ日") for _ in range(r.randrange(1, 12))) + r.choice(["", ".", "$$$", ",&&&", "***"]) for _ in range(3000)]
    texts = [" ".join(words[i:i + 50]) for i in range(0, 3000, 50)]
    texts += ["", " ", "x<|endoftext|> <|startoftext|>.", "don't\nHe'LL\t aͅ. é É. (a) 12 1a &&&", "a" * 200 + " " + "é" * 99 + "!"]
    want = [encoder._library([t])[0] for t in texts]
    calls, library = [], encoder._library
    encoder._library = lambda parts: calls.append(len(parts)) or library(parts)
    for _ in range(2):  # then from memory
        assert [x.tobytes() for x in encoder.encode_all(pa.array(texts))] == want
    assert [encoder.encode(t) for t in texts] == want
    assert all(len(w) <= best_fit.LONG for w in [*encoder.number, *encoder.cores])
    simple = best_fit.Encoder(encoder.lib.to_str())
    asked, library = [], simple._library
    simple._library = lambda parts: asked.extend(parts) or library(parts)
    simple.encode(" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(500)))
    assert not asked

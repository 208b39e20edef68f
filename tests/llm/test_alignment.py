"""Cross-tokenizer alignment against the libraries on whole texts."""

import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from corpusflow.llm import alignment
from tests.llm import cases

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """Every text encoded whole; groups and links from the byte offsets."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    level = alignment.byte_level()
    made = []
    for i, t in rows:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [bytes(level[c] for c in a.id_to_token(k)) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        want = (" " + (t or "")).encode()
        if not t or b"".join(xb) != want or b"".join(yb) != want:
            made.append((i, [], [], [], []))
            continue
        at = [{e: k for k, e in enumerate(accumulate(map(len, z)))} for z in (xb, yb)]
        both = sorted(set(at[0]) & set(at[1]))
        links = [(x[at[0][e]], y[at[1][e]]) for e in both]
        groups, p, q = [], 0, 0
        for e in both:
            p2, q2 = at[0][e] + 1, at[1][e] + 1
            groups.append(",".join(map(str, x[p:p2])) + "|" + ",".join(map(str, y[q:q2])))
            p, q = p2, q2
        made.append((i, x, y, links, groups))
    counts = Counter(k for m in made for k in m[3])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return sorted((str(i), len(x), len(y), len(g), len(k), sum(counts[z] == top[z[1]] for z in k), sum(counts[z] for z in k), ";".join(g))
                  for i, x, y, k, g in made), counts


ODD = ["a ▁ b", "<|endoftext|> x <s> </s> <unk>", "two  spaces\n\nand\ttabs ", " leading", "日本語 のテキスト 😀 é é", "nul \x00 \x1c sep",
       "it's can't  don't 12 345, one, two. three... four?! 5. É. x². ²! .,; a.b. <|endoftext|>. s,", " nbsp wide", "x" * 3000, "the " * 500, " ", "\n", "ﬁ Å"]


def test_every_measure_equals_brute_force(spark):
    docs = cases.table(spark, cases.texts(3, 30, 20) + ODD)
    got, pairs = alignment.align(docs, A, B, block_bytes=400)  # several blocks a task
    want, counts = brute(cases.pairs(docs))
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((str(r["doc_id"]), *[r[c] for c in cols]) for r in got.collect()) == want
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == counts


def test_digest_is_of_the_groups_and_empty_stays_empty(spark):
    docs = spark.createDataFrame([(1, "some text here"), (2, None), (3, "")], "doc_id bigint, text string")
    full = {r["doc_id"]: r["groups"] for r in alignment.align(docs, A, B)[0].collect()}
    got = {r["doc_id"]: r["groups"] for r in alignment.align(docs, A, B, digest=True)[0].collect()}
    assert got == {1: hashlib.sha256(full[1].encode()).hexdigest(), 2: "", 3: ""}


def test_copies_weigh_in_whatever_the_layout(spark):
    rows = [(i, "a much copied text") for i in range(300)] + [(i, f"a text {i}") for i in range(300, 400)]
    out = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
        out.append(sorted(map(tuple, alignment.align(docs, A, B)[0].collect())))
    assert out[0] == out[1]
    assert {r[6] for r in out[0] if r[0] < 300} == {2 * 300 + 2 * 400}  # "a" and "text" are in all 400 texts


@pytest.mark.parametrize("id_type", ["bigint", "string"])
def test_empty_table(spark, id_type):
    got, pairs = alignment.align(spark.createDataFrame([], f"doc_id {id_type}, text string"), A, B)
    assert got.count() == 0 and pairs.count() == 0

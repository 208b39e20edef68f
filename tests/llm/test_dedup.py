"""SimHash, phrase automata and radix-sorted suffixes against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import arrays, components, phrases, simhash, suffixes

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.table(spark, cases.texts()).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return cases.pairs(docs)


@pytest.mark.parametrize("hot", [2, 2000])
def test_phrases_match_brute_force(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "SPREAD", 2)
    monkeypatch.setattr(phrases, "SHARD_ROWS", 7)
    got = phrases.dedup_phrases(docs, length=6).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == cases.phrases(rows, 6)
    assert all(sum(s["e"] - s["s"] for s in r["spans"]) == r["n_removed"] for r in got)


@pytest.mark.parametrize("hot", [2, 2000])
def test_suffixes_match_brute_force(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = suffixes.dedup_substrings(docs, length=15).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == cases.suffixes(rows, 15)


@pytest.mark.parametrize("fn,length", [(phrases.dedup_phrases, 35), (suffixes.dedup_substrings, 200)])
def test_empty_table(docs, fn, length):
    assert fn(docs.where("false"), length=length).count() == 0


def test_many_copies_without_an_id(spark):
    r = random.Random(8)
    copied, shared = (" ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(40)) for _ in range(2))
    texts = [copied] * 300 + [None] * 20 + [f"own {shared} end", f"{shared} another", "x y z"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string").repartition(5)
    pairs = [(None, t) for t in texts]
    got = phrases.dedup_phrases(df, length=6).collect()
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept"]) for x in got) == cases.phrases(pairs, 6)
    got = suffixes.dedup_substrings(df, length=15).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == cases.suffixes(pairs, 15)


def test_anchors_are_the_same_across_piece_borders(monkeypatch):
    r = random.Random(2)
    data = np.frombuffer(bytes(r.choice(b"abc") for _ in range(5000)), np.uint8)
    cuts = np.array([0, 3000, 5000])

    def found():
        return sorted((int(a), int(b), int(c), int(d)) for x in arrays.anchors(data, cuts, 50, arrays.BYTE_CODES) for a, b, c, d in zip(*x))
    whole = found()
    monkeypatch.setattr(arrays, "PIECE", 300)
    assert found() == whole and whole


def test_simhash_matches_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [cases.fingerprint(t) for _, t in rows]
    want = zip((str(i) for i, _ in rows), (f"{f:016x}" for f in fps), map(str, cases.components(fps, [i for i, _ in rows])))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted(want)


def test_keep_one_keeps_the_least_row_of_each_class(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(cases.classes([cases.fingerprint(t) for _, t in rows])))


def test_covering_finds_every_pair_within_three_bits():
    r = random.Random(5)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randrange(1, 4)):
            b ^= 1 << bit
        rows, keys, home = simhash.covering(np.array([a, b], np.uint64))
        seen = [set(keys[rows == i].tolist()) for i in (0, 1)]
        homes = [set(keys[(rows == i) & home].tolist()) for i in (0, 1)]
        assert homes[0] & seen[1] and homes[1] & seen[0]
        assert len(seen[0]) <= 34


@pytest.mark.parametrize("block", [3, 4096])
def test_links_of_one_large_cluster(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(4)
    root = {x["u"] & (2**64 - 1): x["root"] & (2**64 - 1) for x in components.components(simhash.links(df)).collect()}
    got = [root.get(f, f) for f in fps]
    want = cases.components(fps, list(range(len(fps))))
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(50)] + [(7, 7), (100, 101), (101, 100), (100, 101)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["u"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}
    assert components.components(df.where(F.lit(False))).count() == 0

"""Top-k, WARC, decontamination, mixtures, and the pipeline."""

import gzip
import hashlib
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import decontaminate, mixture, queries, topk, warc
from tests.oracle import connect, difference

from . import cases


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf, name):
    assert difference(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLE[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# top-k

def _best(rows, k):
    v = {i: np.floor(1024 * np.array(x, float)).astype(object) for i, x in rows
         if i is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    out = []
    for q in v:
        if q % 5 == 0:
            s = sorted((-int((v[q] * v[c]).sum()), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard,scale", [(16, 1.0), (4096, 1.0), (16, 3e4)])
def test_top_k_matches_brute_force(spark, shard, scale):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6).round(1) * scale).tolist()) for i in range(150)]
    rows += [(150 + i, rows[7][1]) for i in range(40)]  # many equal vectors
    rows += [(500, None), (505, []), (510, [1.0, None, 2.0]), (515, [float("nan")] * 6), (520, [float("inf")] * 6),
             (525, [1.0, 2.0]), (530, [2.0, 1.0]), (535, [3.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = topk.top_k(df, lambda i: i % 5 == 0, k=4, shard=shard).collect()
    assert sorted(tuple(x) for x in got) == _best(rows, 4)
    assert topk.top_k(df.where("false"), lambda i: i % 5 == 0).count() == 0


def test_tree_search_of_one_shard():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-9, 9, (90, 5)) + 200 * r.integers(-3, 3, 5) for _ in range(8)])
    x[40:70] = x[40]
    ids = r.permutation(len(x))
    tree = topk.ball_tree(x.astype(float), 8)
    assert sorted(np.concatenate([a for a, c in zip(tree.rows, tree.child) if c[0] < 0])) == list(range(len(x)))
    for at, centre, radius in zip(tree.rows, tree.centre, tree.radius):
        assert (np.sqrt(((x[at] - centre) ** 2).sum(1)) <= radius * (1 + 1e-9) + 1e-9).all()
        assert (x[::50] @ x[at].T <= topk.bounds(x[::50].astype(float), centre[None], np.array([radius]))).all()
    floor = np.where(np.arange(len(x[::50])) % 2, -2 ** 63, np.sort(x[::50] @ x.T, 1)[:, -3])
    got = list(zip(*(a.tolist() for a in topk.search(ids[::50], x[::50], floor, ids, x, 6, leaf=8))))
    want = []
    for q, v, low in zip(ids[::50], x[::50], floor):
        best = sorted((-int(v @ c), int(i)) for i, c in zip(ids, x) if i != q)[:6]
        want += [(q, i, -s) for s, i in best if -s >= low]
    assert sorted(got) == sorted(want)


def test_far_shards_meet_no_query(spark):
    r = np.random.default_rng(6)
    spots = 300 * np.eye(8)
    rows = [(i, (spots[i % 8] + r.normal(size=8)).tolist()) for i in range(640)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    placed = topk.to_shards(topk.to_integers(df, "vec_id", "embedding", 1.0), 40).cache()
    sizes = placed.groupBy("shard").count().collect()
    assert sum(s["count"] for s in sizes) == 640 and len(sizes) >= 16 and max(s["count"] for s in sizes) <= 80
    asked = placed.where("id % 10 = 0").withColumns({"block": F.lit(0), "low": F.lit(80_000).cast("bigint")})
    pairs = topk._worth(topk._roots(placed), asked, 1).agg(F.sum(F.size("others"))).first()[0]
    assert 0 < pairs < 64 * (len(sizes) - 1) / 2
    placed.unpersist()
    got = topk.top_k(df, lambda i: i % 5 == 0, k=4, scale=1.0, shard=40).collect()
    v = {i: np.floor(np.array(x)).astype(int) for i, x in rows}
    want = [(q, n + 1, c, -s) for q in v if q % 5 == 0
            for n, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:4])]
    assert sorted(tuple(x) for x in got) == sorted(want)


# WARC

PAGES = [(3, "http://a/", "same ä"), (1, "http://b/\r\nX: y", "same ä"), (2, None, None), (4, "u", ""), (5, "u", "x" * 300_000),
         (5, "u", "x" * 300_000), (None, "u", "same ä"), (6, "u", "head\r\n\r\nContent-Length: 3\r\n\r\nbody"), (7, "u", "other"), (7, "v", "else")]


def _round(spark, folder, least=0, **how):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("size", F.lit("x")).repartition(3)
    uri = f"file://{folder}/w{os.urandom(4).hex()}"
    warc.write(df, uri, least=least, **how)
    return uri, warc.read(spark, uri, payloads=True)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, folder, least):
    uri, back = _round(spark, folder, least, roll=200, shards=2)
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        h = h or ""
        again = i is not None and first.get(h, i) < i
        want.append((str(i), len(h.encode()), warc.digest(h.encode()), "revisit" if again else "response",
                     first[h] if again else None, None if again else h))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in back.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    files = json.load(open(uri[7:] + "/manifest.json"))
    assert sum(f["records"] for f in files) == len(PAGES) and len(files) > 2
    for f in files:
        raw = open(f"{uri[7:]}/{f['name']}", "rb").read()
        assert len(raw) == f["bytes"] and cases.sha(raw) == f["sha256"] and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        assert f["records"] == 1 or f["bytes"] <= 200


def test_warc_is_the_same_on_every_run(spark, folder):
    sums = [json.load(open(_round(spark, folder, shards=2)[0][7:] + "/manifest.json")) for _ in range(2)]
    assert sums[0] == sums[1]


def test_warc_of_no_pages(spark, folder):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write(df, f"file://{folder}/none")
    assert warc.read(spark, f"file://{folder}/none").count() == 0


def test_archives_do_not_depend_on_the_layout(spark, folder):
    rows = spark.range(2600).select((F.col("id") * 3).alias("page_id"), F.lit("http://a/").alias("url"),
                                    F.expr("repeat(cast(id % 700 as string), 50)").alias("html"))
    rows = rows.union(spark.range(40).selectExpr("null", "cast(id % 3 as string)", "cast(id as string)"))
    got = []
    for i, n in enumerate((2, 7)):
        uri = f"file://{folder}/layout{i}"
        warc.write(rows.repartition(n, F.rand(i)), uri, roll=3000, shard_bytes=300_000)
        got.append(json.load(open(uri[7:] + "/manifest.json")))
    assert got[0] == got[1] and sum(f["records"] for f in got[0]) == 2640
    assert len({f["name"][:11] for f in got[0]}) >= 4
    numbered = [f for f in got[0] if f["first"] is not None]
    assert all(a["last"] < b["first"] for a, b in zip(numbered, numbered[1:]))


def test_a_broken_commit_ends_well(spark, folder, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    uri, commit = f"file://{folder}/broken", warc.commit
    monkeypatch.setattr(warc, "commit", lambda *_: None)
    manifest = warc.write(df, uri, roll=200, shards=2)
    done = manifest.first()
    os.rename(f"{uri[7:]}/{done['temp']}", f"{uri[7:]}/{done['name']}")
    commit(manifest, uri)
    assert warc.read(spark, uri).count() == len(PAGES) and not os.path.exists(f"{uri[7:]}/_temporary")
    commit(manifest, uri)
    os.remove(f"{uri[7:]}/{done['name']}")
    with pytest.raises(Exception, match="neither written nor committed"):
        commit(manifest, uri)


def test_damage_is_found():
    raw = warc.record("1", "u", b"payload", None, "")
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


# decontamination

def test_contamination_matches_brute_force(spark):
    texts = cases.texts(7)
    docs = cases.table(spark, texts)
    items = [(1, texts[5]), (20, " ".join((texts[6] or "").split()[3:12])), (3, "ab"), (4, None), (5, " .,"), (6, texts[5]), (7, "Nowhere to be found"),
             (None, "É ß"), (8, texts[40])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("x"))
    rows = cases.pairs(docs)
    got = decontaminate.contamination(docs, bench, window=4).collect()
    assert len(got) == len(rows)  # their values: test_contamination_strict
    kept = decontaminate.clean(docs, bench, window=4)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in got)
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, bench.where("false")).collect()} == {0}


def test_near_matches_allow_other_order_and_gaps(spark):
    docs = spark.createDataFrame([(1, "zeta x Alpha y beta gamma"), (2, "alpha beta gamma"), (3, "alpha zeta" + " q" * 20 + " beta gamma"), (4, None)],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma zeta")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.near_matches(docs, bench, window=4, slop=2).collect()] == [1]


@pytest.mark.parametrize("slop", [0, 3])
def test_near_matches_match_brute_force(spark, slop):
    rng = random.Random(slop)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(40)] + [(40, None), (40, "a b"), (None, "c a b d")]
    items = ["a b c d", "e a", "f f g h a", "zz a", "h"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = set()
    for i, text in rows:
        words = (text or "").split()
        for item in items:
            asked = item.split()
            for s in range(max(1, len(asked) - 2)):
                part = set(asked[s:s + 3])
                if any(part <= set(words[p:p + 3 + slop]) for p in range(len(words))):
                    want.add((i, item, s))
    names = decontaminate.items_of(bench, "item_id", "text")
    got = decontaminate.near_matches(docs, bench, window=3, slop=slop).join(names, "item")
    assert {(r["doc_id"], " ".join(r["words"]), r["at"]) for r in got.collect()} == want


def test_frequent_terms_and_copies_give_whole_matches(spark):
    rows = [(i, "the " * 300 + "of the cat the the") for i in range(30)] + [(99, "the the")] + [(None, "the of the cat the the x")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "of the cat the the"), (2, "the the the the"), (3, "the")], "item_id bigint, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in decontaminate.contamination(docs, bench, window=4).collect()}
    assert len(got) == 32 and got[0, 305] == 305 and got[99, 2] == 2 and got[None, 7] == 6


# mixture

def test_mixture_keeps_budgets_and_bounds(spark):
    docs = cases.table(spark, cases.texts(9))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    for block in (2, 64):
        old, mixture.BLOCK = mixture.BLOCK, block
        try:
            got = mixture.mix(docs, labels).collect()
        finally:
            mixture.BLOCK = old
        sizes = sorted(len(cases.WORD.findall(t or "")) for _, t in cases.pairs(docs))
        assert sorted(r["size"] for r in got) == sizes
        by = {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            s[0] += r["taken"]
            s[1] += r["size"]
        assert all(abs(t - target) <= 0.5 + 1e-6 and size == s and target <= 2 * s + 1e-6 for t, size, target, s in by.values())
        assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(sizes)) < 1e-6 * sum(sizes) + 1e-6
    assert mixture.mix(docs.where("false"), labels).count() == 0
    assert {r["taken"] for r in mixture.mix(docs.where("text is null"), None).collect()} == {0}


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "w w w w", "a") for i in range(2000)] + [(5000 + i, "w w w w", "b") for i in range(4000)],
                                 "doc_id bigint, text string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    got = mixture.mix(docs, labels, weights=(1.0,), share=0.3).where("taken > 0").join(labels, "doc_id")
    n = {r["quality"]: r["count"] for r in got.groupBy("quality").count().collect()}
    assert n[1] > 2 * n[0]


def test_rows_without_id_draw_by_their_text(spark):
    texts = ["w " * (1 + i % 9) + str(i) for i in range(1500)] + ["same words"] * 40
    docs = spark.createDataFrame([(None, t, "a") for t in texts], "doc_id bigint, text string, source string").repartition(4)
    sizes = [len(t.split()) for t in texts]
    goal = int(0.3 * sum(sizes) + 0.5)

    def draw(t):
        return -math.log((int(hashlib.md5(f"mix||{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52)
    want, left = [], goal
    for t in sorted(texts, key=draw):
        n = len(t.split())
        want.append((n, max(0, min(n, left))))
        left -= n
    got = mixture.mix(docs, weights=(1.0,), share=0.3).select("size", "taken").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert len({draw(t) for t in texts}) == 1501


# pipeline

def test_pipeline_keeps_the_least_document_of_each_simhash_class(spark, sf):
    docs = cases.table(spark, cases.texts(11) + ["one two three four five six"] * 3).where("doc_id is not null")
    rows = cases.pairs(docs)
    first = {}
    for (i, t), c in zip(rows, cases.classes([cases.fingerprint(t) for _, t in rows])):
        first[c] = min(first.get(c, (i, t or "")), (i, t or ""), key=lambda x: x[0])
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(i for i, _ in cases.pairs(kept)) == sorted(i for i, _ in first.values())


def test_pipeline_applies_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step, seen = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns and step.dtypes == docs.dtypes
        seen.append(step.count())
    assert seen == sorted(seen, reverse=True) and 0 < seen[2] < seen[1] and seen[4] == seen[3]
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r["doc_id"] for r in out} <= {r["doc_id"] for r in step.select("doc_id").collect()}


def test_pipeline_stages_take_awkward_and_empty_tables(spark, sf):
    docs = cases.table(spark, cases.texts(3))
    for df in (docs, docs.where("false")):
        step = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, sf)
            assert step.columns == docs.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, step, sf).count() > 0) == (df is docs)

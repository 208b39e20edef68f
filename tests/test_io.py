"""Readers and writers on edge files; streams equal batches."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import tokens as K
from corpusflow.session import materialize, shared_dir
from corpusflow.sources import readers as R
from corpusflow.sources import writers as W
from corpusflow.streaming import streams as S


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "wt", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_lines_in_order_across_splits(spark, folder):
    big = "".join(f" line {i} \n" if i % 5 else "　\n" for i in range(4000))
    a, b = put(f"{folder}/a.txt", big), put(f"{folder}/b.txt", "x\r\ny\rz")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = R.read_lines(spark, [a, b]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {(os.path.basename(r.path), r.line_no): r.line for r in rows}
    want = {("a.txt", i): f"line {i}" for i in range(4000) if i % 5}
    want.update({("b.txt", i): c for i, c in enumerate("xyz")})
    assert got == want


def test_jsonl_keys(spark, folder):
    lines = ['{"text":1,"content":" c "}', '{"text":""}', "bad", "[1]", '{"body":"b"}', '{"x":"y"}', "",
             '{"text":"t"} trailing', '{"text":null,"document":"d"}']
    for name in ("p.jsonl", "q.ndjson.gz"):
        p = put(f"{folder}/{name}", "\n".join(lines))
        got = [r.text for r in R.read_jsonl_text(spark, p).orderBy("line_no").collect()]
        assert got == ["c", "", "b", "d"]


def test_parquet_keys(spark, folder):
    spark.createDataFrame([(" a ", 1), (None, 2)], "Content string, n int").write.parquet(f"{folder}/one")
    spark.createDataFrame([(1,)], "text int").write.parquet(f"{folder}/two")
    spark.createDataFrame([("z",)], "other string").write.parquet(f"{folder}/three")
    put(f"{folder}/four/x.parquet", "not parquet")
    with pytest.warns(UserWarning):
        got = R.read_parquet_text(spark, [f"{folder}/{n}" for n in ("one", "two", "three", "four", "none")])
    assert [r.text for r in got.collect()] == ["a"]


def test_scan_and_resolve(spark, folder):
    for n in ("a.txt", "d/b.jsonl.gz", "d/c.arrow", "d/e.csv", "d/f.TXT"):
        put(f"{folder}/{n}", "x")
    got = {os.path.basename(r.path): (r.ext, r.skipped) for r in R.scan_files(spark, [folder, "/no/such", ""]).collect()}
    assert got == {"a.txt": (".txt", False), "b.jsonl.gz": (".jsonl.gz", False), "c.arrow": (".arrow", True)}
    assert R.scan_files(spark, ["/no/such"]).count() == 0
    with pytest.raises(FileNotFoundError):
        R.resolve_dataset(spark, "x", folder)
    put(f"{folder}/x.arrow/f", "1")
    assert R.resolve_dataset(spark, "x", folder).endswith("x.arrow")


def test_instructions_file(spark, folder):
    p = put(f"{folder}/i.json", '[{"instruction":"a","output":"b"},{"messages":[]}]')
    texts = [r.text for r in R.read_instructions(spark, p).collect()]
    assert texts[0] == "### Instruction:\na\n\n### Response:\nb" and len(texts) == 2
    q = put(f"{folder}/c.jsonl", '{"messages":[{"role":"user","content":"hi"}]}\n{"messages":[]}\n')
    assert [r.text for r in R.read_instructions(spark, q, "chat").collect()] == ["<s>user: hi</s>"]
    with pytest.raises(ValueError):
        R.read_instructions(spark, q, "other")


def test_packed_and_meta(spark, folder):
    with pytest.raises(ValueError):
        R.read_packed(spark, f"{folder}/none")
    d = spark.createDataFrame([(i, [i, i]) for i in range(25)], "seq_id bigint, input_ids array<int>")
    W.write_shards(d.repartition(7), f"{folder}/p", 10)
    sizes = d.sparkSession.read.parquet(f"{folder}/p").groupBy(F.col("_metadata.file_name")).count().collect()
    assert sorted(r["count"] for r in sizes) == [5, 10, 10]
    put(f"{folder}/p/broken.parquet", "broken")
    assert R.read_packed(spark, f"{folder}/p").count() == 25
    put(f"{folder}/q.meta/part", "encoding=x\n")
    assert tuple(W.read_meta(spark, f"{folder}/q").first()) == ("x", 200000, 2048)
    W.write_meta(spark, f"{folder}/r", "words", 10, 8)
    assert tuple(W.read_meta(spark, f"{folder}/r").first()) == ("words", 10, 8)


def test_corpus_and_heads(spark, folder):
    rows = [(2, "b\r\nb", None), (1, "", "c"), (0, "a", "x"), (3, None, None), (4, " ", "")]
    d = spark.createDataFrame(rows, "k bigint, text string, content string")
    W.write_corpus(d, f"{folder}/c", "k", content="content")
    back = "".join(open(f"{folder}/c/{f}", newline="").read() for f in sorted(os.listdir(f"{folder}/c")) if f.startswith("part"))
    assert back == "a\n\nc\n\nb\nb\n\n \n\n"
    assert [r.k for r in R.head_nonblank(d, 2, "k").collect()] == [0, 2]
    assert [r.k for r in R.head_nonblank(d, 2, "k", cut_first=True).collect()] == [0]


def test_shared_folder_comes_from_the_session(spark, folder):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    d = materialize(spark.range(5).withColumn("x", F.array("id")))
    assert d.count() == 5 and d.inputFiles()[0].split("://")[-1].lstrip("/").startswith(shared_dir(spark).lstrip("/"))


def test_streams_equal_batches(spark, folder):
    rows = [(i, f"w{i % 5} x\ny" if i % 4 else "same text", "ab"[i % 3 == 0]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, src string")
    d.repartition(6, "doc_id").write.parquet(f"{folder}/in")
    stream = lambda: S.read_stream(spark, f"{folder}/in", "doc_id bigint, text string, src string", max_files=2)
    v = K.Vocab(K.build_vocab(K.word_counts(d), 100))
    ids = {r.doc_id: r.ids for r in K.encode_lines(d, v).collect()}

    S.run_to_files(K.encode_lines(stream(), v).select("doc_id", "ids"), f"{folder}/enc", f"{folder}/enc-c")
    assert {r.doc_id: r.ids for r in spark.read.parquet(f"{folder}/enc").collect()} == ids

    lanes = S.with_lanes(K.encode_lines(stream(), v), "doc_id", 3, "src").select("lane", "doc_id", "ids")
    S.run_to_files(S.pack_stream(lanes, 16, "doc_id"), f"{folder}/pk", f"{folder}/pk-c")
    batch = S.with_lanes(d, "doc_id", 3, "src").collect()
    tokens = {}
    for r in batch:
        tokens[r.lane] = tokens.get(r.lane, 0) + len(ids[r.doc_id])
    got = {r.lane: r["count"] for r in spark.read.parquet(f"{folder}/pk").groupBy("lane").count().collect()}
    assert got == {k: n // 16 for k, n in tokens.items() if n >= 16}
    seqs = spark.read.parquet(f"{folder}/pk").orderBy("lane", "seq_id").collect()
    assert all(len(r.input_ids) == 16 for r in seqs)

    S.run_to_files(S.dedup_stream(stream(), "text"), f"{folder}/dd", f"{folder}/dd-c")
    assert spark.read.parquet(f"{folder}/dd").count() == d.select("text").distinct().count()

    S.head_split_stream(stream(), f"{folder}/hs", f"{folder}/hs-c", 120, 0.05, "doc_id")
    n = {r.split: r["count"] for r in spark.read.parquet(f"{folder}/hs/rows").groupBy("split").count().collect()}
    assert n == {"validation": 6, "train": 114}


def _cut_in_half(path):
    with open(path, "rb+") as f:
        f.truncate(os.path.getsize(path) // 2)


def test_a_damaged_shard_is_named_and_strict_raises(spark, folder):
    spark.range(1000).selectExpr("array(id, id + 1) AS input_ids").repartition(4).write.parquet(f"{folder}/pk")
    bad = sorted(glob.glob(f"{folder}/pk/*.parquet"))[1]
    _cut_in_half(bad)
    with pytest.warns(UserWarning, match=os.path.basename(bad)):
        got = R.read_packed(spark, f"{folder}/pk").count()
    assert 0 < got < 1000
    with pytest.raises(ValueError, match=os.path.basename(bad)):
        R.read_packed(spark, f"{folder}/pk", strict=True)
    assert [os.path.basename(r.path) for r in R.skipped_files(spark, f"{folder}/pk").collect()] == [os.path.basename(bad)]


def test_mixed_schemas_below_one_folder_and_non_text_columns(spark, folder):
    spark.createDataFrame([(" one ",)], "text string").write.parquet(f"{folder}/m/a")
    spark.createDataFrame([(7, "two")], "n int, Content string").write.parquet(f"{folder}/m/b")
    spark.createDataFrame([(7,)], "text int").write.parquet(f"{folder}/m/c")
    with pytest.warns(UserWarning, match="not text"):
        d = R.read_parquet_text(spark, f"{folder}/m", mixed=True)
    assert sorted(r.text for r in d.collect()) == ["one", "two"]


def test_path_exists_asks_the_file_system(spark, folder):
    assert R.path_exists(spark, folder) and not R.path_exists(spark, f"{folder}/none")

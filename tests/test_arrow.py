"""Arrow files: splits, pruned columns, damaged files and batches."""

import os

import pyarrow as pa
import pytest

from corpusflow.sources import arrow_files as A
from corpusflow.sources import readers as R


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def docs(spark, n=500):
    return spark.createDataFrame([(i, f"text {i}" if i % 7 else None, [i, i + 1], "x") for i in range(n)],
                                 "doc_id bigint, text string, ids array<bigint>, lang string")


@pytest.mark.parametrize("stream", [False, True])
def test_every_batch_is_a_split(spark, folder, stream):
    d = docs(spark)
    A.write_arrow(d.coalesce(2), f"{folder}/a", rows=40, stream=stream)
    plan = A.plan(spark, folder).collect()
    assert len(plan) >= 13 and {r["kind"] for r in plan} == {"stream" if stream else "file"} and not any(r["error"] for r in plan)
    assert rows_of(A.read_arrow(spark, folder)) == rows_of(d)
    many = A.read_arrow(spark, folder, "ids array<int>, doc_id bigint, other double", split_bytes=1000)
    assert many.rdd.getNumPartitions() >= 4
    assert rows_of(many) == rows_of(d.selectExpr("cast(ids as array<int>)", "doc_id", "cast(null as double)"))


def test_a_truncated_file_is_named(spark, folder):
    A.write_arrow(docs(spark, 100).coalesce(1), f"{folder}/good", rows=10)
    A.write_arrow(docs(spark, 100).coalesce(1), f"{folder}/bad", rows=10)
    bad = next(f"{folder}/bad/{f}" for f in os.listdir(f"{folder}/bad") if f.endswith(".arrow"))
    os.truncate(bad, os.path.getsize(bad) // 2)
    with pytest.warns(UserWarning, match=bad):
        assert A.read_arrow(spark, folder).count() == 100
    with pytest.raises(ValueError, match=bad):
        A.read_arrow(spark, folder, strict=True)
    (r,) = A.damaged_batches(spark, folder).collect()
    assert r["path"].endswith(bad) and r["batch"] is None


def test_a_damaged_batch_is_named_and_the_others_are_read(spark, folder):
    A.write_arrow(docs(spark, 100).coalesce(1), f"{folder}/a", rows=10)
    path = next(f"{folder}/a/{f}" for f in os.listdir(f"{folder}/a") if f.endswith(".arrow"))
    with open(path, "rb") as f:
        whole = f.read()
    at = whole.index(b"text 31text 32")  # batch 3: its text becomes bytes that are no UTF-8
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\xff\xfe\xff")
    got = A.read_arrow(spark, path, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(100) if not 30 <= i < 40]
    (r,) = A.damaged_batches(spark, path).collect()
    assert r["batch"] == 3 and r["error"]
    # the other columns of that batch are sound
    assert A.read_arrow(spark, path, "doc_id bigint").count() == 100
    with pytest.raises(Exception, match="record batch 3"):
        A.read_arrow(spark, path, "text string", strict=True).collect()


def test_streams_with_dictionaries_are_read_whole(spark, folder):
    t = pa.table({"lang": pa.array(["de", "en", "de"] * 20).dictionary_encode(), "n": pa.array(range(60))})
    with pa.ipc.new_stream(f"{folder}/d.arrow", t.schema) as w:
        w.write_table(t, max_chunksize=7)
    got = A.read_arrow(spark, folder, "lang string, n bigint")
    assert sorted((r["n"], r["lang"]) for r in got.collect()) == list(enumerate(["de", "en", "de"] * 20))


def test_empty_and_missing(spark, folder):
    A.write_arrow(docs(spark, 5).limit(0).coalesce(1), f"{folder}/none")
    assert A.read_arrow(spark, f"{folder}/none").count() == 0
    assert A.read_arrow(spark, f"{folder}/none").columns == ["doc_id", "text", "ids", "lang"]
    with open(f"{folder}/junk.arrow", "wb") as f:
        f.write(b"no arrow at all")
    with pytest.warns(UserWarning, match="junk"), pytest.raises(ValueError, match="no readable"):
        A.read_arrow(spark, f"{folder}/junk.arrow")


def test_packed_arrow_is_a_packed_dataset(spark, folder):
    d = spark.createDataFrame([([1, 2, 3],), ([4, 5, 6],)], "input_ids array<bigint>")
    A.write_arrow(d, f"{folder}/p/data")
    assert rows_of(R.read_packed(spark, f"{folder}/p")) == [([1, 2, 3],), ([4, 5, 6],)]
    with pytest.raises(ValueError):
        R.read_packed(spark, f"{folder}/nothing")

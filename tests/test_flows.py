"""The corpus build on other layouts and with and without a cap."""

from collections import Counter

import pytest

from pyspark.sql import functions as F

from corpusflow.operators import flows


def _built(spark, folder, name, rows, files, cap):
    d = spark.createDataFrame(rows, "text string").repartition(files, F.xxhash64("text", F.rand(files)))
    d.write.parquet(f"{folder}/{name}/wiki")
    m = flows.build_corpus(spark, [f"{folder}/{name}"], f"{folder}/{name}-out", cap).collect()
    back = spark.read.parquet(f"{folder}/{name}-out").collect()
    assert sum(r["n"] for r in m) == len(back)
    return Counter((r["bucket"], r["text"]) for r in back)


def test_a_cap_keeps_the_same_rows_on_any_layout(spark, folder):
    rows = [(f"text {i}",) for i in range(60)] + [(f"copied {i % 6}",) for i in range(240)] + [(" ",)]
    got = [_built(spark, folder, f"x{files}", rows, files, 40) for files in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == 40


def test_no_cap_keeps_every_row(spark, folder):
    rows = [(f"text {i % 90}",) for i in range(400)] + [("",), (None,)]
    assert _built(spark, folder, "y", rows, 3, 0) == Counter(("wikipedia", t) for t, in rows if t)


def test_copies_are_numbered_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(flows, "COPIES", 3)
    d = spark.createDataFrame([("b", "x")] * 8 + [("b", "y")] * 3 + [("c", "x")], "bucket string, text string")
    got = sorted(tuple(r) for r in flows._numbered(d).collect())
    assert got == [("b", "x", i) for i in range(8)] + [("b", "y", i) for i in range(3)] + [("c", "x", 0)]


def test_every_readable_file_arrives_and_every_other_is_named(spark, folder):
    root = f"{folder}/in"
    spark.createDataFrame([(f"t{i}",) for i in range(5)], "text string").coalesce(1).write.parquet(f"{root}/wiki")
    spark.createDataFrame([(i, f"c{i}") for i in range(7)], "id int, Content string").coalesce(1).write.parquet(f"{root}/wiki/more")
    spark.createDataFrame([(1,)], "id int").coalesce(1).write.parquet(f"{root}/wiki/none")
    spark.createDataFrame([("line one",), (" ",), ("line two",)], "value string").coalesce(1).write.text(f"{root}/books")
    with open(f"{root}/wiki/broken.parquet", "wb") as f:
        f.write(b"PAR1 no such thing PAR1")
    with open(f"{root}/raw.arrow", "wb") as f:
        f.write(b"x")
    with pytest.warns(UserWarning) as said:
        m = flows.build_corpus(spark, [root], f"{folder}/out", 0).collect()
    said = " ".join(str(w.message) for w in said)
    assert "broken.parquet" in said and "raw.arrow" in said and "wiki/none" in said
    assert {r["source"]: r["n"] for r in m} == {"wikipedia": 12, "books": 2}
    back = spark.read.parquet(f"{folder}/out")
    assert {r["text"] for r in back.collect()} == {f"t{i}" for i in range(5)} | {f"c{i}" for i in range(7)} | {"line one", "line two"}
    assert sorted(r["doc_no"] for r in back.where("bucket = 'wikipedia'").collect()) == list(range(12))
    with pytest.raises(ValueError, match="raw.arrow"):
        flows.build_corpus(spark, [root], f"{folder}/strict", 0, strict=True)


def test_the_manifest_of_a_build_is_a_mixture(spark, folder):
    rows = [(f"text number {i}",) for i in range(30)]
    for name in ("wiki", "books", "other"):
        spark.createDataFrame(rows, "text string").write.parquet(f"{folder}/in/{name}")
    m = flows.build_corpus(spark, [f"{folder}/in"], f"{folder}/out", 10)
    assert {(r["source"], r["weight"], r["n"]) for r in m.collect()} == {("wikipedia", 0.1, 10), ("books", 0.1, 10), ("misc", None, 10)}
    d, spec = flows.read_mixture(spark, f"{folder}/out.manifest", "doc_no")
    assert {r["source"] for r in spec.collect()} == {"wikipedia", "books"}
    assert Counter(r["source"] for r in d.collect()) == {"wikipedia": 10, "books": 10}

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import checks as X
from corpusflow.functions import text as T


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("v")).first()["v"]


def many(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_strip_is_python_strip(spark):
    cps = [c for c in list(range(1, 0x300)) + list(range(0x1600, 0x3100)) + [0xfeff]]
    texts = [chr(c) + "a" + chr(c) for c in cps]
    assert many(spark, texts, T.strip) == [t.strip() for t in texts]
    assert many(spark, texts, T.lstrip) == [t.lstrip() for t in texts]
    assert many(spark, texts, T.rstrip) == [t.rstrip() for t in texts]


def test_words_are_python_split(spark):
    texts = [f"x{chr(c)}y {chr(c)} z" for c in range(1, 0x300)] + ["", "  ", "a", "日本 語😀 x\u3000y"]
    assert many(spark, texts, T.words) == [t.split() for t in texts]


def test_split_lines_like_python(spark):
    texts = ["a\r\nb\rc\nd", "x\x0by\x0cz", "p\u2028q\u2029r\x85s", "a\x1cb\x1dc\x1ed"]
    assert many(spark, texts, T.split_lines) == [t.splitlines() for t in texts]


@pytest.mark.parametrize("path,bucket", [
    ("/x/facebook/code.txt", "books"), ("/x/openwebmath/wiki", "math"), ("/x/the-stack/wiki", "code"),
    ("/x/other", "misc"), ("/X/FineWeb/book", "fineweb"), ("/a/wikipedia", "wikipedia")])
def test_bucket(spark, path, bucket):
    assert one(spark, T.classify_bucket("s"), s=path) == bucket


def test_ascii_ratio(spark):
    texts = ["", "abc", "\nabc", "é" * 10, "a" * 200 + "é" * 50, "😀a"]
    want = [sum(32 <= ord(c) < 127 for c in t[:200]) / len(t[:200]) if t else 0.0 for t in texts]
    assert many(spark, texts, T.ascii_ratio) == pytest.approx(want)


def test_cuts(spark):
    assert one(spark, T.cut_at_stop("s"), s=" a \nUser: b \nUser: c") == "a"
    assert one(spark, T.cut_at_stop("s"), s=" a ") == "a"
    assert one(spark, T.after_mark("s"), s="x Assistant:\ny Assistant:\nz") == "y Assistant:\nz"
    assert one(spark, T.after_mark("s"), s="plain") == "plain"
    assert one(spark, T.boxed("s"), s=r"a \boxed{} b") == ""
    assert one(spark, T.boxed("s"), s="\\boxed{a\nb} \\boxed{c}") == "c"
    assert one(spark, T.boxed("s"), s="\\boxed{a\u2028b}") == "a\u2028b"
    assert one(spark, T.hash_answer("s"), s="a ####\u00a0-12 b") == "-12"
    assert one(spark, T.hash_answer("s"), s="nothing") is None
    assert one(spark, T.leading_newline("s"), s="  a") == "\na"
    assert one(spark, T.leading_newline("s", relstrip=False), s="  a") == "\n  a"
    assert one(spark, T.truncate_user("s", 4), s="abc def") == "abc"
    assert one(spark, T.first_filled("a", "b"), a="", b=None) == ""


@pytest.mark.parametrize("text,ok", [
    ('{"answer": 1, "steps": null}', True), ('Sure: {"answer": 1, "steps": []}', True),
    ('{"answer": 1, "steps": 2} done', False), ('{"answer": 1}', False), ("", False), ("[1, 2]", False),
    ('["answer", "steps"]', True), ('"answer and steps"', True), ("12", False), ("null", False),
    (' {"answer": 1, "steps": 2} \n', True), ('{"a": {"answer": 1, "steps": 2}}', False)])
def test_json_keys(spark, text, ok):
    assert one(spark, X.json_has_keys("s"), s=text) is ok


def test_checks(spark):
    n = lambda s: one(spark, X.count_bullets("s"), s=s)
    assert n("- a\n • b\n* c") == 3
    assert n("-a\n-\n- b") == 1
    assert one(spark, X.full_match("s"), s=" abc12@example.com\n") is True
    assert one(spark, X.full_match("s"), s="abc12@example.com\nx") is False
    w = lambda s: one(spark, X.word_limit("s"), s=s)
    assert w(" ".join(["w"] * 40)) and not w(" ".join(["w"] * 41))
    assert not w("") and not w("- a") and w("a -b")
    assert one(spark, X.contains_all("s"), s="def is_palindrome(s): return 1") is True


def test_rewards(spark):
    r = lambda s, t: one(spark, X.boxed_reward("s", "t"), s=s, t=t)
    assert r(r"...Calculating the answer. \boxed{72}", "72") == 1.0
    assert r(r"...Calculating the answer \boxed{71}", "72") == 0.0
    assert r("no box", "72") == 0.0 and r("no box", None) == 0.0
    with pytest.raises(ValueError):
        X.reward("unknown")


def test_preference_and_clean_filters(spark):
    v = lambda p, a, b: one(spark, T.valid_preference("p", "a", "b"), p=p, a=a, b=b)
    assert v("x", "123456789", "987654321") and not v("x", "12345678", "987654321")
    assert not v("", "123456789", "987654321") and not v("x", " 123456789", "123456789 ")
    assert not v(None, "123456789", "987654321")
    c = lambda p, a: one(spark, T.clean_pair("p", "a"), p=p, a=a)
    assert c("", "\n" + "a" * 16) and not c("", "\n" + "a" * 15)
    assert c("p", "a" * 3999) and not c("pp", "a" * 3999)
    assert not c("p", "é" * 40) and not c("p", None)

"""Formats on edge records, and rolling prompts of long conversations."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import chat as C
from corpusflow.operators import conversations as V

MSGS = "array<struct<role:string,content:string>>"


def run(spark, msgs, col):
    d = spark.createDataFrame([(msgs,)], f"messages {MSGS}")
    v = d.select(col.alias("v")).first().v
    return tuple(v) if hasattr(v, "_fields") else v


def test_missing_sides(spark):
    u, a, s = ("user", " hi "), ("assistant", " yo\n"), ("system", "sys")
    assert run(spark, [s, u, a], C.first_exchange_pair()) == ("hi", "yo")
    assert run(spark, [a, u], C.first_exchange_pair()) == ("hi", "yo")
    assert run(spark, [u], C.first_exchange_pair()) == ("hi", "")
    assert run(spark, [a], C.first_exchange_pair()) == ("", "yo")
    assert run(spark, [], C.first_exchange_pair()) == ("", "")
    assert run(spark, None, C.first_exchange_pair()) == ("", "")
    assert run(spark, [("user", None)], C.first_exchange_pair()) == ("", "")
    assert run(spark, [u, a], C.first_two_pair()) == ("hi", "yo")
    assert run(spark, [a], C.first_two_pair()) == ("yo", "")
    assert run(spark, [], C.first_two_pair()) == ("", "")
    assert run(spark, [u], C.chat_pair()) == ("User: hi\nAssistant:\n", "\n")
    assert run(spark, [u], C.chat_pair_or_empty()) == ("User: hi\nAssistant:\n", "")
    assert run(spark, [a], C.chat_pair()) == ("User:\nAssistant:\n", "\nyo")
    assert run(spark, None, C.chat_pair_or_empty()) == ("User:\nAssistant:\n", "")
    assert run(spark, [s, u, a], C.dialog_text()) == "system: sys<s>user: hi</s>assistant: yo</s>"
    assert run(spark, [(None, "x")], C.dialog_text()) == "<s>user: x</s>"
    assert run(spark, None, C.dialog_text()) == ""
    assert run(spark, [s, u, a], C.rendered_chat()) == "System: sys\nUser:  hi \nAssistant:  yo\n <|endoftext|>"


def test_instructions(spark):
    d = spark.createDataFrame([(" do ", " with ", None, " done ")],
                              "instruction string, input string, output string, response string")
    p = d.select(C.instruction_pair().alias("p")).first().p
    assert p.prompt == "### Instruction:\ndo\n\n### Input:\nwith\n\n### Response:\n" and p.completion == "done"
    assert d.select(C.instruction_text().alias("t")).first().t == p.prompt
    d2 = d.withColumn("input", F.lit(" "))
    assert d2.select(C.instruction_text().alias("t")).first().t == "### Instruction:\ndo\n\n### Response:\n"
    q = d.withColumn("prompt", F.lit("p")).select(C.instruction_or_prompt_pair().alias("p")).first().p
    assert tuple(q) == ("User: do\nAssistant:\n", "\ndone")


def test_preference_blocks(spark):
    schema = f"prompt string, ct string, cm {MSGS}, rt string, rm {MSGS}"
    rows = [("p", " good answer", None, "\nbad", None),
            ("p", None, [("prompter", " ask "), ("assistant", "yes")], None, [("user", "other"), ("assistant", "")]),
            (" p ", None, [], None, None)]
    d = spark.createDataFrame(rows, schema)
    got = [tuple(r.t) for r in d.select(C.preference_triple("ct", "cm", "rt", "rm").alias("t")).collect()]
    assert got == [("User: p\nAssistant:\n", "\ngood answer", "\nbad"),
                   ("User: ask\nAssistant:\n", "\nyes", ""),
                   ("User: p\nAssistant:\n", "", "")]
    t = d.select(C.preference_triple("ct", "cm", "rt", "rm", max_user_len=2).alias("t")).collect()[1].t
    assert t.prompt == "User: as\nAssistant:\n"


def test_registry(spark):
    with pytest.raises(ValueError):
        C.formatter("nope")
    C.register_formatter("shout", lambda t="text": F.upper(t))
    d = spark.createDataFrame([("a",)], "text string")
    assert d.select(C.formatter("shout")().alias("x")).first().x == "A"


def build_prompt(history, n):
    def turn(u, a):
        t = f"User: {u}\nAssistant:\n"
        return t if a is None else t + a.strip() + "\n"
    return "".join(turn(u, a) for u, a in history[-n:])


def plain_rolling(turns, n):
    history, out = [], {}
    for i, (role, text) in enumerate(turns):
        if role == "user":
            out[i] = build_prompt([*history, (text, None)], n)
            reply = turns[i + 1][1] if i + 1 < len(turns) and turns[i + 1][0] == "assistant" else None
            history.append((text, reply))
    return out


@pytest.mark.parametrize("chunk", [8, 16, 1024])
def test_rolling_prompts_across_chunks(spark, chunk):
    # one long conversation holds most rows; some turns are unanswered or doubled
    def talk(n, skip):
        turns = [("system", "s")]
        for i in range(n):
            turns.append(("user", f"q{i}"))
            if i % skip:
                turns.append(("assistant", f" a{i} "))
            if i % 7 == 3:
                turns.append(("assistant", "again"))
        return turns
    talks = {1: talk(60, 4), 2: talk(3, 2), 3: [("assistant", "x")], 4: [("user", "only")]}
    rows = [(c, t * 3, r, x) for c, ts in talks.items() for t, (r, x) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {(r.conv_id, r.turn // 3): r.prompt for r in
           V.rolling_prompts(V.exchanges(df, chunk=chunk), 8, chunk=chunk).collect()}
    want = {(c, i): p for c, ts in talks.items() for i, p in plain_rolling(ts, 8).items()}
    assert got == want


def test_dialog_prompt_of_a_record(spark):
    schema = "h array<struct<user:string,assistant:string>>"
    hist = [[("q", None)], [("q", "a")], [("q", "Assistant:")], [], None, [(f"q{i}", f"a{i}") for i in range(12)]]
    d = spark.createDataFrame([(h,) for h in hist], schema)
    got = [r.p for r in d.select(V.dialog_prompt("h").alias("p")).collect()]
    for h, p in zip(hist, got):
        body = build_prompt(h or [], 8)
        assert p == (body if body.endswith("Assistant:\n") else body + "User: \nAssistant:\n")


def test_first_and_last_messages(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "tool", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pick = lambda **k: {r.conv_id: [tuple(m) for m in r.messages] for r in V.first_messages(df, **k).collect()}
    assert pick() == {1: [("user", "a"), ("assistant", "b")], 2: []}
    assert pick(roles=("user",), last=True) == {1: [("user", "c")], 2: []}
    lead = {r.conv_id: len(r.messages) for r in V.leading_messages(df, 2).collect()}
    assert lead == {1: 2, 2: 1}

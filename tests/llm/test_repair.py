"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpusflow.llm import repair
from corpusflow.llm.queries import ORACLE, QUERIES
from tests.oracle import connect, difference

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def search(rows):
    """Cheapest edits by Dijkstra on (place, repaired roles so far are a prefix), least audit among the cheapest."""
    def fits(prefix):
        return re.match(r"(s?(ua)*u?)?\Z", prefix)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        state = (i, roles[-1:], roles == "")
        if i == len(rows) and SHAPE.match(roles):
            return cost, audit, "\n".join(out)
        if state in done:
            continue
        done.add(state)
        moves = [("I", 3, i, r, f"{n}:") for r, n in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text, fault = rows[i]
            moves.append(("D", 4, i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    moves.append(("K", more, i + 1, role[0], f"{role}:{text}"))
                moves += [("R", 3 + more, i + 1, r, f"{n}:{text}") for r, n in (("u", "user"), ("a", "assistant"))]
        for e, c, to, r, line in moves:
            if fits(roles + r):
                heapq.heappush(heap, (cost + c, audit + e, to, roles + r, out + ((line,) if line is not None else ())))


def expected(turns):
    """Report of each conversation from (conv_id, turn, role, text, n) rows."""
    out = []
    for conv in sorted({t[0] for t in turns}, key=str):
        rows = sorted((t for t in turns if t[0] == conv for _ in range(t[4])),
                      key=lambda t: (t[1] is not None, t[1] or 0, t[2], hashlib.md5(t[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text, _ in rows:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
                faults.append("truncated")
            else:
                faults.append("")
            seen.add((role, text))
        heads = [r[2][:1] for r in rows]
        nums = [r[1] for r in rows if r[1] is not None]
        cost, audit, text = search([(r[2], r[3], f) for r, f in zip(rows, faults)])
        out.append((str(conv), max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def report(df):
    return sorted((str(r["conv_id"]), *r[1:]) for r in df.collect())


def turns(seed, convs=40, longest=14):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for k in range(r.randrange(0, longest)):
            turn = None if r.random() < 0.05 else k + r.choice([0, 0, 0, 1, 5])
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", " ", "", "u", "Assistant"])
            text = r.choice(["Yes.", "No!", "So?", "cut off", "", " \t", "a. ", f"text {k}.", f"text {k}"])
            rows.append((c, turn, role, text, r.choice([1, 1, 1, 1, 2, 0])))
    return rows + [("gone", None, "", "", 0)][:0]


@pytest.mark.parametrize("rows_a_segment", [2, 5, 4096])
def test_reports_equal_a_full_search(spark, monkeypatch, rows_a_segment):
    monkeypatch.setattr(repair, "ROWS", rows_a_segment)
    rows = turns(rows_a_segment)
    assert report(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected(rows)


def test_long_conversations_across_tasks_equal_one_task(spark, monkeypatch):
    r = random.Random(9)
    rows = [(c, k, r.choice(["user", "assistant"]), r.choice(["One.", f"Text {k}.", "cut", ""]), 1) for c in (1, 2) for k in range(900)]
    whole = report(repair.repair(spark.createDataFrame(rows, SCHEMA)))
    monkeypatch.setattr(repair, "ROWS", 7)
    assert report(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(9))) == whole
    assert all(len(x[7]) >= 900 for x in whole)


def test_copies_are_counted_not_carried(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Same.", 50_000), (1, 2, "user", " ", 30_000)]
    (got,) = repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (got["duplicate"], got["blank"], got["truncated"], got["illegal"]) == (49_999, 30_000, 0, 49_999 + 29_999)
    assert got["cost"] == 4 * 79_999 and got["audit"] == "KK" + "D" * 79_999


def test_powers_equal_single_steps():
    m = repair.Machine()
    for sym in range(9):
        v = repair.END
        for n in range(1, 40):
            v = m.step(sym, v)
            assert m.apply(sym, n, repair.END) == v


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. B! c?") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(x["conv_id"], x["turn"] if x["n"] else -1): x for x in repair.damage(df).collect()}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = got[(c, t if k else -1)]
        role, text = role or " ", text or " "
        if k:
            want = ("user" if k == 4 else role, {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(k, text), 2 if k == 3 else 1)
            assert (x["role"], x["text"], x["n"]) == want


def test_a_conversation_without_rows_and_an_empty_table(spark):
    (got,) = repair.repair(spark.createDataFrame([(7, None, None, None, 0)], SCHEMA)).collect()
    assert tuple(got) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark, sf):
    name = "op12_conversation_repair"
    assert difference(spark, connect(sf), sf, QUERIES[name], ORACLE[name]) is None


def test_text_ids_and_further_columns(spark):
    rows = [("x", 0, "user", "Hi.", 1, 0, "z"), ("x", 1, "assistant", "Yes.", 1, 1, "z")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, n bigint, sid int, audit string")
    (got,) = repair.repair(df).collect()
    assert (got["conv_id"], got["cost"], got["audit"]) == ("x", 0, "KK")

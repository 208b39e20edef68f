"""Streams that keep order, shares and shard sizes across micro-batches."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import evaluation as E
from corpusflow.operators import tokens as K
from corpusflow.plans import QUERIES, io_queries
from corpusflow.plans.token_queries import SEQ, doc_vocab
from corpusflow.streaming import streams as S


def feed(lane, rows):
    for s, at, ids in rows:
        lane.add(s, at, np.array(ids, np.int32))
        lane.drain()


def test_shares_hold_on_every_prefix_whatever_the_arrival():
    probs = {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = [(s, k, [ord(s) * 1000 + k]) for s in probs for k in range(200)]
    orders = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        one = S.Lane(probs, 10_000)
        for at in range(0, len(rows), 50):  # state goes through its stored form between micro-batches
            feed(one, rows[at:at + 50])
            one = S.Lane(probs, 10_000, one.state())
        orders.append(np.concatenate(one.out).tolist())
    assert orders[0] == orders[1] == orders[2] and len(orders[0]) > 300
    for n in range(1, len(orders[0]) + 1):
        for s, p in probs.items():
            assert abs(sum(x // 1000 == ord(s) for x in orders[0][:n]) - n * p) <= 1
    for s in probs:
        mine = [x % 1000 for x in orders[0] if x // 1000 == ord(s)]
        assert mine == list(range(len(mine)))


def test_a_missing_document_is_passed_over_beyond_the_bound_and_packed_when_it_comes():
    one = S.Lane({"": 1.0}, 5)
    feed(one, [("", k, [k]) for k in range(1, 6)])
    assert one.out == [] and one.n == 5
    feed(one, [("", 6, [6])])
    assert np.concatenate(one.out).tolist() == [1, 2, 3, 4, 5, 6]
    feed(one, [("", 0, [0]), ("", 7, [7])])
    assert np.concatenate(one.out).tolist() == [1, 2, 3, 4, 5, 6, 0, 7] and one.n == 0


def test_a_dry_source_gives_way_beyond_the_bound():
    one = S.Lane({"a": 0.5, "b": 0.5}, 3)
    feed(one, [("a", k, [k]) for k in range(10)])
    assert np.concatenate(one.out).tolist() == list(range(7)) and one.n == 3
    with pytest.raises(ValueError):
        one.add("z", 0, np.zeros(1, np.int32))


def placed(spark, n=120, lanes=2):
    r = random.Random(3)
    rows = [(str(k % lanes), k // lanes, [k] * r.randrange(0, 9)) for k in range(n)]
    return spark.createDataFrame(rows, "lane string, place bigint, ids array<int>"), rows


def test_order_holds_over_files_in_any_order(spark, folder):
    d, rows = placed(spark)
    d.repartition(6, F.xxhash64("place", "lane")).write.parquet(f"{folder}/in")
    stream = S.read_stream(spark, f"{folder}/in", "lane string, place bigint, ids array<int>", max_files=1)
    S.run_to_files(S.pack_in_order(stream, 10), f"{folder}/out", f"{folder}/chk")
    got = {(r["lane"], r["seq_id"]): r["input_ids"] for r in spark.read.parquet(f"{folder}/out").collect()}
    for lane in ("0", "1"):
        flat = [x for s, _, ids in rows if s == lane for x in ids]
        assert [got[lane, k] for k in range(len(flat) // 10)] == [flat[k * 10:k * 10 + 10] for k in range(len(flat) // 10)]


def test_shards_are_exact_and_a_repeated_batch_writes_nothing_twice(spark, folder):
    d, rows = placed(spark, 300)
    parts = d.randomSplit([1.0] * 5, 7)
    schema = "lane string, place bigint, ids array<int>"

    def run():
        S.shards_to_files(S.pack_in_order(S.read_stream(spark, f"{folder}/in", schema, max_files=1), 10), f"{folder}/out", f"{folder}/chk", 7)
    for k, p in enumerate(parts):  # a restart after each arrival
        p.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run()
        if k == 2:  # as after a crash: the last batch was written, but not committed
            last = max(int(f.split("=")[1]) for f in os.listdir(f"{folder}/out/ledger") if "=" in f)
            os.remove(f"{folder}/chk/commits/{last}")
            crc = f"{folder}/chk/commits/.{last}.crc"
            if os.path.exists(crc):
                os.remove(crc)
            run()
    all_ = S.read_shards(spark, f"{folder}/out").collect()
    keys = [(r["lane"], r["seq_id"]) for r in all_]
    total = sum(sum(len(ids) for s, _, ids in rows if s == lane) // 10 for lane in ("0", "1"))
    assert len(keys) == len(set(keys)) == total
    files = spark.read.parquet(f"{folder}/out/shards").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert {r["count"] for r in files} == {7} and len(files) == total // 7


def test_quantiles_of_one_group_of_all_rows(spark):
    d = spark.range(200_000).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 100_003).cast("double").alias("v"))
    xs = np.array([(i * 7919) % 100_003 for i in range(200_000)], float)
    (r,) = E.exact_quantiles(d, "v", {"a": 0.001, "m": 0.5, "z": 0.95}, ["g"], 1000).collect()
    assert (r["a"], r["m"], r["z"]) == tuple(pytest.approx(np.quantile(xs, p), abs=1e-9) for p in (0.001, 0.5, 0.95))


def test_what_a_lane_holds_is_stored_as_bytes():
    one = S.Lane({"a": 1.0}, 10_000)
    rows = [("a", k, list(range(k % 7))) for k in range(1, 3000)]  # place 0 has not come
    feed(one, rows)
    tokens = sum(len(ids) for _, _, ids in rows)
    state = one.state()
    assert sum(isinstance(x, bytes) for x in state) == 5 and sum(len(x) for x in state if isinstance(x, bytes)) == 4 * tokens + 20 * len(rows)
    again = S.Lane({"a": 1.0}, 10_000, state)
    feed(again, [("a", 0, [9])])
    assert np.concatenate(again.out).tolist() == [9] + [x for _, _, ids in rows for x in ids]


def arrivals(probs, n, seed):
    """Micro-batches of chunks: documents in any order, some late, some twice."""
    r = random.Random(seed)
    rows = [(s, k, [r.randrange(99) for _ in range(r.randrange(0, 12))]) for s in probs for k in range(n)]
    r.shuffle(rows)
    rows += r.sample(rows, 20)
    return [[rows[k:k + 40] for k in range(at, at + 200, 40)] for at in range(0, len(rows), 200)]


@pytest.mark.parametrize("hold", [10_000, 150])
def test_a_lane_with_files_gives_what_one_in_memory_gives(folder, monkeypatch, hold):
    monkeypatch.setattr(S, "HELD_BYTES", 4_000)
    monkeypatch.setattr(S, "STATE_BYTES", 1_000)
    monkeypatch.setattr(S, "READ_TOKENS", 64)
    probs = {"a": 0.6, "b": 0.3, "c": 0.1}
    state, filed, most = None, None, 0
    for batch in arrivals(probs, 400, hold):
        plain, one = S.Lane(probs, hold, state), S.Lane(probs, hold, filed, folder)
        for chunk in batch:
            for lane in (plain, one):
                for s, at, ids in chunk:
                    lane.add(s, at, np.array(ids, np.int32))
            plain.drain()
            want, got, more = plain.sequences(8).tolist(), [], True
            while more:
                more = one.drain(50)
                got += one.sequences(8).tolist()
            assert got == want and one.next_seq == plain.next_seq and one.n == plain.n
            one.file_away(S.HELD_BYTES)
            assert one.n_bytes <= S.HELD_BYTES
        state, filed = plain.state(), one.state()
        most = max(most, sum(len(x) for x in state if isinstance(x, bytes)))
        assert sum(len(x) for x in filed if isinstance(x, bytes)) <= S.STATE_BYTES
    assert most > 4 * S.STATE_BYTES or hold < 1000


def test_files_of_a_lane_outlive_a_repeated_batch_and_go_in_the_next(folder, monkeypatch):
    monkeypatch.setattr(S, "STATE_BYTES", 0)

    def batch(state, rows):
        one = S.Lane({"": 1.0}, 10_000, state, folder)
        feed(one, rows)
        return one.sequences(2).tolist(), one.state()
    _, first = batch(None, [("", k, [k]) for k in range(1, 8)])
    assert len(os.listdir(folder)) == 1 and not first[7]
    want, again = batch(first, [("", 0, [0])])
    assert want == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert batch(first, [("", 0, [0])]) == (want, again) and len(os.listdir(folder)) == 1
    assert batch(again, [("", k, [k]) for k in (8, 9)])[0] == [[8, 9]] and os.listdir(folder) == []


def test_a_stream_holds_documents_in_files_and_few_state_partitions(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "STATE_BYTES", 100)
    d, rows = placed(spark, 400)
    d.repartition(6, F.xxhash64("place", "lane")).write.parquet(f"{folder}/in")
    stream = S.read_stream(spark, f"{folder}/in", "lane string, place bigint, ids array<int>", max_files=1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    S.run_to_files(S.pack_in_order(stream, 10, folder=f"{folder}/held"), f"{folder}/out", f"{folder}/chk", lanes=3)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sum(x.isdigit() for x in os.listdir(f"{folder}/chk/state/0")) == 6 and len(os.listdir(f"{folder}/held")) > 0
    got = {(r["lane"], r["seq_id"]): r["input_ids"] for r in spark.read.parquet(f"{folder}/out").collect()}
    for lane in ("0", "1"):
        flat = [x for s, _, ids in rows if s == lane for x in ids]
        assert [got[lane, k] for k in range(len(flat) // 10)] == [flat[k * 10:k * 10 + 10] for k in range(len(flat) // 10)]


def test_a_lane_of_more_documents_than_the_usual_bound_stays_in_order(spark, folder):
    n, lanes = 100_000, io_queries.LANES
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(x), F.col("id") % 50) for x in "abc"]).alias("text"),
                              F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    d.write.parquet(f"{folder}/documents.parquet")
    got = {(r["lane"], r["seq_id"]): r["input_ids"] for r in QUERIES["str3_stream_pack"](spark, folder).collect()}
    of = S.with_lanes(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id", lanes)
    ids = K.encode_lines(of, doc_vocab(spark, folder)).orderBy("doc_id").select("lane", "ids").toPandas()
    for lane, rows in ids.groupby("lane"):
        assert len(rows) > S.HOLD
        flat = np.concatenate(rows["ids"].tolist())
        want = [",".join(map(str, x)) for x in flat[:len(flat) // SEQ * SEQ].reshape(-1, SEQ)]
        assert [got[lane, k] for k in range(len(want))] == want


@pytest.mark.parametrize("name", ["str1_read_stream", "str3_stream_pack", "src6_read_arrow"])
def test_files_of_a_round_trip_grow_in_number_not_in_size(spark, folder, monkeypatch, name):
    monkeypatch.setattr(io_queries, "FILE_BYTES", 20_000)
    made = []
    monkeypatch.setattr(io_queries, "scratch_path", lambda s, x: made.append(f"{folder}/{x}-{len(made)}") or made[-1])
    text = "word " * 100
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id")).alias("text"), F.lit("en").alias("lang"),
                                 F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    d.write.parquet(f"{folder}/documents.parquet")
    assert QUERIES[name](spark, folder).count() > 0
    files = [f for _, _, names in os.walk(made[0]) for f in names if f.startswith("part-")]
    assert len(files) >= 2000 * len(text) // 20_000

"""Streaming forms: file source, in-flight encoding, rolling pack, dedup, sinks."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import row_index
from ..operators.mixing import content_hash
from ..session import scratch_path
from .held_files import READ_TOKENS, Part, read_held, remove_held, write_held

PACK_SCHEMA = "lane string, seq_id bigint, input_ids array<int>"
STATE_SCHEMA = "buf array<int>, next_seq bigint"


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                max_files: int = 100) -> DataFrame:
    """Files of a folder as a stream, at most ``max_files`` per trigger."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files).load(path))


def with_lanes(df: DataFrame, key: str, lanes: int, source: str | None = None) -> DataFrame:
    """Add ``lane``: rows of one source are spread over ``lanes`` independent packers,
    so a dominant source is not bound to one task."""
    n = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % lanes).cast("string")
    return df.withColumn("lane", F.concat_ws("/", source, n) if source else n)


def pack_stream(df: DataFrame, seq_len: int, order: str, ids: str = "ids", lane: str = "lane") -> DataFrame:
    """Full sequences per lane; fewer than ``seq_len`` tokens are carried as state.

    Works chunk by chunk as Arrow batches arrive, so a task holds one chunk and one partial
    sequence. Order holds inside a chunk only; ``pack_in_order`` keeps it across micro-batches.
    """
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buf, nxt = state.get if state.exists else ([], 0)
        buf = np.asarray(buf, np.int32)
        for pdf in chunks:
            pdf = pdf.sort_values(order)
            buf = np.concatenate([buf, *[np.asarray(x, np.int32) for x in pdf[ids]]])
            n = len(buf) // seq_len
            if n:
                seqs = buf[:n * seq_len].reshape(n, seq_len)
                yield pd.DataFrame({"lane": key[0], "seq_id": range(nxt, nxt + n), "input_ids": list(seqs)})
                buf, nxt = buf[n * seq_len:], nxt + n
        state.update((buf.tolist(), nxt))

    return (df.select(F.col(lane).alias("lane"), order, ids).groupBy("lane")
            .applyInPandasWithState(step, PACK_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))


# numbers of documents and tokens are bytes: as arrays every one of them would become an object on its way to the state and back
LIVE_STATE = ("names array<string>, place array<bigint>, given array<bigint>, held_of binary, held_at binary, "
              "held_size binary, held_ids binary, buf binary, next_seq bigint, files array<string>, spent array<string>")
HOLD = 10_000  # documents a lane holds back for one that has not come
HELD_BYTES = 32 << 20  # of documents held back that a task keeps in memory
STATE_BYTES = 1 << 20  # of them that go to the state, from one micro-batch to the next
OUT_TOKENS = 1 << 20   # given at once
DOC_BYTES = 300        # that a document in memory takes beside its tokens, about


class Lane:
    """What one lane remembers: per source the next place and the documents given, documents held back, and tokens left over.

    With a ``folder``, documents held back beyond ``HELD_BYTES`` go to files there, and the state names the files. A file whose
    documents were all given is still needed if that micro-batch is repeated, so it is deleted in the next one.
    """

    def __init__(self, probs: dict[str, float], hold: int, state: tuple | None = None, folder: str | None = None):
        self.probs, self.hold, self.folder = probs, hold, folder
        self.place, self.given = dict.fromkeys(probs, 0), dict.fromkeys(probs, 0)
        self.held: dict[str, dict[int, np.ndarray]] = {s: {} for s in probs}  # in memory
        self.parts: list[Part] = []                                      # in files
        self.files: list[str] = []
        self.new: set[str] = set()
        self.filed: dict[str, np.ndarray] = {}                                # places in files, in order
        self.due: dict[str, list[tuple[int, int]]] = {s: [] for s in probs}   # heaps of places, each with its part or -1
        self.n, self.n_bytes, self.out, self.next_seq = 0, 0, [], 0
        if state is None:
            return
        names, place, given, held_of, held_at, held_size, held_ids, buf, self.next_seq, files, spent = state
        self.place.update(zip(names, place))
        self.given.update(zip(names, given))
        size = np.frombuffer(held_size, np.int64)
        ends = np.cumsum(size)
        flat = np.frombuffer(held_ids, np.int32)
        for of, at, first, end in zip(np.frombuffer(held_of, np.int32).tolist(), np.frombuffer(held_at, np.int64).tolist(),
                                      (ends - size).tolist(), ends.tolist()):
            self._keep(names[of], at, flat[first:end])
        self.out.append(np.frombuffer(buf, np.int32))
        for path in spent:
            remove_held(path)
        for path in files:
            self._open(path)
        self.n += sum(map(len, self.parts))

    def _keep(self, source: str, place: int, ids: np.ndarray) -> None:
        self.held.setdefault(source, {})[place] = ids
        heapq.heappush(self.due.setdefault(source, []), (place, -1))
        self.n, self.n_bytes = self.n + 1, self.n_bytes + ids.nbytes + DOC_BYTES

    def _open(self, path: str) -> None:
        self.files.append(path)
        for s, part in read_held(path, self.place).items():
            if len(part):
                heapq.heappush(self.due.setdefault(s, []), (part.place(), len(self.parts)))
                self.parts.append(part)
                self.filed[s] = np.sort(np.concatenate([self.filed.get(s, part.at[:0]), part.at]), kind="stable")

    def file_away(self, most: int) -> None:
        """Documents in memory go to a file if they take more than ``most`` bytes."""
        if self.folder is None or self.n_bytes <= most:
            return
        path = write_held(self.folder, ((s, at, ids) for s, docs in self.held.items() for at, ids in sorted(docs.items())))
        self.n_bytes = 0
        for s in self.held:
            self.held[s] = {}
            self.due[s] = [x for x in self.due[s] if x[1] >= 0]
            heapq.heapify(self.due[s])
        self.new.add(path)
        self._open(path)

    def state(self) -> tuple:
        self.file_away(STATE_BYTES)
        left = {part.path for part in self.parts if len(part)}
        spent = [path for path in self.files if path not in left]
        for path in self.new.intersection(spent):  # no state has named it
            remove_held(path)
        names = list(self.place)
        rows = [(i, at, ids) for i, s in enumerate(names) for at, ids in sorted(self.held.get(s, {}).items())]
        none = np.zeros(0, np.int32)
        return (names, [self.place[s] for s in names], [self.given[s] for s in names], np.array([i for i, _, _ in rows], np.int32).tobytes(),
                np.array([at for _, at, _ in rows], np.int64).tobytes(), np.array([len(x) for _, _, x in rows], np.int64).tobytes(),
                np.concatenate([none, *[x for _, _, x in rows]]).tobytes(), np.concatenate([none, *self.out]).tobytes(), self.next_seq,
                [path for path in self.files if path in left], [path for path in spent if path not in self.new])

    def _is_filed(self, source: str, place: int) -> bool:
        at = self.filed.get(source, ())
        k = bisect.bisect_left(at, place)
        return k < len(at) and at[k] == place

    def add(self, source: str, place: int, ids: np.ndarray) -> None:
        if source not in self.probs:
            raise ValueError(f"source {source!r} has no weight")
        ids = np.array(ids, np.int32)  # a copy: the part of a chunk would keep the whole of it
        if place < self.place[source] or place in self.held[source] or self._is_filed(source, place):  # its turn is over: it goes out now
            self.out.append(ids)
            return
        self._keep(source, place, ids)

    def _turn(self, sources) -> str:
        return min(sources, key=lambda s: ((self.given[s] + 0.5) / self.probs[s], s))

    def _take(self, source: str) -> np.ndarray:
        """The held document of the lowest place."""
        place, k = heapq.heappop(self.due[source])
        if k < 0:
            ids = self.held[source].pop(place)
            self.n_bytes -= ids.nbytes + DOC_BYTES
            return ids
        ids = self.parts[k].take(READ_TOKENS // len(self.parts))
        if len(self.parts[k]):
            heapq.heappush(self.due[source], (self.parts[k].place(), k))
        return ids

    def drain(self, most: int | None = None) -> bool:
        """Give documents in turn while they are there; beyond ``hold`` one that has not come is passed over.

        True: it stopped as ``most`` tokens or more were given, and others may be due."""
        given = 0
        while self.n:
            if most is not None and given >= most:
                return True
            s = self._turn(self.probs)
            if not self.due[s] or self.due[s][0][0] != self.place[s]:
                if self.n <= self.hold:
                    return False
                if not self.due[s]:
                    s = self._turn([x for x in self.probs if self.due[x]])
                self.place[s] = self.due[s][0][0]
            self.out.append(self._take(s))
            given += len(self.out[-1])
            self.place[s] += 1
            self.given[s] += 1
            self.n -= 1
        return False

    def sequences(self, seq_len: int) -> np.ndarray:
        flat = np.concatenate([np.zeros(0, np.int32), *self.out])
        n = len(flat) // seq_len
        self.out = [flat[n * seq_len:].copy()]
        self.next_seq += n
        return flat[:n * seq_len].reshape(n, seq_len)


def pack_live(df: DataFrame, seq_len: int, probs: dict[str, float], source: str | None = None, place: str = "place", ids: str = "ids",
              lane: str = "lane", hold: int = HOLD, folder: str | None = None) -> DataFrame:
    """Sources mixed by share as they arrive, each in its own order, packed to full sequences per lane.

    ``place`` counts the documents of a source in a lane from 0. Document e of a source with share p has its turn at
    (e + 0.5) / p, so on every prefix each source is within one document of its share, and no source is counted first. A
    document waits until its turn and until those before it have come, whatever order files arrive in. A lane holds
    ``hold`` documents at most: beyond that the missing one is passed over, and if it comes later it is packed
    on arrival. So nothing is lost, and order and shares can only give way to a source that stays behind.

    Documents that wait are in files below ``folder``, which belongs to the stream's checkpoint as long as it is used; by
    default a new one in the shared folder. A task holds ``HELD_BYTES`` of them, and 24 bytes for each one in a file.
    """
    shares = {str(k): float(v) for k, v in probs.items() if v > 0}
    folder = folder or scratch_path(df.sparkSession, "held")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = Lane(shares, hold, state.get if state.exists else None, folder)
        for pdf in chunks:
            for s, at, x in zip(pdf["source"], pdf["place"], pdf["ids"]):
                one.add(s, int(at), x)
            more = True
            while more:
                more, first = one.drain(OUT_TOKENS), one.next_seq
                seqs = one.sequences(seq_len)
                if len(seqs):
                    yield pd.DataFrame({"lane": key[0], "seq_id": range(first, first + len(seqs)), "input_ids": list(seqs)})
            one.file_away(HELD_BYTES)
        state.update(one.state())

    of = F.col(source).cast("string") if source else F.lit(next(iter(shares)))
    return (df.select(F.col(lane).alias("lane"), of.alias("source"), F.col(place).cast("bigint").alias("place"), F.col(ids).alias("ids"))
            .groupBy("lane").applyInPandasWithState(step, PACK_SCHEMA, LIVE_STATE, "append", GroupStateTimeout.NoTimeout))


def pack_in_order(df: DataFrame, seq_len: int, place: str = "place", ids: str = "ids", lane: str = "lane", hold: int = HOLD,
                  folder: str | None = None) -> DataFrame:
    """``pack_live`` of one source: full sequences in document order across micro-batches and files."""
    return pack_live(df, seq_len, {"": 1.0}, None, place, ids, lane, hold, folder)


def dedup_stream(df: DataFrame, *cols: str) -> DataFrame:
    """First arrival per content hash. State keeps one hash per distinct content and
    grows with it: exact dedup of an unbounded stream has no watermark to drop by."""
    return df.withColumn("h", content_hash(*cols)).dropDuplicates(["h"]).drop("h")


CHUNK_ROWS = 1024       # documents of a lane that are handed over at once
GROUP_BYTES = 16 << 20  # of a row group, which a task holds whole when it writes or reads it


def _run(df: DataFrame, writer: DataStreamWriter, checkpoint: str, lanes: int | None = None) -> None:
    """Drain what is available.

    ``lanes`` is for streams of ``pack_live``, as their rows are long and their keys few: chunks hold ``CHUNK_ROWS`` rows, row groups
    ``GROUP_BYTES``, and a new checkpoint has two state partitions a lane. Every one stores its state in every micro-batch, empty or not.
    """
    conf = df.sparkSession.conf
    wanted = {"spark.sql.streaming.internal.stateStore.partitions": str(2 * lanes),
              "spark.sql.execution.arrow.maxRecordsPerBatch": str(CHUNK_ROWS), "parquet.block.size": str(GROUP_BYTES)} if lanes else {}
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # with settings of its own from here
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    q.awaitTermination()


def run_to_files(df: DataFrame, path: str, checkpoint: str, lanes: int | None = None) -> None:
    """Drain what is available into Parquet files (exactly once, by checkpoint)."""
    _run(df, df.writeStream.format("parquet").option("path", path), checkpoint, lanes)


def head_split_stream(df: DataFrame, path: str, checkpoint: str, cap: int, ratio: float, order: str) -> None:
    """Validation is the head of the first ``cap`` arrivals, the rest is train.

    Each micro-batch writes its rows and its size under its batch id, so a repeated
    batch overwrites itself and the arrival index of later ones does not move.
    """
    val = max(1, int(cap * ratio))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sizes, before = f"{path}/sizes", 0
        if batch_id > 0:
            before = (spark.read.parquet(sizes).filter(F.col("batch") < batch_id)
                      .agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        if before >= cap:  # the head is full: later batches are neither counted nor noted
            return
        d = row_index(batch, order, "__i").withColumn("__i", F.col("__i") + before)
        d = d.filter(F.col("__i") < cap).withColumn(
            "split", F.when(F.col("__i") < val, "validation").otherwise("train"))
        d.drop("__i").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        (spark.createDataFrame([(batch.count(),)], "n bigint")
         .coalesce(1).write.mode("overwrite").parquet(f"{sizes}/batch={batch_id}"))

    _run(df, df.writeStream.foreachBatch(write), checkpoint)


def shards_to_files(df: DataFrame, path: str, checkpoint: str, shard_seqs: int, lanes: int | None = None) -> None:
    """Packed sequences (lane, seq_id, input_ids) as Parquet files of exactly ``shard_seqs`` each, across micro-batches.

    A batch is stored once, put behind what the last one left open, and cut: full shards go to
    ``shards/batch=<id>``, the rest to ``open/batch=<id>``, and ``ledger/batch=<id>`` notes how many shards there are. All of it
    carries the batch id, so a batch that is repeated after a failure overwrites itself with the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = f"{path}/arrived/batch={batch_id}"
        batch.write.mode("overwrite").parquet(arrived)
        rows, before = spark.read.schema(batch.schema).parquet(arrived).withColumn("late", F.lit(1)), 0
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/ledger/batch={batch_id - 1}").first()["shards"]
            left = spark.read.schema(batch.schema).parquet(f"{path}/open/batch={batch_id - 1}")
            rows = left.withColumn("late", F.lit(0)).unionByName(rows)
        rows = row_index(rows.withColumn("h", F.xxhash64("lane")), ["seq_id", "late", "lane"], "i", bits=0, key_bits=40)
        rows = rows.withColumn("shard", F.expr(f"{before} + i div {shard_seqs}")).drop("late", "h")
        full = rows.count() // shard_seqs
        done = rows.where(F.col("shard") < before + full)
        (done.repartition("shard").sortWithinPartitions("shard", "i").drop("i", "shard")
         .write.mode("overwrite").option("maxRecordsPerFile", shard_seqs).parquet(f"{path}/shards/batch={batch_id}"))
        rows.where(F.col("shard") >= before + full).drop("i", "shard").write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
        (spark.createDataFrame([(batch_id, before + full)], "id bigint, shards bigint").coalesce(1)
         .write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}"))

    _run(df, df.writeStream.foreachBatch(write), checkpoint, lanes)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All sequences of ``shards_to_files``: the full shards and what the last batch left open."""
    columns = ["lane", "seq_id", "input_ids"]
    last = spark.read.parquet(f"{path}/ledger").agg(F.max("id")).first()[0]
    full = spark.read.schema(PACK_SCHEMA).parquet(f"{path}/shards").select(columns)
    return full.unionByName(spark.read.schema(PACK_SCHEMA).parquet(f"{path}/open/batch={last}").select(columns))

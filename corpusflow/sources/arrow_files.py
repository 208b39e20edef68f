"""Arrow IPC files as tables: footers are read in tasks, and every record batch is a split.

A table is read in two steps. The files below a folder are listed by Spark and opened in tasks: a file's
footer, or the message headers of a stream file, give one row per record batch. Then the batches
are dealt to tasks by size, whatever file they lie in, and only the wanted fields are read. A file
without a readable footer, and a batch that cannot be read, are rows too, with what was wrong with them.

Files are opened where the tasks run, by ``pyarrow.fs``, so the folder must be one that executors reach by its URI.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize

SPLIT_BYTES = 64 << 20  # bytes of batches of one task
ROWS = 10_000           # rows of a batch handed to Spark
MAGIC = b"ARROW1"       # fixed value: how a file with a footer begins
ENDING = ".arrow"
_PLAN = "path string, batch int, kind string, at bigint, size bigint, error string, schema binary"


def filesystem(uri: str) -> tuple:
    """``(file system, path)`` of a URI; paths without a scheme and ``file:`` are local."""
    from pyarrow import fs
    scheme = urlsplit(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _open(uri: str):
    system, path = filesystem(uri)
    return system.open_input_file(path)


# ---- planning ---------------------------------------------------------------------

def _stream_batches(f, schema: pa.Schema) -> Iterator[tuple[int, int]]:
    """Place and size of each record batch of a stream file; one (-1, size) where dictionaries tie batches together."""
    found = []
    while True:
        at = f.tell()
        try:
            message = pa.ipc.read_message(f)
        except EOFError:
            break
        if message.type == "dictionary":
            yield -1, f.size()
            return
        if message.type == "record batch":
            found.append((at, f.tell() - at))
    yield from found


def _splits(path: str, length: int) -> Iterator[dict]:
    none = {"path": path, "batch": None, "kind": None, "at": None, "size": length, "error": None, "schema": None}
    try:
        with _open(path) as f:
            if f.read(len(MAGIC)) == MAGIC:
                reader = pa.ipc.open_file(f)
                n, schema = reader.num_record_batches, reader.schema
                places = [(None, length // max(n, 1))] * n
                kind = "file"
            else:
                f.seek(0)
                schema = pa.ipc.read_schema(f)
                places = list(_stream_batches(f, schema))
                kind = "stream"
        told = schema.serialize().to_pybytes()
        if not places:
            yield {**none, "kind": kind, "schema": told}
        for i, (at, size) in enumerate(places):
            yield {**none, "batch": i, "kind": kind, "at": at, "size": size, "schema": told if i == 0 else None}
    except (pa.ArrowInvalid, pa.ArrowKeyError, OSError, EOFError) as e:
        yield {**none, "error": str(e)[:500]}


def plan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, batch, kind, at, size, error, schema)``: a row per record batch, or per file that has none or is damaged.

    ``schema`` is told once per file. Files end in ``.arrow``, below the folders at any depth.
    """
    schema = to_arrow_schema(StructType.fromDDL(_PLAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                rows = list(_splits(path, length))
                for k in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_pylist(rows[k:k + ROWS], schema)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .option("pathGlobFilter", f"*{ENDING}").load([paths] if isinstance(paths, str) else list(paths))
              .select("path", "length"))
    # a footer takes as long for a small file as for a large one: deal files, not bytes
    return listed.repartition("path").mapInArrow(run, _PLAN)


# ---- reading ----------------------------------------------------------------------

class _File:
    """An open file of the task, for the batches of it that follow each other."""

    def __init__(self, path: str, kind: str, columns: list[str]):
        self.path, self.file = path, _open(path)
        if kind == "file":
            schema = pa.ipc.open_file(self.file).schema
            fields = [i for i, name in enumerate(schema.names) if name in columns]
            # an empty list would mean all fields
            options = pa.ipc.IpcReadOptions(included_fields=fields or [0])
            self.reader = pa.ipc.open_file(self.file, options=options)
        else:
            self.schema = pa.ipc.read_schema(self.file)

    def batches(self, r: dict) -> Iterator[pa.RecordBatch]:
        if r["kind"] == "file":
            yield self.reader.get_batch(r["batch"])
        elif r["at"] >= 0:
            self.file.seek(r["at"])
            yield pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        else:
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)


def _fit(batch: pa.RecordBatch, target: pa.Schema) -> list[pa.Array]:
    """The wanted columns with their types; a missing one is null."""
    batch.validate(full=True)
    have = set(batch.schema.names)
    return [batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in target]


def _read(splits: DataFrame, schema: StructType, strict: bool) -> DataFrame:
    target = to_arrow_schema(schema)
    columns = target.names
    out = StructType([*schema.fields, *StructType.fromDDL("`__path` string, `__batch` int, `__error` string").fields])
    whole = to_arrow_schema(out)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for b in found:
            for r in b.to_pylist():
                try:
                    if one is None or one.path != r["path"]:
                        one = None
                        one = _File(r["path"], r["kind"], columns)
                    parts = [pa.RecordBatch.from_arrays(_fit(x, target), schema=target) for x in one.batches(r)]
                except (pa.ArrowException, OSError, EOFError) as e:
                    if strict:
                        raise ValueError(f"{r['path']}, record batch {r['batch']}: {e}") from e
                    yield pa.RecordBatch.from_pylist([{"__path": r["path"], "__batch": r["batch"], "__error": str(e)[:500]}], whole)
                    continue
                for x in parts:
                    for at in range(0, x.num_rows, ROWS):
                        y = x.slice(at, ROWS)
                        yield pa.RecordBatch.from_arrays(
                            [*y.columns, pa.array([r["path"]] * y.num_rows), pa.array([r["batch"]] * y.num_rows, pa.int32()),
                             pa.nulls(y.num_rows, pa.string())], schema=whole)
    return splits.mapInArrow(run, out)


def _dealt(splits: DataFrame, split_bytes: int) -> DataFrame:
    """Batches dealt to tasks of about ``split_bytes``, those of a file next to each other."""
    good = splits.where("error is null and batch is not null").drop("error", "schema")
    total = good.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return good.repartition(max(1, -(-total // split_bytes)), "path", "batch").sortWithinPartitions("path", "batch")


def _schema(splits: DataFrame, schema: str | None) -> StructType:
    if schema is not None:
        return StructType.fromDDL(schema)
    told = splits.where("schema is not null").orderBy("path").select("schema").limit(1).collect()
    if not told:
        raise ValueError("no readable Arrow file")
    return from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(told[0][0]))))


def read_arrow(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, strict: bool = False,
               split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of Arrow IPC files (with a footer or as streams) below ``paths``.

    ``schema`` (DDL) names the wanted columns and their types; only they are read, a file without one of them
    gives nulls. Without it, the first file by path tells the columns. Files without a readable footer are
    named in a warning and passed over; a damaged batch inside a good file is passed over too and listed by
    ``damaged_batches``. With ``strict`` both raise.
    """
    splits = materialize(plan(spark, paths), "arrow-plan")
    lost = splits.where("error is not null").select("path", "error").orderBy("path")
    for r in lost.toLocalIterator():
        if strict:
            raise ValueError(f"cannot read {r['path']}: {r['error']}")
        warnings.warn(f"cannot read {r['path']}: {r['error']}")
    wanted = _schema(splits, schema)
    return _read(_dealt(splits, split_bytes), wanted, strict).where("`__error` is null").select(*[f"`{f.name}`" for f in wanted])


def damaged_batches(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """``(path, batch, error)`` of all that ``read_arrow`` passes over; batch is null for a whole file."""
    splits = materialize(plan(spark, paths), "arrow-plan")
    files = splits.where("error is not null").select("path", "batch", "error")
    wanted = _schema(splits, schema)
    bad = _read(_dealt(splits, SPLIT_BYTES), wanted, False).where("`__error` is not null")
    return files.unionByName(bad.select(F.col("__path").alias("path"), F.col("__batch").alias("batch"), F.col("__error").alias("error")))


# ---- writing ----------------------------------------------------------------------

def write_arrow(df: DataFrame, path: str, rows: int = 1000, stream: bool = False) -> None:
    """One Arrow file per partition, record batches of ``rows`` rows; the folder must not hold files of the same names.

    A file appears under its name only when it is complete, so a task that runs again replaces what it left.
    """
    target = to_arrow_schema(df.schema)
    folder = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TaskContext.get()
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        name, part = f"{base}/part-{t.partitionId():05d}{ENDING}", f"{base}/.part-{t.partitionId():05d}-{t.taskAttemptId()}"
        n = 0
        with system.open_output_stream(part) as f:
            make = pa.ipc.new_stream if stream else pa.ipc.new_file
            with make(f, target) as writer:
                for b in batches:
                    for at in range(0, b.num_rows, rows):
                        writer.write_batch(pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(b.slice(at, rows).columns, target)], schema=target))
                    n += b.num_rows
        system.move(part, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
    if df.mapInArrow(run, "n bigint").agg(F.count("n")).first()[0] == 0:  # no partition at all: one file tells the columns
        df.sparkSession.range(1).repartition(1).mapInArrow(lambda _: run(iter(())), "n bigint").collect()

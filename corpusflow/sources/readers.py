"""Readers: text lines, JSON lines, Parquet text, instruction files, packed datasets."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.chat import formatter
from ..functions.text import not_blank, strict_json, strip
from ..operators.index import first_n, row_index
from ..operators.mixing import concat_sources
from . import arrow_files

# Text field names in order of preference, and file endings.
TEXT_KEYS = ("text", "content", "body", "document")
EXTENSIONS = (".txt", ".jsonl", ".jsonl.gz", ".ndjson", ".ndjson.gz", ".parquet", ".arrow")
UNREADABLE = (".arrow",)
FALLBACK_ROWS = 5000

DATA_ENV = "CORPUSFLOW_DATA"
DEFAULT_BASE = "datasets"

INSTRUCTION_SCHEMA = (
    "instruction string, input string, output string, response string, prompt string, "
    "completion string, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<`from`:string,value:string>>, question string, answer string, "
    "role string, text string, chosen string, rejected string"
)


# ---- text -----------------------------------------------------------------------

def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, line_no, line`` of text files.

    A file split gives its start offset and rows in order, so positions are counted
    per split and the splits of a file are added up. No group exceeds a split.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__row"), F.col("value").alias("line"))
    return row_index(raw, ["__start", "__row"], "line_no", ["path"], block=F.col("__start")).select(
        "path", "line_no", "line")


def read_lines(spark: SparkSession, paths: str | list[str], numbered: bool = True) -> DataFrame:
    """Stripped, non-blank lines; ``line_no`` counts all lines of the file from 0."""
    d = (_numbered(spark, paths) if numbered else
         spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))
    return d.withColumn("line", strip("line")).filter(F.col("line") != "")


def json_text(line: Column | str, keys: Sequence[str] = TEXT_KEYS) -> Column:
    """First key that is present with a string value, stripped; null for bad JSON."""
    v = strict_json(line)
    picks = []
    for k in keys:
        at = f'$["{k}"]'
        kind = F.schema_of_variant(F.variant_get(v, at, "variant"))
        picks.append(F.when(kind == "STRING", F.try_variant_get(v, at, "string")))
    return strip(F.coalesce(*picks))


def read_jsonl_text(spark: SparkSession, paths: str | list[str], keys: Sequence[str] = TEXT_KEYS,
                    numbered: bool = True) -> DataFrame:
    """Text field of JSON lines (plain or gzip by file ending); bad lines are dropped."""
    return (read_lines(spark, paths, numbered).withColumn("text", json_text("line", keys))
            .filter(F.col("text").isNotNull()).drop("line"))


# What Spark says of a folder or file that is not readable as Parquet.
NOT_PARQUET = ("UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "FAILED_MERGE_SCHEMA",
               "CANNOT_MERGE_SCHEMAS")


def _not_parquet(e: Exception) -> bool:
    """A format or footer fault; anything else (permissions, network) is not ours to pass over."""
    said = (e.getCondition() or "") if isinstance(e, PySparkException) else ""
    return said.startswith(NOT_PARQUET) or "is not a Parquet file" in str(e) or "Could not read footer" in str(e)


def _readable_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder without its broken files; None when nothing can be read.

    The schema comes from one file; when that is a broken one, from all footers.
    """
    for merge in (False, True):
        try:
            return (spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", merge)
                    .parquet(path))
        except Exception as e:
            if isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND":
                return None
            if not _not_parquet(e):
                raise
    return None


def _data_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the Parquet files below a folder, hidden ones left out as Spark does."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path").where(F.col("path").endswith(".parquet")))


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of the files a lenient read of ``path`` loses, and of files without rows.

    Counting rows per file reads the footers only.
    """
    listed = _data_files(spark, path)
    d = _readable_parquet(spark, path)
    if d is None:
        return listed
    seen = d.select(F.col("_metadata.file_path").alias("path")).distinct()
    return listed.join(seen, "path", "left_anti")


def report_skipped(spark: SparkSession, path: str, strict: bool) -> None:
    """Warn about each lost file by path; with ``strict`` raise."""
    lost = [r["path"] for r in skipped_files(spark, path).orderBy("path").toLocalIterator()]
    for p in lost:
        warnings.warn(f"no rows read from {p}")
    if lost and strict:
        raise ValueError(f"no rows read from {len(lost)} files below {path}: {', '.join(lost[:20])}")


def _text_of(d: DataFrame, keys: Sequence[str], keep: Sequence[str | Column], where: str) -> DataFrame | None:
    names = {c.lower(): c for c in d.columns}
    col = next((names[k.lower()] for k in keys if k.lower() in names), None)
    if col is None:
        warnings.warn(f"no text column {tuple(keys)} in {where}")
        return None
    if d.schema[col].dataType.typeName() != "string":
        warnings.warn(f"column {col} of {where} holds {d.schema[col].dataType.simpleString()}, not text")
        return None
    return d.filter(F.col(col).isNotNull()).select(*keep, strip(col).alias("text"))


def read_parquet_text(spark: SparkSession, paths: str | list[str], keys: Sequence[str] = TEXT_KEYS,
                      keep: Sequence[str | Column] = (), strict: bool = False, mixed: bool = False) -> DataFrame:
    """The first of ``keys`` found as a column (any case) of each path, strings only.

    A path is a file or a folder of one schema; with ``mixed`` the files of a folder choose
    their column each, a plan branch per distinct set of columns. Files that cannot be read
    are reported by path, with ``strict`` they raise; so are paths without a text column.
    """
    parts = []
    for p in [paths] if isinstance(paths, str) else paths:
        if mixed:
            parts += _mixed_text(spark, p, keys, keep, strict)
            continue
        d = _readable_parquet(spark, p)
        if d is None:
            if strict:
                raise ValueError(f"cannot read {p}")
            warnings.warn(f"cannot read {p}")
            continue
        report_skipped(spark, p, strict)
        d = _text_of(d, keys, keep, p)
        if d is not None:
            parts.append(d)
    if not parts:
        raise ValueError(f"nothing readable in {paths}")
    return concat_sources(*parts)


def _columns_of_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, columns, error)`` of the Parquet files below ``path``, their footers read in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, error = [], []
            for p in b.column("path").to_pylist():
                try:
                    system, at = arrow_files.filesystem(p)
                    with system.open_input_file(at) as f:
                        schema = pq.read_schema(f)
                    columns.append("\n".join(f"{x.name} {x.type}" for x in schema))
                    error.append(None)
                except (pa.ArrowException, OSError) as e:
                    columns.append(None)
                    error.append(str(e)[:300])
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(columns, pa.string()), pa.array(error, pa.string())],
                                             ["path", "columns", "error"])
    return _data_files(spark, path).repartition("path").mapInArrow(run, "path string, columns string, error string")


def _mixed_text(spark: SparkSession, path: str, keys: Sequence[str], keep: Sequence[str | Column], strict: bool) -> list[DataFrame]:
    """One branch per set of columns below ``path``; of the files, only their paths by group come to the driver."""
    files = _columns_of_files(spark, path).toArrow().to_pylist()  # paths, which Spark's reader lists on the driver as well
    groups: dict[str, list[str]] = {}
    for r in sorted(files, key=lambda r: r["path"]):
        if r["error"] is None:
            groups.setdefault(r["columns"], []).append(r["path"])
        elif strict:
            raise ValueError(f"cannot read {r['path']}: {r['error']}")
        else:
            warnings.warn(f"cannot read {r['path']}: {r['error']}")
    found = [_text_of(spark.read.parquet(*files), keys, keep, f"{len(files)} files below {path}, the first {files[0]}")
             for files in groups.values()]
    return [d for d in found if d is not None]


# ---- files ------------------------------------------------------------------------

def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system; nothing is listed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_ending(path: Column | str, exts: Sequence[str] = EXTENSIONS) -> Column:
    """The longest listed ending of a path, null when none fits."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(*[F.when(c.endswith(e), e) for e in sorted(exts, key=len, reverse=True)])


def scan_files(spark: SparkSession, roots: Sequence[str], exts: Sequence[str] = EXTENSIONS) -> DataFrame:
    """``path, ext, length, skipped`` of all files below the roots; contents are not read.

    Missing roots are passed over. Raw Arrow files are listed with ``skipped``.
    """
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r)
             .select("path", "length") for r in roots if r and path_exists(spark, r)]
    if not found:
        return spark.createDataFrame([], "path string, ext string, length bigint, skipped boolean")
    return (concat_sources(*found).withColumn("ext", file_ending("path", exts))
            .filter(F.col("ext").isNotNull())
            .select("path", "ext", "length", F.col("ext").isin(*UNREADABLE).alias("skipped")))


def resolve_dataset(spark: SparkSession, name: str, base: str | None = None) -> str:
    """``<base>/<name>.arrow_parquet``, else ``<base>/<name>.arrow``."""
    base = base or os.environ.get(DATA_ENV, DEFAULT_BASE)
    for ending in (".arrow_parquet", ".arrow"):
        path = f"{base.rstrip('/')}/{name}{ending}"
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no dataset {name!r} below {base}")


# ---- records ------------------------------------------------------------------------

def read_instructions(spark: SparkSession, path: str, fmt: str = "alpaca",
                      multiline: bool | None = None) -> DataFrame:
    """Instruction records of a JSON or JSON-lines file as a non-blank ``text`` column."""
    if fmt not in ("alpaca", "chat"):
        raise ValueError(f"unknown format {fmt!r}")
    multiline = path.endswith(".json") if multiline is None else multiline
    d = (spark.read.schema(INSTRUCTION_SCHEMA).option("mode", "FAILFAST")
         .option("multiLine", multiline).json(path))
    return d.select(formatter(fmt)().alias("text")).filter(not_blank("text"))


def read_packed(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A packed dataset: the folder itself, else its ``_parquet`` shards, else its Arrow files.

    Ids are cast to int whatever integer type was stored. Broken files are skipped and
    reported by path, with ``strict`` they raise; having no rows at all is an error. Of Arrow
    files only ``input_ids`` is read.
    """
    for p in (path, f"{path}_parquet"):
        d = _readable_parquet(spark, p)
        if d is None or "input_ids" not in d.columns:
            continue
        d = d.withColumn("input_ids", F.col("input_ids").cast("array<int>"))
        if not d.isEmpty():
            report_skipped(spark, p, strict)
            return d
    if path_exists(spark, path):
        found = arrow_files.plan(spark, path).where("error is null")
        if not found.isEmpty():
            d = arrow_files.read_arrow(spark, path, "input_ids array<int>", strict)
            if not d.isEmpty():
                return d
    raise ValueError(f"no packed rows in {path}")


def first_nonempty(candidates: Sequence[Callable[[], DataFrame]], default: Callable[[], DataFrame],
                   order: str, n: int = FALLBACK_ROWS) -> DataFrame:
    """The first candidate that loads and has rows, else the head of the default."""
    for load in candidates:
        try:
            d = load()
            if not d.isEmpty():
                return d
        except AnalysisException:
            continue
    return first_n(default(), n, order)


def first_loadable(*loads: Callable[[], DataFrame]) -> DataFrame:
    """What the first of ``loads`` gives whose source is there; the last one's failure is raised."""
    for load in loads[:-1]:
        try:
            return load()
        except AnalysisException as e:
            warnings.warn(f"source passed over: {e.getCondition()}")
    return loads[-1]()


def source_counts(catalog: dict[str, DataFrame]) -> DataFrame:
    """``source, n`` for a set of named tables."""
    return concat_sources(*[d.agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "n")
                            for s, d in catalog.items()])


def head_nonblank(df: DataFrame, n: int, order: str | Sequence[str], text: str = "text",
                  cut_first: bool = False) -> DataFrame:
    """First ``n`` non-blank rows; with ``cut_first`` blanks are dropped after the cut."""
    if cut_first:
        return first_n(df, n, order).filter(not_blank(text))
    return first_n(df.filter(not_blank(text)), n, order)

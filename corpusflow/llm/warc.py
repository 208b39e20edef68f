"""Deterministic sharded WARC writer and reader (operator 7).

1. Payload digests are compared in Spark: the smallest page of equal payloads is the response.
2. Records are range-sorted by page; each range is a shard. The ranges are cut where exact running byte totals
   of blocks of page ids say so, not by a sample, so shards are the same on any layout of the table.
3. A task streams its shard into gzip members, one per record, and rolls to a new file at a
   compressed size. Headers and digests are made anew; dates and record ids follow from the page,
   so equal tables give equal archives.
4. Files are written under temporary names of their attempt. The tasks' manifest is stored by
   Spark, which keeps one attempt of each task; only files it lists get their final names, in tasks, and the
   manifest file comes last. What a lost executor left is never listed; a commit that broke off can be called again.

Archives go to any file system pyarrow can open by URI.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.index import LOWEST, int_div, prefix_sum
from ..session import materialize, release, scratch_path

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
BLOCK_BITS = 10  # pages of 1,024 consecutive ids are in one shard
HEADERS = 512  # bytes a record counts beside its payload


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{sha1}')}>"


def record(page: str, url: str, payload: bytes, refers: str | None, refers_url: str) -> bytes:
    """One response, or the revisit of page ``refers``, with fresh headers."""
    sha1 = digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, sha1)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
            f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-ID: {page}"]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, sha1)}", f"X-Refers-To-Page: {refers}"]
        if refers_url:
            head.append(f"WARC-Refers-To-Target-URI: {refers_url}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """Writes members to temporary files and starts the next one at a compressed size."""

    def __init__(self, uri: str, shard: int, limit: int, level: int):
        self.fs, self.root = open_fs(uri)
        self.shard, self.limit, self.level = shard, limit, level
        self.attempt, self.count, self.out, self.done = uuid.uuid4().hex[:12], 0, None, []

    def add(self, page: int | None, raw: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        if self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.temp = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.size, self.records, self.first, self.sha = 0, 0, page, hashlib.sha256()
            self.count += 1
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temp, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
            self.out = None


def _line(text: str | None) -> str:
    """A header value on one line."""
    return " ".join((text or "").split())


def classify(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(page, sha, refers, refers_url)`` of pages whose payload is also that of a smaller page."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("u"),
                     F.sha2(F.coalesce(html_col, F.lit("")), 256).alias("sha"),
                     F.octet_length(F.coalesce(html_col, F.lit(""))).alias("n")).where(F.col("page").isNotNull() & (F.col("n") >= least))
    first = (p.groupBy("sha").agg(F.min(F.struct("page", "u")).alias("f"), F.count("*").alias("k")).where("k > 1"))
    return (p.select("page", "sha").join(first, "sha").where("page > f.page")
            .select("page", "sha", F.col("f.page").alias("refers"), F.col("f.u").alias("refers_url")).distinct())


def block_columns(rows: DataFrame) -> DataFrame:
    """Adds ``b1, b2``: consecutive pages, and for a null id the leading digits of the payload's hash, the order there."""
    return rows.withColumns({
        "b1": F.coalesce(F.shiftright("page", BLOCK_BITS), F.lit(LOWEST >> BLOCK_BITS)),
        "b2": F.when(F.col("page").isNull(), F.conv(F.substring("sha", 1, 4), 16, 10).cast("int")).otherwise(F.lit(0))})


def shard_ranges(body: DataFrame, shard_bytes: int, shards: int | None) -> DataFrame:
    """``(b1, b2, shard)`` of every block, from the bytes of all blocks before it; narrow rows, stored."""
    sizes = block_columns(body).groupBy("b1", "b2").agg(F.sum(F.octet_length("html") + HEADERS).alias("size"))
    sizes = materialize(sizes, "blocks")
    if shards:
        shard_bytes = -(-(sizes.agg(F.sum("size")).first()[0] or 1) // shards)
    before = prefix_sum(sizes, F.col("size"), "before", ["b1", "b2"])
    out = materialize(before.select("b1", "b2", int_div("before", shard_bytes).alias("shard")), "shards")
    release(sizes)
    return out


def write(pages: DataFrame, uri: str, least: int = 0, roll: int = 64 << 20, level: int = 6, shards: int | None = None,
          shard_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as ``part-<shard>-<number>.warc.gz`` below ``uri``; returns the manifest rows.

    Of records with equal payloads of ``least`` bytes or more the one with the smallest page id is a
    response, the others revisit it; ties on that id are all responses, and so is a null id. Null html
    is an empty payload, a null url an empty one; a payload of any length is one member; an empty table writes
    a manifest and no file; other columns are ignored. ``roll`` is the compressed size of a file; a larger
    record has a file of its own. A shard holds about ``shard_bytes`` before compression, or there are about ``shards``
    of them; rows equal in id and payload share one.
    """
    body = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    body = body.withColumn("sha", F.sha2("html", 256)).withColumns(
        {"refers": F.lit(None).cast("bigint"), "refers_url": F.lit(None).cast("string"), "kind": F.lit(1)})
    # what a page revisits travels as a row just before it, so payloads need no join
    notes = classify(pages, least, id_col, url_col, html_col).select(
        "page", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "sha", "refers", "refers_url", F.lit(0).alias("kind"))
    order = ["page", "sha", "kind", "url"]
    ranges = shard_ranges(body, shard_bytes, shards)
    rows = block_columns(body.unionByName(notes)).join(ranges, ["b1", "b2"]).drop("b1", "b2")
    rows = rows.select("page", "url", "html", "sha", "refers", "refers_url", "kind", "shard")
    # a number of its own, as merged partitions would put many shards in one task
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "shard").sortWithinPartitions("shard", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, note, done = None, (None, None, None, None), []
        for b in batches:
            for page, url, html, sha, refers, refers_url, kind, shard in zip(*(b.column(i) for i in range(b.num_columns))):
                page, sha = page.as_py(), sha.as_py()
                if kind.as_py() == 0:
                    note = page, sha, refers.as_py(), refers_url.as_py()
                    continue
                if out is None or out.shard != shard.as_py():
                    if out:
                        out.close()
                        done += out.done
                    out = _Roll(uri, shard.as_py(), roll, level)
                to = note[2:] if note[:2] == (page, sha) else (None, None)
                name = "" if page is None else str(page)
                out.add(page, record(name, _line(url.as_py()), html.as_py().encode(),
                                     None if to[0] is None else str(to[0]), _line(to[1])))
        if out:
            out.close()
            cols = list(zip(*done, *out.done))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["name", "temp", "records", "bytes", "sha256", "first", "last"])

    fs, root = open_fs(uri)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    manifest = materialize(rows.mapInArrow(
        run, "name string, temp string, records bigint, bytes bigint, sha256 string, first bigint, last bigint"), "manifest")
    release(ranges)
    commit(manifest, uri)
    return manifest


def commit(manifest: DataFrame, uri: str) -> None:
    """Give the listed files their names, in tasks, then write the manifest, a line a file.

    May be called again for a manifest whose commit broke off: a file that has its name already stays.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        for b in batches:
            for name, temp, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                if fs.get_file_info(f"{root}/{temp}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").size != size:
                    raise FileNotFoundError(f"{name} is neither written nor committed")
            yield b.select(["name"])

    listed = manifest.select("name", "temp", "bytes")
    tasks = min(max(1, listed.count()), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    release(materialize(listed.repartition(tasks, "name").mapInArrow(run, "name string"), "renamed"))
    fs, root = open_fs(uri)
    with fs.open_output_stream(f"{root}/_manifest.part") as f:
        gap = b"[\n"
        for r in manifest.orderBy("name").toLocalIterator():
            f.write(gap + json.dumps({k: r[k] for k in ("name", "records", "bytes", "sha256", "first", "last")}).encode())
            gap = b",\n"
        f.write(b"[]" if gap == b"[\n" else b"\n]")
    fs.move(f"{root}/_manifest.part", f"{root}/manifest.json")
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, read in chunks; one record at a time is in memory."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(CHUNK):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> dict[str, str | bytes]:
    """Header fields of a record, its block under ``block``; raises if a digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    out: dict = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[:int(out["Content-Length"])]
    if out["WARC-Block-Digest"] != f"sha1:{digest(block)}" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"damaged record {out['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if out["WARC-Type"] == "response" and (len(payload) != size or out["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError(f"damaged payload {out['WARC-Record-ID']}")
    return out | {"size": size, "payload": payload}


def read(spark: SparkSession, uri: str, payloads: bool = False) -> DataFrame:
    """Records of the committed archives below ``uri``; digests are checked, damage raises.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``, with the html where ``payloads``.
    """
    listed = spark.read.text((uri if ":" in uri else f"file://{uri}") + "/manifest.json")
    files = listed.select(F.get_json_object("value", "$.name").alias("name")).where("name is not null")
    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
              + ", html string" * payloads)

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for raw in _members(f):
                        r = parse(raw)
                        row = [number(r["X-Page-ID"]), r["WARC-Target-URI"], r["size"], r["WARC-Payload-Digest"][5:], r["WARC-Type"],
                               number(r.get("X-Refers-To-Page"))]
                        if payloads:
                            row.append(r["payload"].decode() if r["WARC-Type"] == "response" else None)
                            held += len(raw)
                        rows.append(row)
                        if len(rows) >= 5000 or held > 16 * CHUNK:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    labels = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], labels[:len(rows[0])])

    return files.repartition(max(1, files.count()), "name").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0, **how) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    uri = scratch_path(pages.sparkSession, "warc")
    write(pages, uri, least, **how)
    return read(pages.sparkSession, uri)

"""Round trips through the readers, writers and streams, on the given tables.

Scratch data goes to the shared folder the cluster names (a temporary one in tests).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import classify_bucket
from ..operators import conversations as V
from ..operators import mixing as M
from ..operators import tokens as K
from ..operators.index import int_div, row_index
from ..session import scratch_path
from ..sources import arrow_files
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import streams as S
from .chat_queries import A, _INSTR, instructions
from .mix_queries import _SPEC, _lang_spec
from .registry import conversations, documents, query
from .sql import ids_cte, FIRSTS, joined, lines_cte, strip
from .text_queries import _BUCKET_SQL, _PATH_SQL, _doc_path
from .token_queries import _PACKED, SEQ, VOCAB, doc_vocab, packed_docs


FILE_BYTES = 32 << 20  # of text in one file, about


def _parts_of(docs, files):
    """Into how many parts each of ``files`` even files is dealt so that a task writes and reads ``FILE_BYTES`` of text at most."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // (files * FILE_BYTES)))


# ---- sources ---------------------------------------------------------------------

@query("src1_read_lines", f"""
WITH {lines_cte()} SELECT {strip('line')} AS line, count(*) AS n FROM dlines WHERE {strip('line')} <> '' GROUP BY 1""")
def src1(spark, sf):
    path = scratch_path(spark, "corpus")
    W.write_corpus(documents(spark, sf), path, "doc_id")
    return R.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("src2_read_jsonl_text", f"""
SELECT {strip('text')} AS text, count(*) AS n FROM documents WHERE doc_id % 3 <> 2 GROUP BY 1""")
def src2(spark, sf):
    # a string text, a number text with string content, and no usable field
    k = F.col("doc_id") % 3
    rec = (F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), "text").alias("text"))))
           .when(k == 1, F.to_json(F.struct(F.lit(1).alias("text"), F.col("text").alias("content"))))
           .otherwise(F.lit("[1] not a record")))
    path = scratch_path(spark, "records") + ".jsonl"
    documents(spark, sf).select(rec.alias("value")).write.option("compression", "gzip").text(path)
    return R.read_jsonl_text(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("src3_read_parquet_text", f"""
SELECT {strip('text')} AS text FROM documents UNION ALL SELECT {strip('text')} FROM benchmark""")
def src3(spark, sf):
    return R.read_parquet_text(spark, [f"{sf}/documents.parquet", f"{sf}/benchmark.parquet"], ("CONTENT", "TEXT"))


@query("src4_scan_files", """
SELECT DISTINCT source, e AS ext, e = '.arrow' AS skipped FROM documents, (VALUES ('.parquet'), ('.jsonl'), ('.txt'), ('.arrow')) x(e)""")
def src4(spark, sf):
    """Folders written from the documents in several formats, found again by path and ending."""
    root = scratch_path(spark, "src4")
    d = documents(spark, sf).select("source", "text")
    d.write.partitionBy("source").parquet(f"{root}/p")
    d.write.partitionBy("source").option("extension", "jsonl").csv(f"{root}/j")
    d.write.partitionBy("source").text(f"{root}/t")
    d.write.partitionBy("source").option("extension", "arrow").csv(f"{root}/a")
    found = R.scan_files(spark, [root, f"{root}/no-such-folder"])
    return found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "ext", "skipped").distinct()


@query("src5_read_instructions", f"""
WITH {FIRSTS} SELECT text FROM (SELECT conv_id, {_INSTR} || {strip(A)} AS text FROM firsts) WHERE {strip('text')} <> ''""")
def src5(spark, sf):
    path = scratch_path(spark, "instructions") + ".jsonl"
    instructions(spark, sf).drop("conv_id").write.json(path)
    return R.read_instructions(spark, path, "alpaca")


@query("src5_read_chats", f"""
SELECT string_agg(CASE role WHEN 'user' THEN '<s>user: ' || {strip('text')} || '</s>'
  WHEN 'assistant' THEN 'assistant: ' || {strip('text')} || '</s>'
  ELSE role || ': ' || {strip('text')} END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def src5_chat(spark, sf):
    path = scratch_path(spark, "chats") + ".jsonl"
    V.assemble_messages(conversations(spark, sf)).select("messages").write.json(path)
    return R.read_instructions(spark, path, "chat")


@query("src6_read_packed", f"WITH {_PACKED} SELECT seq_id, array_to_string(input_ids, ',') AS input_ids FROM packed")
def src6(spark, sf):
    path = scratch_path(spark, "packed")
    W.save_dataset(packed_docs(spark, sf).withColumn("input_ids", F.col("input_ids").cast("array<bigint>")),
                   f"{path}_parquet")
    return R.read_packed(spark, path).select("seq_id", F.array_join("input_ids", ",").alias("input_ids"))


@query("src6_read_arrow", "SELECT doc_id, text, lang, CAST(n_chars AS INT) AS n_chars FROM documents")
def src6_arrow(spark, sf):
    """Documents written as Arrow files with footers and as streams, four of their columns read back; one count is narrowed."""
    path = scratch_path(spark, "arrow")
    d = documents(spark, sf).withColumn("padding", F.repeat("source", 3))
    k = _parts_of(d, 5)
    arrow_files.write_arrow(d.where("doc_id % 2 = 0").repartition(3 * k), f"{path}/files", rows=64)
    arrow_files.write_arrow(d.where("doc_id % 2 = 1").repartition(2 * k), f"{path}/deep/er/streams", rows=50, stream=True)
    return arrow_files.read_arrow(spark, path, "doc_id bigint, text string, lang string, n_chars int", strict=True)


@query("src6_packed_arrow", f"WITH {_PACKED} SELECT {joined('input_ids')} AS input_ids FROM packed")
def src6_packed_arrow(spark, sf):
    """Packed sequences of 64-bit ids in Arrow files, read back as a packed dataset."""
    path = scratch_path(spark, "packed-arrow")
    ids = packed_docs(spark, sf).withColumn("input_ids", F.col("input_ids").cast("array<bigint>"))
    arrow_files.write_arrow(ids, f"{path}/data", rows=100)
    return R.read_packed(spark, path).select(F.array_join("input_ids", ",").alias("input_ids"))


@query("src7_resolve_dataset", "SELECT doc_id, text FROM documents")
def src7(spark, sf):
    base = scratch_path(spark, "base")
    d = documents(spark, sf).select("doc_id", "text")
    W.save_dataset(d.limit(0), f"{base}/docs.arrow")
    W.save_dataset(d, f"{base}/docs.arrow_parquet")
    return spark.read.parquet(R.resolve_dataset(spark, "docs", base))


@query("src8_first_nonempty", """
SELECT doc_id FROM documents WHERE lang = 'fr' UNION ALL
SELECT doc_id + 1000000 FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5000)""")
def src8(spark, sf):
    d = documents(spark, sf)
    none = lambda: d.filter(F.col("lang") == "xx")
    missing = lambda: spark.read.parquet(f"{sf}/missing.parquet")
    french = lambda: d.filter(F.col("lang") == "fr")
    hit = R.first_nonempty([missing, none, french], lambda: d, "doc_id").select("doc_id")
    head = R.first_nonempty([missing, none], lambda: d, "doc_id").select((F.col("doc_id") + 1_000_000).alias("doc_id"))
    return hit.unionByName(head)


# ---- sinks -----------------------------------------------------------------------

@query("snk1_write_corpus", f"""
SELECT text AS doc, count(*) AS n FROM documents GROUP BY text""")
def snk1(spark, sf):
    path = scratch_path(spark, "corpus")
    crlf = documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    W.write_corpus(crlf, path, "doc_id")
    back = spark.read.option("lineSep", W.DOC_END).text(path)
    return back.groupBy(F.col("value").alias("doc")).agg(F.count("*").alias("n"))


@query("snk2_write_buckets", f"""
SELECT doc_id, {_BUCKET_SQL} AS bucket FROM (SELECT doc_id, {_PATH_SQL} AS path FROM documents)""")
def snk2(spark, sf):
    path = scratch_path(spark, "buckets")
    d = documents(spark, sf).select("doc_id", "text", classify_bucket(_doc_path()).alias("bucket"))
    W.write_buckets(d, path)
    return spark.read.parquet(path).select("doc_id", "bucket")


@query("snk3_write_shards", f"""
WITH {_PACKED} SELECT seq_id // 100 AS shard, count(*) AS n, 1::BIGINT AS files FROM packed GROUP BY 1""")
def snk3(spark, sf):
    path = scratch_path(spark, "shards")
    W.write_shards(packed_docs(spark, sf), path, 100)
    d = R.read_packed(spark, path).select("seq_id", F.col("_metadata.file_path").alias("f"))
    return d.groupBy(int_div("seq_id", 100).alias("shard")).agg(
        F.count("*").alias("n"), F.countDistinct("f").alias("files"))


@query("snk4_meta", f"""
WITH {_PACKED} SELECT 'words' AS encoding, {VOCAB} AS vocab_size, {SEQ} AS seq_len, count(*) AS rows FROM packed""")
def snk4(spark, sf):
    path = scratch_path(spark, "packed")
    packed = packed_docs(spark, sf)
    W.save_dataset(packed, path)
    W.write_meta(spark, path, "words", VOCAB, SEQ)
    n = R.read_packed(spark, path).agg(F.count("*").alias("rows"))
    return W.read_meta(spark, path).select("*", n.scalar().alias("rows"))


@query("snk5_write_mixture", f"""
WITH m AS (SELECT * FROM (VALUES ('fineweb', 0.6::DOUBLE), ('wikipedia', 0.1::DOUBLE), ('books', 0.1::DOUBLE),
    ('code', 0.1::DOUBLE), ('math', 0.1::DOUBLE)) t(source, weight)),
b AS (SELECT {_BUCKET_SQL} AS source, count(*) AS n FROM (SELECT {_PATH_SQL} AS path FROM documents) GROUP BY 1)
SELECT source, weight, 0.5::DOUBLE AS temperature, n FROM m JOIN b USING (source)""")
def snk5(spark, sf):
    path = scratch_path(spark, "mixture")
    W.write_mixture(spark, path)
    spec = spark.read.schema("source string, weight double, temperature double").json(path)
    counts = M.bucket_counts(documents(spark, sf).withColumn("path", _doc_path()), "path")
    return spec.join(counts.withColumnRenamed("bucket", "source"), "source")


@query("snk6_save_dataset", "SELECT doc_id, lang FROM documents")
def snk6(spark, sf):
    path = scratch_path(spark, "dataset")
    W.save_dataset(documents(spark, sf).select("doc_id", "lang"), path)
    return spark.read.parquet(path)


# ---- user functions over batches ------------------------------------------------------

@query("udf3_batched_map", f"""
SELECT conv_id, role, CAST(length(text) AS BIGINT) AS n FROM conversations WHERE length(text) > 20
UNION ALL SELECT conv_id, 'copy', CAST(length(text) AS BIGINT) FROM conversations WHERE length(text) > 20""")
def udf3(spark, sf):
    """Many rows in, another number out, in Arrow batches."""
    def keep_and_copy(batches):
        import pandas as pd
        for pdf in batches:
            n = pdf["text"].str.len()
            kept = pdf[n > 20].assign(n=n[n > 20])[["conv_id", "role", "n"]]
            yield pd.concat([kept, kept.assign(role="copy")])
    d = conversations(spark, sf).select("conv_id", "role", "text")
    return d.mapInPandas(keep_and_copy, "conv_id bigint, role string, n bigint")


# ---- streams ---------------------------------------------------------------------------

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def doc_stream(spark, sf, max_files=2, files=4):
    """The documents as a stream of files; where they would be large, each is dealt as several, and as many more come at once."""
    path, d = scratch_path(spark, "stream-in"), documents(spark, sf)
    k = _parts_of(d, files)
    d.repartition(files * k).write.parquet(path)
    return S.read_stream(spark, path, DOC_SCHEMA, max_files=max_files * k)


def _drain(spark, df, name, lanes=None):
    out, chk = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    S.run_to_files(df, out, chk, lanes)
    return spark.read.schema(df.schema).parquet(out)


@query("str1_read_stream", "SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def str1(spark, sf):
    return _drain(spark, doc_stream(spark, sf), "str1")


@query("str2_stream_encode", f"""
WITH {_PACKED} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY line_no, j) AS ids
FROM ids WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de') GROUP BY doc_id""")
def str2(spark, sf):
    d = doc_stream(spark, sf).filter(F.col("lang") != "de")
    d = K.encode_lines(d, doc_vocab(spark, sf)).select("doc_id", F.array_join("ids", ",").alias("ids"))
    return _drain(spark, d, "str2")


LANES = 8
_LANE_SQL = f"CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {LANES} AS VARCHAR)"


def _placed_stream(spark, sf, group):
    """The documents with their place in lane and group, as files that hold them in no order."""
    d = S.with_lanes(documents(spark, sf).select("doc_id", "text", F.col("lang").alias("source")), "doc_id", LANES)
    d = row_index(d, "doc_id", "place", group)
    path, k = scratch_path(spark, "stream-in"), _parts_of(documents(spark, sf), 5)
    d.repartition(5 * k, F.md5(F.col("doc_id").cast("string"))).write.parquet(path)
    return S.read_stream(spark, path, "doc_id bigint, text string, source string, lane string, place bigint", max_files=k)


def _in_order(spark, sf):
    # files come in no order, so a lane may have to wait with most of its documents until the last one
    return S.pack_in_order(K.encode_lines(_placed_stream(spark, sf, ["lane"]), doc_vocab(spark, sf)), SEQ, hold=1_000_000)


_STREAM_PACKED = f"""{ids_cte(VOCAB)}, x AS (SELECT lane, id, row_number() OVER (PARTITION BY lane ORDER BY doc_id, line_no, j) - 1 AS pos
  FROM (SELECT {_LANE_SQL} AS lane, * FROM ids) y)
SELECT lane, pos // {SEQ} AS seq_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
FROM x GROUP BY 1, 2 HAVING count(*) = {SEQ}"""


@query("str3_stream_pack", f"WITH {_STREAM_PACKED}")
def str3(spark, sf):
    """Five files in no order, one a micro-batch; each lane's content is that of its documents in order."""
    d = _drain(spark, _in_order(spark, sf), "str3", LANES)
    return d.select("lane", "seq_id", F.array_join("input_ids", ",").alias("input_ids"))


@query("str4_stream_dedup", "SELECT DISTINCT text FROM documents")
def str4(spark, sf):
    d = S.dedup_stream(doc_stream(spark, sf).select("doc_id", "text"), "text")
    return _drain(spark, d, "str4").select("text")


@query("str5_stream_shards", f"WITH {_STREAM_PACKED}")
def str5(spark, sf):
    """Shards of exactly 100 sequences over five micro-batches, and the open rest."""
    path, chk = scratch_path(spark, "str5"), scratch_path(spark, "str5-checkpoint")
    S.shards_to_files(_in_order(spark, sf), path, chk, 100, LANES)
    return S.read_shards(spark, path).select("lane", "seq_id", F.array_join("input_ids", ",").alias("input_ids"))


@query("str6_stream_head_split", """
SELECT doc_id, CASE WHEN i < 9 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i < 900""")
def str6(spark, sf):
    path, chk = scratch_path(spark, "str6"), scratch_path(spark, "str6-checkpoint")
    S.head_split_stream(doc_stream(spark, sf, max_files=100).select("doc_id"), path, chk, 900, 0.01, "doc_id")
    return spark.read.parquet(f"{path}/rows").select("doc_id", "split")


@query("mix_streamed_pretraining", f"""
WITH {ids_cte(VOCAB)}, {_SPEC}, p AS (SELECT source, pow(weight, 2) / sum(pow(weight, 2)) OVER () AS prob FROM spec),
r AS (SELECT doc_id, lang AS source, {_LANE_SQL} AS lane,
  row_number() OVER (PARTITION BY {_LANE_SQL}, lang ORDER BY doc_id) - 1 AS e FROM documents),
spot AS (SELECT r.*, (e + 0.5) / prob AS spot FROM r JOIN p USING (source)),
ends AS (SELECT l.lane, p.source, (count(r.doc_id) + 0.5) / prob AS spot FROM (SELECT DISTINCT lane FROM r) l CROSS JOIN p
  LEFT JOIN r ON r.lane = l.lane AND r.source = p.source GROUP BY l.lane, p.source, prob),
stop AS (SELECT lane, min(struct_pack(spot := spot, source := source)) AS s FROM ends GROUP BY lane),
o AS (SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY spot, source) AS k FROM spot JOIN stop USING (lane)
  WHERE struct_pack(spot := spot, source := source) < s),
x AS (SELECT lane, id, row_number() OVER (PARTITION BY lane ORDER BY k, line_no, j) - 1 AS pos FROM ids JOIN o USING (doc_id))
SELECT lane, pos // {SEQ} AS seq_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
FROM x GROUP BY 1, 2 HAVING count(*) = {SEQ}""")
def mix_streamed_pretraining(spark, sf):
    """Live sources read, tokenised, mixed by temperature weights and packed, up to the first source that has no document left."""
    probs = {r["source"]: r["prob"] for r in M.temperature_weights(_lang_spec(spark, sf), 0.5).collect()}  # one row per source
    d = K.encode_lines(_placed_stream(spark, sf, ["lane", "source"]), doc_vocab(spark, sf))
    d = _drain(spark, S.pack_live(d, SEQ, probs, "source", hold=1_000_000), "mixed", LANES)
    return d.select("lane", "seq_id", F.array_join("input_ids", ",").alias("input_ids"))

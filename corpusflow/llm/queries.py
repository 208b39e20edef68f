"""The queries of this folder: ``opN_<name>`` with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from . import (alignment, best_fit, decontaminate, mixture, phrases, repair, secrets, simhash, suffixes, token_counts, topk,
               toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_dedup")
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
h AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
s AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS c
      FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) y ANTI JOIN h USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""


@query("op2_phrase_dedup", OP2_SQL)
def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.dedup_phrases(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_hits")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                                     limit=4096)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op5_topk", OP5_SQL)
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))

    def written(found):
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    return spans.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
x AS (SELECT page_id, octet_length(encode(p.h)) AS n, sha1(p.h) AS s, first FROM p JOIN f ON p.h = f.h)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(s, (5 * g + 1)::INT, 5))::BIGINT >> (15 - 5 * c)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM x"""


@query("op7_warc", OP7_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0).drop("url")


OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (k, n)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


@query("op8_decontamination", OP8_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      "contaminated")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.*, CASE q WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS w,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '|' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE / w AS stop FROM s),
b AS (
  SELECT *, coalesce(sum(source_size * 2.0::DOUBLE) OVER x, 0) AS stopped,
         sum(w) OVER () - coalesce(sum(w) OVER x, 0) AS open, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM c WINDOW x AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - stopped) / open AS level FROM b),
t AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, coalesce((SELECT level FROM l WHERE level <= stop ORDER BY stop, level LIMIT 1) * w,
               source_size * 2.0::DOUBLE)) AS target FROM l),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(u) / w, k.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (words // source_size) * size
             + greatest(0, least(size, words - (words // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM r"""


@query("op9_mixture", OP9_SQL)
def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
g AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
w AS (SELECT r, i, i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 AS gap FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
m AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(coalesce(gap, false)::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM w) GROUP BY r, run),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f FROM m),
a AS (SELECT p.r, count(*) AS k, sum(e - s) AS c, string_agg(substr(x, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS head, max(e) AS last
      FROM p JOIN d USING (r) GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(c, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a USING (r)"""


@query("op10_suffix_dedup", OP10_SQL)
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_substrings(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


# crc32 by its bits; the edits by the least (cost, audit) in front of each row and state, where the audit fixes the rows
OP12_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         ((4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))) % 20)::INT AS k
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE k <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM d),
f AS (
  SELECT *, left(role, 1) AS h, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || h NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
-- moves by up to three inserts: s (nothing), S (system), U (user), A (assistant)
ins AS (SELECT * FROM (VALUES ('s', 'U', 1, ['user:']), ('s', 'A', 2, ['user:', 'assistant:']), ('s', 'U', 3, ['user:', 'assistant:', 'user:']),
          ('S', 'U', 1, ['user:']), ('S', 'A', 2, ['user:', 'assistant:']), ('U', 'A', 1, ['assistant:']), ('U', 'U', 2, ['assistant:', 'user:']),
          ('A', 'U', 1, ['user:']), ('A', 'A', 2, ['user:', 'assistant:']), ('s', 's', 0, []::VARCHAR[]), ('S', 'S', 0, []::VARCHAR[]),
          ('U', 'U', 0, []::VARCHAR[]), ('A', 'A', 0, []::VARCHAR[])) v(a, b, m, more)),
p AS (
  SELECT conv_id, 0::BIGINT AS i, 's' AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS out FROM n
  UNION ALL
  SELECT conv_id, i, st, x.cost, x.audit, x.out FROM (
    SELECT conv_id, i, st, min(struct_pack(cost := cost, audit := audit, out := out)) AS x FROM (
      SELECT p.conv_id, f.i, e.st, p.cost + 3 * ins.m + e.c + CASE WHEN f.fault = 'truncated' AND e.e <> 'D' THEN 3 ELSE 0 END AS cost,
             p.audit || repeat('I', ins.m) || e.e AS audit, p.out || ins.more || e.o AS out
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins ON ins.a = p.st,
      LATERAL (SELECT * FROM (VALUES
        ('D', 4, ins.b, []::VARCHAR[], true),
        ('K', 0, CASE f.h WHEN 's' THEN 'S' WHEN 'u' THEN 'U' ELSE 'A' END, [f.role || ':' || f.text],
         f.fault NOT IN ('blank', 'duplicate') AND ((f.h = 's' AND ins.b = 's') OR (f.h = 'u' AND ins.b <> 'U') OR (f.h = 'a' AND ins.b = 'U'))),
        ('R', 3, CASE ins.b WHEN 'U' THEN 'A' ELSE 'U' END, [CASE ins.b WHEN 'U' THEN 'assistant:' ELSE 'user:' END || f.text],
         f.fault NOT IN ('blank', 'duplicate'))) w(e, c, st, o, ok) WHERE ok) e)
    GROUP BY conv_id, i, st)),
z AS (
  SELECT p.conv_id, min(struct_pack(cost := cost + 3 * ins.m, audit := audit || repeat('I', ins.m), out := out || ins.more)) AS x
  FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN ins ON ins.a = p.st AND ins.b IN ('s', 'A') GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.cost, 0)::BIGINT AS cost,
       coalesce(x.audit, '') AS audit, sha256(coalesce(array_to_string(x.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)

"""Dedup, sampling, splits, mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import text as T
from ..operators import mixing as M
from ..operators.index import row_index
from ..operators.tokens import clean_lines
from ..session import materialize
from ..sources import readers as R
from .chat_queries import A, S, U, _tmpl, firsts, instructions
from .registry import conversations, documents, query, table
from .sql import FIRSTS, lines_cte, strip


@query("ded1_dedup_exact", """
SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY sha1(lang || '||' || text) ORDER BY doc_id) AS r
FROM documents) WHERE r = 1""")
def ded1(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang", "text")
    return M.dedup_exact(d, ["lang", "text"], "doc_id").select("doc_id", "text")


def _hash(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"


@query("smp1_shuffle", f"""
SELECT doc_id, row_number() OVER (ORDER BY {_hash(42, 'doc_id')}, doc_id) - 1 AS pos FROM documents""")
def smp1(spark, sf):
    return M.shuffle_index(documents(spark, sf).select("doc_id"), 42, "doc_id")


@query("smp1_shuffle_rows", f"""
SELECT doc_id, text, row_number() OVER (ORDER BY {_hash(42, 'doc_id')}, doc_id) - 1 AS pos FROM documents""")
def smp1_rows(spark, sf):
    """The rows in shuffled order, stored as they come, with the place where each one stands."""
    d = M.shuffle_rows(documents(spark, sf).select("doc_id", "text"), 42, "doc_id")
    stored = materialize(d.withColumn("at", F.monotonically_increasing_id()), "shuffled")  # grows along the order of rows
    return row_index(stored, "at", "pos").select("doc_id", "text", "pos")


@query("smp2_sample_n", f"""
SELECT doc_id, text FROM documents ORDER BY {_hash(42, 'doc_id')}, doc_id LIMIT 100""")
def smp2(spark, sf):
    return M.sample_n(documents(spark, sf).select("doc_id", "text"), 100, 42, "doc_id")


@query("smp2_sample_by_blocks", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_hash(7, 'o_orderkey')}, o_orderkey LIMIT 12000""")
def smp2_large(spark, sf):
    return M.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 12_000, 7, "o_orderkey")


@query("smp3_block_shuffle", f"""
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
b AS (SELECT *, i // 128 AS block, count(*) OVER (PARTITION BY i // 128) = 128 AS whole FROM i)
SELECT doc_id, block, block * 128 + row_number() OVER (PARTITION BY block
  ORDER BY CASE WHEN whole THEN {_hash(42, 'doc_id')} ELSE lpad(CAST(i AS VARCHAR), 32, '0') END, doc_id) - 1 AS pos
FROM b""")
def smp3(spark, sf):
    return M.block_shuffle(documents(spark, sf).select("doc_id"), "doc_id", 42)


@query("smp4_cap_per_group", """
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
WHERE r <= 7""")
def smp4(spark, sf):
    return M.cap_per_group(documents(spark, sf).select("doc_id", "source"), "source", 7, "doc_id")


@query("smp4_cap_by_blocks", """
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r
FROM orders) WHERE r <= 1500""")
def smp4_large(spark, sf):
    return M.cap_per_group(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"),
                           "o_orderstatus", 1500, "o_orderkey")


@query("spl1_head_split", """
SELECT doc_id, CASE WHEN i < 9 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text,
             row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
WHERE i < 900 AND text <> ''""")
def spl1(spark, sf):
    d = documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"))
    return M.head_split(d, 900, 0.01, "doc_id").select("doc_id", "split")


@query("spl2_hash_split", f"""
SELECT doc_id, CASE WHEN CAST('0x' || substr({_hash(42, 'doc_id')}, 1, 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT)
  THEN 'test' ELSE 'train' END AS split FROM documents""")
def spl2(spark, sf):
    return M.hash_split(documents(spark, sf).select("doc_id"), 0.2, 42, "doc_id")


@query("spl2_exact_split", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_hash(42, 'doc_id')}, doc_id) <= ceil(0.2 * count(*) OVER ())
  THEN 'test' ELSE 'train' END AS split FROM documents""")
def spl2_exact(spark, sf):
    return M.exact_split(documents(spark, sf).select("doc_id"), 0.2, 42, "doc_id")


# ---- mixtures ------------------------------------------------------------------------

def _lang_spec(spark, sf):
    """Weights from the data: characters per language."""
    return (documents(spark, sf).groupBy(F.col("lang").alias("source"))
            .agg(F.sum("n_chars").cast("double").alias("weight")))


_SPEC = "spec AS (SELECT lang AS source, CAST(sum(n_chars) AS DOUBLE) AS weight FROM documents GROUP BY lang)"


@query("mix1_temperature_weights", f"""
WITH {_SPEC} SELECT source, weight, round(pow(weight, 2) / sum(pow(weight, 2)) OVER (), 8) AS sharp,
  round(weight / sum(weight) OVER (), 8) AS plain FROM spec""")
def mix1(spark, sf):
    d = _lang_spec(spark, sf)
    d = M.temperature_weights(d, 0.5).withColumnRenamed("prob", "sharp")
    d = M.temperature_weights(d, 0).withColumnRenamed("prob", "plain")
    return d.select("source", "weight", F.round("sharp", 8).alias("sharp"), F.round("plain", 8).alias("plain"))


MIX_CAPS = {"en": 400, "fr": 120, "de": 60, "es": 40}
MIX_FRACS = {"en": 0.55, "fr": 0.20, "de": 0.15, "es": 0.10}


@query("mix2_fraction_mix", f"""
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT lang, CAST(floor(sum(least(n, CASE lang WHEN 'en' THEN 400 WHEN 'fr' THEN 120 WHEN 'de' THEN 60 ELSE 40 END)) OVER ()
   * CAST(CASE lang WHEN 'en' THEN 0.55 WHEN 'fr' THEN 0.20 WHEN 'de' THEN 0.15 ELSE 0.10 END AS DOUBLE)) AS BIGINT) AS k FROM n)
SELECT d.doc_id, d.lang FROM (SELECT doc_id, lang,
   row_number() OVER (PARTITION BY lang ORDER BY {_hash(42, 'doc_id')}, doc_id) AS r FROM documents) d
JOIN q ON q.lang = d.lang WHERE d.r <= q.k""")
def mix2(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang")
    return M.fraction_mix(d, MIX_CAPS, MIX_FRACS, "doc_id", "lang")


@query("mix3_interleave", f"""
WITH {_SPEC}, p AS (SELECT source, weight / sum(weight) OVER () AS prob FROM spec),
c AS (SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT c.source, c.n, p.prob, max(ceil(c.n / p.prob)) OVER () AS total FROM c JOIN p USING (source)),
k AS (SELECT source, n, prob, greatest(CAST(round(total * prob) AS BIGINT), n) AS k FROM t),
r AS (SELECT doc_id, lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)
SELECT r.doc_id, r.source, e, round((e + 0.5) / k.prob, 4) AS at
FROM r JOIN k USING (source), unnest(range(r.i, k.k, k.n)) u(e)""")
def mix3(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("source"))
    probs = M.temperature_weights(_lang_spec(spark, sf), None)
    return M.interleave(d, probs, "doc_id").withColumn("at", F.round("at", 4))


@query("mix4_concat_sources", """
SELECT doc_id AS id, text, 'documents' AS src FROM documents
UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark
UNION ALL SELECT page_id, html, 'pages' FROM pages""")
def mix4(spark, sf):
    part = lambda t, k, x: table(spark, sf, t).select(F.col(k).alias("id"), F.col(x).alias("text"),
                                                      F.lit(t).alias("src"))
    return M.concat_sources(part("documents", "doc_id", "text"), part("benchmark", "item_id", "text"),
                            part("pages", "page_id", "html"))


@query("jn5_source_weights", f"""
WITH {_SPEC} SELECT doc_id, lang AS source, weight FROM documents JOIN spec ON documents.lang = spec.source""")
def jn5(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("source"))
    return M.attach_weights(d, _lang_spec(spark, sf))


_CLEAN = """length({c}) >= 16 AND length(prompt) + length(completion) BETWEEN 16 AND 4000
  AND CASE WHEN completion = '' THEN 0.0 ELSE length(regexp_replace(substr(completion, 1, 200), '[^\\x20-\\x7e]', '', 'g'))
    / CAST(length(substr(completion, 1, 200)) AS DOUBLE) END >= 0.7""".format(c=strip("completion"))


@query("mix_instruction_tables", f"""
WITH {FIRSTS}, raw AS (
  SELECT conv_id, -1 AS turn, 'chat' AS source,
    CASE WHEN u IS NULL THEN 'User:' || chr(10) || 'Assistant:' || chr(10)
         ELSE 'User: ' || {strip('u')} || chr(10) || 'Assistant:' || chr(10) END AS prompt,
    CASE WHEN a IS NULL THEN '' ELSE chr(10) || {strip('a')} END AS completion FROM firsts
  UNION ALL SELECT conv_id, -2, 'instruction', {_tmpl(strip(f"CASE WHEN {S} <> '' THEN s ELSE {U} END"))}, chr(10) || {strip(A)} FROM firsts
  UNION ALL SELECT conv_id, turn, 'flat',
    CASE WHEN role = 'assistant' THEN 'User:' || chr(10) || 'Assistant:' || chr(10)
         ELSE 'User: ' || {strip('text')} || chr(10) || 'Assistant:' || chr(10) END,
    CASE WHEN role = 'assistant' THEN chr(10) || {strip('text')} ELSE chr(10) END FROM conversations),
ok AS (SELECT * FROM raw WHERE {_CLEAN}),
n AS (SELECT source, count(*) AS n FROM ok GROUP BY source),
q AS (SELECT source, CAST(floor(sum(least(n, CASE source WHEN 'chat' THEN 150000 WHEN 'instruction' THEN 80000 ELSE 20000 END)) OVER ()
  * CAST(CASE source WHEN 'chat' THEN 0.6 WHEN 'instruction' THEN 0.25 ELSE 0.15 END AS DOUBLE)) AS BIGINT) AS k FROM n),
m AS (SELECT ok.*, md5('123|' || conv_id || '|' || turn) AS h FROM (SELECT *, row_number() OVER (PARTITION BY source
   ORDER BY {_hash(42, "conv_id || '|' || turn")}, conv_id, turn) AS r FROM ok) ok JOIN q USING (source) WHERE ok.r <= q.k)
SELECT conv_id, turn, prompt, completion FROM (SELECT *, row_number() OVER (
   PARTITION BY sha1(prompt || '||' || completion) ORDER BY h, conv_id, turn) AS first FROM m) WHERE first = 1""")
def mix_instruction_tables(spark, sf):
    """The instruction mix end to end: three sources, the third with a fallback; format, clean, quota, shuffle, dedup."""
    row = lambda d, turn, name, pair: d.select("conv_id", turn.cast("bigint").alias("turn"), F.lit(name).alias("source"),
                                               pair.alias("p"))
    chat = row(firsts(spark, sf), F.lit(-1), "chat", C.chat_pair_or_empty())
    asked = C.instruction_or_prompt_pair("input", "instruction", F.lit(None).cast("string"), "response")
    instr = row(instructions(spark, sf), F.lit(-2), "instruction", asked)
    messages = R.first_loadable(lambda: table(spark, sf, "messages"), lambda: conversations(spark, sf))
    flat = row(messages, F.col("turn"), "flat", C.flat_message_pair())
    key = ["conv_id", "turn"]
    d = M.concat_sources(chat, instr, flat).select(*key, "source", "p.*").filter(T.clean_pair("prompt", "completion"))
    d = M.fraction_mix(d, {"chat": 150_000, "instruction": 80_000, "flat": 20_000}, {"chat": 0.6, "instruction": 0.25, "flat": 0.15}, key)
    d = d.withColumn("__o", M.hash_key(123, *key))
    return M.dedup_exact(d, ["prompt", "completion"], ["__o", *key]).select(*key, "prompt", "completion")


# ---- heads and catalogs -----------------------------------------------------------------

@query("src9_source_counts", """
SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark
UNION ALL SELECT 'labels', count(*) FROM labels""")
def src9(spark, sf):
    return R.source_counts({t: table(spark, sf, t) for t in
                            ("documents", "conversations", "pages", "benchmark", "labels")})


@query("src10_head_nonblank", f"""
WITH {lines_cte()} SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, line FROM dlines
WHERE {strip('line')} <> '' ORDER BY doc_id, line_no LIMIT 512""")
def src10(spark, sf):
    d = clean_lines(documents(spark, sf)).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")
    return R.head_nonblank(d, 512, ["doc_id", "line_no"], "line")

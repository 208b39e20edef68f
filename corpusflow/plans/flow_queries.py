"""Flows that a user runs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import flows
from ..operators import ngrams as N
from ..operators import packing as P
from ..operators import tokens as K
from ..session import scratch_path
from .eval_queries import _BENCH, _BIGRAMS_LANG, _IDS_LANG, _LOGP, _MODELS_SQL, MODELS, bench_ids, lang_bigrams
from .mix_queries import _SPEC, _lang_spec
from .registry import documents, query
from .text_queries import _BUCKET_SQL, _PATH_SQL, _doc_path
from .token_queries import _IDS, SEQ, VOCAB, _mask_sql, _str, doc_vocab, masked_rows


@query("mix_packed_pretraining", f"""
WITH {_IDS}, {_SPEC}, p AS (SELECT source, weight / sum(weight) OVER () AS prob FROM spec),
c AS (SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT c.source, c.n, p.prob, max(ceil(c.n / p.prob)) OVER () AS total FROM c JOIN p USING (source)),
k AS (SELECT source, n, prob, greatest(CAST(round(total * prob) AS BIGINT), n) AS k FROM t),
r AS (SELECT doc_id, lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
e AS (SELECT r.doc_id, r.source, e, round((e + 0.5) / k.prob, 6) AS spot FROM r JOIN k USING (source), unnest(range(r.i, k.k, k.n)) u(e)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY spot, source, e) - 1 AS i FROM e),
b AS (SELECT *, i // 128 AS block, count(*) OVER (PARTITION BY i // 128) = 128 AS whole FROM o),
s AS (SELECT doc_id, row_number() OVER (ORDER BY block, CASE WHEN whole THEN md5('42|' || i)
        ELSE lpad(CAST(i AS VARCHAR), 32, '0') END, i) AS place FROM b),
x AS (SELECT id, row_number() OVER (ORDER BY place, line_no, j) - 1 AS pos FROM ids JOIN s USING (doc_id))
SELECT pos // {SEQ} AS seq_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
FROM x GROUP BY 1 HAVING count(*) = {SEQ}""")
def mix_packed_pretraining(spark, sf):
    """Mixture manifest to packed training rows: the languages are written as sources and read back."""
    root = scratch_path(spark, "mixture")
    d = documents(spark, sf).select("doc_id", "text", F.col("lang").alias("source"))
    d.write.partitionBy("source").parquet(f"{root}/rows")
    (_lang_spec(spark, sf).select("source", F.lit("parquet").alias("type"),
                                  F.concat(F.lit(f"{root}/rows/source="), "source").alias("path"), "weight",
                                  F.lit(1.0).alias("temperature"))
     .coalesce(1).write.json(f"{root}/manifest"))
    d = flows.packed_mixture(spark, f"{root}/manifest", doc_vocab(spark, sf), SEQ, 42, "doc_id", 1.0)
    return d.select("seq_id", _str("input_ids").alias("input_ids"))


@query("eval_completion_loss", f"""
WITH m AS ({_mask_sql(2)}), {_IDS_LANG}, {_BIGRAMS_LANG},
z AS (SELECT conv_id, j, CAST(string_split(input_ids, ',')[j] AS INT) AS tok,
        CASE WHEN j = 1 THEN 1 ELSE CAST(string_split(input_ids, ',')[j - 1] AS INT) END AS ctx
      FROM m, unnest(range(1, len(string_split(labels, ',')) + 1)) u(j)
      WHERE supervised > 0 AND string_split(labels, ',')[j] <> '-100'),
l AS (SELECT model, count(*) AS n_tok, sum(-{_LOGP}) / count(*) AS loss FROM (SELECT * FROM z, {_MODELS_SQL}) y
  LEFT JOIN bg USING (model, ctx, tok) LEFT JOIN cx USING (model, ctx) GROUP BY model)
SELECT model, n_tok, round(loss, 5) AS loss, round(exp(loss), 3) AS ppl, row_number() OVER (ORDER BY loss, model) AS rank FROM l""")
def eval_completion_loss(spark, sf):
    """First exchanges, masked prompts, loss over the supervised labels, models ranked."""
    d = masked_rows(spark, sf).withColumn("sup", P.supervised_tokens("labels")).filter("sup > 0")
    first = F.array_position(F.transform("labels", lambda x: x != K.IGNORE), True) - 1
    t = N.transitions(d.select("conv_id", first.alias("first"), "sup", "input_ids"), ["conv_id", "first", "sup"], "input_ids")
    t = t.filter((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("sup")))
    sc = N.score_tokens(N.with_models(t, list(MODELS)), lang_bigrams(spark, sf, doc_vocab(spark, sf)), VOCAB, key=["conv_id"], group=["model"])
    rows = N.seq_logprob(sc, ["model", "conv_id"]).withColumn("nll", -F.col("logp"))
    d = E.leaderboard_loss(E.ppl_completion(rows, group=["model"]))
    return d.select("model", "n_tok", F.round("loss", 5).alias("loss"), F.round("ppl", 3).alias("ppl"), F.col("rank").cast("bigint").alias("rank"))


EVAL_SEQ = 64


@query("eval_packed_text", f"""
WITH {_IDS_LANG}, {_BIGRAMS_LANG}, {_BENCH},
q AS (SELECT tok, row_number() OVER (ORDER BY item_id, pos) - 1 AS p FROM bt),
w AS (SELECT p // {EVAL_SEQ} AS seq, p, tok, count(*) OVER (PARTITION BY p // {EVAL_SEQ}) AS c FROM q),
z AS (SELECT seq, tok, coalesce(lag(tok) OVER (PARTITION BY seq ORDER BY p), 1) AS ctx FROM w WHERE c = {EVAL_SEQ}),
s AS (SELECT model, seq, sum(-{_LOGP}) / count(*) AS loss FROM (SELECT * FROM z, {_MODELS_SQL}) y
  LEFT JOIN bg USING (model, ctx, tok) LEFT JOIN cx USING (model, ctx) GROUP BY model, seq),
l AS (SELECT model, count(*) AS n, exp(avg(loss)) AS ppl FROM s GROUP BY model)
SELECT model, n, round(ppl, 3) AS ppl, row_number() OVER (ORDER BY ppl, model) AS rank FROM l""")
def eval_packed_text(spark, sf):
    """Held-out text grouped to fixed length, loss per sequence, models ranked with their number of sequences."""
    v = doc_vocab(spark, sf)
    seqs = P.pack(bench_ids(spark, sf, v), EVAL_SEQ, "item_id")
    t = N.with_models(N.transitions(seqs, ["seq_id"], "input_ids"), list(MODELS))
    sc = N.score_tokens(t, lang_bigrams(spark, sf, v), VOCAB, key=["seq_id"], group=["model"])
    rows = N.seq_logprob(sc, ["model", "seq_id"]).withColumn("loss", -F.col("logp") / F.col("n_tok"))
    d = E.leaderboard_ppl(E.ppl_unweighted(rows, group=["model"]))
    return d.select("model", "n", F.round("ppl", 3).alias("ppl"), F.col("rank").cast("bigint").alias("rank"))


@query("flow_build_corpus", f"""
SELECT source, least(n, 60) AS n, false AS newline_separated, true AS found FROM (
  SELECT {_BUCKET_SQL} AS source, count(*) AS n FROM (SELECT {_PATH_SQL} AS path FROM documents WHERE trim(text) <> '') GROUP BY 1)""")
def flow_build_corpus(spark, sf):
    """Files of two types to capped buckets and a manifest whose files are there."""
    m, back = _built_corpus(spark, sf, 60)
    back = back.groupBy("bucket").agg(F.count("*").alias("k"))
    return m.join(back, (F.col("source") == F.col("bucket")) & (F.col("n") == F.col("k")), "left").select(
        "source", "n", "newline_separated", F.col("k").isNotNull().alias("found"))


_PART_SQL = ", ".join(f"sum(CAST('0x' || substr(md5(text), {i}, 8) AS BIGINT))::BIGINT AS digest_{k}" for k, i in enumerate((1, 9)))


@query("flow_build_corpus_whole", f"""
SELECT source, count(*) AS n, count(*) AS n_read, {_PART_SQL} FROM (
  SELECT {_BUCKET_SQL} AS source, text FROM (SELECT {_PATH_SQL} AS path, text FROM documents WHERE trim(text) <> '')) GROUP BY 1""")
def flow_build_corpus_whole(spark, sf):
    """Files of two types to whole buckets: rows by the manifest and as read back, with sums of digests of their texts."""
    m, back = _built_corpus(spark, sf, 0)
    line = F.col("text").startswith('{"text":')  # half of the documents are lines of text files, in JSON
    back = back.withColumn("text", F.when(line, F.from_json("text", "text string")["text"]).otherwise(F.col("text")))
    part = lambda k, i: F.sum(F.conv(F.substring(F.md5("text"), i, 8), 16, 10).cast("bigint")).alias(f"digest_{k}")
    back = back.groupBy("bucket").agg(F.count("*").alias("n_read"), part(0, 1), part(1, 9))
    return m.join(back, F.col("source") == F.col("bucket"), "left").select("source", "n", "n_read", "digest_0", "digest_1")


def _built_corpus(spark, sf, cap):
    """Manifest and rows of the corpus built from documents written as Parquet and as text files of JSON lines."""
    root, out = scratch_path(spark, "corpus-in"), scratch_path(spark, "corpus-out")
    d = documents(spark, sf).select(_doc_path().alias("path"), F.to_json(F.struct("text")).alias("json"), "text", "doc_id")
    d = d.withColumn("folder", F.regexp_replace(F.regexp_replace("path", "[^a-zA-Z0-9_-]+", "-"), "^-", ""))
    d.where("doc_id % 2 = 0").select("folder", "text").write.partitionBy("folder").parquet(f"{root}/a")
    d.where("doc_id % 2 = 1").select("folder", F.col("json").alias("value")).write.partitionBy("folder").text(f"{root}/b")
    return flows.build_corpus(spark, [f"{root}/a", f"{root}/b", f"{root}/none"], out, cap), spark.read.parquet(out)


@query("flow_build_mix_pack", f"""
WITH {_IDS}, dx AS (SELECT doc_id, text, {_BUCKET_SQL} AS source FROM (SELECT doc_id, text, {_PATH_SQL} AS path FROM documents WHERE trim(text) <> '')),
c AS (SELECT source, count(*) AS n FROM dx GROUP BY source),
w AS (SELECT c.*, pow(CASE source WHEN 'fineweb' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END, 2) AS w FROM c WHERE source <> 'misc'),
p AS (SELECT source, n, w / sum(w) OVER () AS prob FROM w),
t AS (SELECT *, max(ceil(n / prob)) OVER () AS total FROM p),
k AS (SELECT source, n, prob, greatest(CAST(round(total * prob) AS BIGINT), n) AS k FROM t),
y AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) - 1 AS copy FROM dx),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || text || '|' || copy), text, copy) - 1 AS i FROM y),
e AS (SELECT r.doc_id, r.source, e, round((e + 0.5) / k.prob, 6) AS spot FROM r JOIN k USING (source), unnest(range(r.i, k.k, k.n)) u(e)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY spot, source, e) - 1 AS i FROM e),
b AS (SELECT *, i // 128 AS block, count(*) OVER (PARTITION BY i // 128) = 128 AS whole FROM o),
s AS (SELECT doc_id, row_number() OVER (ORDER BY block, CASE WHEN whole THEN md5('42|' || i)
        ELSE lpad(CAST(i AS VARCHAR), 32, '0') END, i) AS place FROM b),
x AS (SELECT id, row_number() OVER (ORDER BY place, line_no, j) - 1 AS pos FROM ids JOIN s USING (doc_id))
SELECT pos // {SEQ} AS seq_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
FROM x GROUP BY 1 HAVING count(*) = {SEQ}""")
def flow_build_mix_pack(spark, sf):
    """Files of three schemas to buckets, their manifest to the mixture, the mixture to packed rows."""
    root, out = scratch_path(spark, "corpus-in"), scratch_path(spark, "corpus-out")
    d = documents(spark, sf).select(_doc_path().alias("path"), "text", "doc_id")
    d = d.withColumn("folder", F.regexp_replace(F.regexp_replace("path", "[^a-zA-Z0-9_-]+", "-"), "^-", ""))
    # three schemas below one root, the text under another name in each
    d.where("doc_id % 3 = 0").select("folder", "text").write.partitionBy("folder").parquet(f"{root}/a")
    d.where("doc_id % 3 = 1").select("folder", F.col("doc_id").alias("id"), F.col("text").alias("Content")).write.partitionBy("folder").parquet(f"{root}/a/more")
    d.where("doc_id % 3 = 2").select("folder", F.lit(1).alias("n"), F.col("text").alias("BODY")).write.partitionBy("folder").parquet(f"{root}/b")
    flows.build_corpus(spark, [root], out, 0)
    d = flows.packed_mixture(spark, f"{out}.manifest", doc_vocab(spark, sf), SEQ, 42, "doc_no", 0.5)
    return d.select("seq_id", _str("input_ids").alias("input_ids"))

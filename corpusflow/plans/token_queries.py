"""Vocabulary, encoding, packing, collation and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions.text import text_or_empty, words
from ..operators import bpe, diagnostics as D
from ..operators import packing as P
from ..operators import tokens as K
from ..operators import unigram
from ..session import materialize
from .chat_queries import instructions
from .registry import documents, query
from .sql import FIRSTS, NL, ids_cte, joined, lines_cte, strip, tokens_cte, vocab_cte, words as sql_words

VOCAB = 4000
SEQ = 128


def texts(spark, sf):
    return documents(spark, sf).select("doc_id", "text")


def doc_vocab(spark, sf, size: int = VOCAB, **kw) -> K.Vocab:
    return K.Vocab(K.build_vocab(K.word_counts(texts(spark, sf)), size), **kw)


def encoded_docs(spark, sf, vocab=None, **kw):
    return K.encode_lines(texts(spark, sf), vocab or doc_vocab(spark, sf), **kw).drop("text")


def packed_docs(spark, sf, seq_len: int = SEQ):
    return P.pack(encoded_docs(spark, sf), seq_len, "doc_id", n_tok="n_tok")


def training_docs(spark, sf, seq_len: int = SEQ):
    return P.pack_training(encoded_docs(spark, sf), seq_len, "doc_id", 42, n_tok="n_tok")


def _str(c):
    return F.array_join(c, ",")


# ---- vocabulary --------------------------------------------------------------------

@query("tok1_tokenizer_sample", f"""
WITH {lines_cte()} SELECT doc_id, line_no - 1 AS line_no, {strip('line')} AS line FROM dlines
WHERE {strip('line')} <> '' ORDER BY md5('42|' || doc_id || '|' || (line_no - 1)), doc_id, line_no LIMIT 20000""")
def tok1(spark, sf):
    return K.tokenizer_sample(texts(spark, sf), 20_000)


@query("tok2_char_coverage", """
WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
           WHERE ch NOT IN ('', ' ', chr(10)) GROUP BY ch),
r AS (SELECT ch, n, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n DESC, ch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT ch, n FROM r WHERE before = 0 OR before < 0.9995 * total""")
def tok2(spark, sf):
    return K.char_coverage(texts(spark, sf))


@query("tok3_word_counts", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS token FROM documents) GROUP BY token""")
def tok3(spark, sf):
    return K.word_counts(texts(spark, sf))


@query("tok4_vocab", f"WITH {vocab_cte(VOCAB)} SELECT token, n, CAST(id AS INT) AS id FROM vocab")
def tok4(spark, sf):
    return K.build_vocab(K.word_counts(texts(spark, sf)), VOCAB)


MERGES = 40


def _merges_sql() -> str:
    """One step per merge: ``p1 … pk`` the best pair of each, ``t0 … tk`` word types with their symbols between line breaks."""
    both = f"{NL} || {NL}"
    steps = [f"""t0 AS (SELECT token, n, {NL} || array_to_string(list_prepend('{bpe.WORD_START}',
    list_filter(string_split(token, ''), lambda c: c <> '')), {both}) || {NL} AS sy
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS token FROM documents) GROUP BY token))"""]
    for k in range(1, MERGES + 1):
        steps.append(f"""p{k} AS MATERIALIZED (SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT n, unnest(s[:-2]) AS a, unnest(s[2:]) AS b
  FROM (SELECT n, string_split(trim(sy, {NL}), {both}) AS s FROM t{k - 1}) x) y GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1),
t{k} AS MATERIALIZED (SELECT token, t.n, replace(sy, {NL} || a || {both} || b || {NL}, {NL} || a || b || {NL}) AS sy FROM t{k - 1} t, p{k})""")
    return ",\n".join(steps)


_MERGES = _merges_sql()
_MERGE_ROWS = " UNION ALL ".join(f"SELECT {k - 1} AS rank, a, b, n FROM p{k}" for k in range(1, MERGES + 1))


@query("tok5_learn_bpe", f"WITH {_MERGES} {_MERGE_ROWS}")
def tok5(spark, sf):
    got = bpe.learn_bpe(K.word_counts(texts(spark, sf)), MERGES)
    return spark.createDataFrame([(i, a, b, n) for i, (a, b, n) in enumerate(got)],
                                 "rank int, a string, b string, n bigint")


# ---- encoding ----------------------------------------------------------------------

@query("tok6_encode_words", f"""
WITH {vocab_cte(VOCAB)}, w AS (SELECT doc_id, j, ws[j] AS tok FROM
  (SELECT doc_id, {sql_words('text')} AS ws FROM documents) d, unnest(range(1, len(ws) + 1)) u(j))
SELECT doc_id, string_agg(CAST(coalesce(id, 0) AS VARCHAR), ',' ORDER BY j) AS ids
FROM w LEFT JOIN vocab ON tok = token GROUP BY doc_id""")
def tok6(spark, sf):
    d = K.encode_text(texts(spark, sf), doc_vocab(spark, sf))
    return d.select("doc_id", _str("ids").alias("ids"))


@query("tok6_byte_fallback", f"""
WITH {vocab_cte(VOCAB)}, w AS (SELECT doc_id, j, ws[j] AS tok FROM
  (SELECT doc_id, {sql_words('text')} AS ws FROM documents) d, unnest(range(1, len(ws) + 1)) u(j)),
p AS (SELECT doc_id, j, id, hex(encode(tok)) AS h FROM w LEFT JOIN vocab ON tok = token)
SELECT doc_id, string_agg(CASE WHEN id IS NOT NULL THEN CAST(id AS VARCHAR) ELSE
  array_to_string(list_transform(range(0, length(h) // 2), lambda k:
    CAST('0x' || substr(h, 2 * k + 1, 2) AS INT) + {VOCAB}), ',') END, ',' ORDER BY j) AS ids
FROM p GROUP BY doc_id""")
def tok6_bytes(spark, sf):
    d = K.encode_text(texts(spark, sf), doc_vocab(spark, sf, first_byte=VOCAB))
    return d.select("doc_id", _str("ids").alias("ids"))


def bpe_model(spark, sf):
    d = texts(spark, sf)
    chars = [r.ch for r in K.char_coverage(d).orderBy(F.desc("n"), "ch").collect()]
    return bpe.BpeModel(spark, chars, bpe.learn_bpe(K.word_counts(d), MERGES))


# ids of each word type: pieces in order of mark, characters, merges; bytes for what is no piece
_BPE_WORDS = f"""{_MERGES}, m AS ({_MERGE_ROWS}),
ch AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch NOT IN ('', ' ', chr(10)) GROUP BY ch),
cr AS (SELECT ch, n, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ch),
pl AS (SELECT '{bpe.WORD_START}' AS p, 0 AS k UNION ALL
  SELECT ch, row_number() OVER (ORDER BY n DESC, ch) FROM cr WHERE before = 0 OR before < 0.9995 * total UNION ALL SELECT a || b, 10000000 + rank FROM m),
pid AS (SELECT p, row_number() OVER (ORDER BY min(k)) - 1 + {bpe.FIRST_PIECE} AS id FROM pl GROUP BY p),
ps AS (SELECT token, unnest(s) AS p, unnest(range(1, len(s) + 1)) AS i FROM (SELECT token, string_split(trim(sy, {NL}), {NL} || {NL}) AS s FROM t{MERGES})),
px AS (SELECT token, i, id, hex(encode(ps.p)) AS h FROM ps LEFT JOIN pid USING (p)),
wid AS (SELECT token, string_agg(CASE WHEN id IS NOT NULL THEN CAST(id AS VARCHAR) ELSE array_to_string(list_transform(range(0, length(h) // 2),
    lambda q: CAST('0x' || substr(h, 2 * q + 1, 2) AS INT) + {bpe.FIRST_BYTE}), ',') END, ',' ORDER BY i) AS ids FROM px GROUP BY token)"""


@query("tok6_encode_bpe", f"""
WITH {_BPE_WORDS}, w AS (SELECT doc_id, j, ws[j] AS token FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents) d, unnest(range(1, len(ws) + 1)) u(j))
SELECT doc_id, string_agg(ids, ',' ORDER BY j) AS ids FROM w JOIN wid USING (token) GROUP BY doc_id""")
def tok6_bpe(spark, sf):
    d = K.encode_text(texts(spark, sf), bpe_model(spark, sf))
    return d.select("doc_id", _str("ids").alias("ids"))


# ---- likelihood pieces ---------------------------------------------------------------

PIECES = 1000


def unigram_model(spark, sf) -> unigram.Unigram:
    return unigram.learn_unigram(K.word_counts(texts(spark, sf)), PIECES)


@query("tok5_learn_unigram")
def tok5_unigram(spark, sf):
    """Pieces and scores from all documents; the likelihood after each round is tested against brute force."""
    d = unigram.pieces_table(spark, unigram_model(spark, sf))
    return d.select("id", "piece", F.round("score", 9).alias("score"))


@query("tok6_encode_unigram")
def tok6_unigram(spark, sf):
    d = K.encode_text(texts(spark, sf), unigram.UnigramModel(spark, unigram_model(spark, sf)))
    return d.select("doc_id", _str("ids").alias("ids"))


_IDS = ids_cte(VOCAB)


@query("tok7_line_eos", f"""
WITH {_IDS} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY line_no, j) AS ids,
  count(*) AS n_tok FROM ids GROUP BY doc_id""")
def tok7(spark, sf):
    return encoded_docs(spark, sf).select("doc_id", _str("ids").alias("ids"), F.col("n_tok").cast("bigint").alias("n_tok"))


@query("tok7_with_eos", f"""
WITH {vocab_cte(VOCAB)}, w AS (SELECT doc_id, j, ws[j] AS tok FROM
  (SELECT doc_id, {sql_words('text')} AS ws FROM documents) d, unnest(range(1, len(ws) + 1)) u(j))
SELECT doc_id, string_agg(CAST(coalesce(id, 0) AS VARCHAR), ',' ORDER BY j) || ',2' AS ids
FROM w LEFT JOIN vocab ON tok = token GROUP BY doc_id""")
def tok7_eos(spark, sf):
    d = K.encode_text(texts(spark, sf), doc_vocab(spark, sf))
    return d.select("doc_id", _str(K.with_eos("ids")).alias("ids"))


NEWLINE_ID = 9


@query("tok8_with_newline", f"""
WITH {vocab_cte(VOCAB)}, src AS (SELECT doc_id, replace(text, '. ', '.' || {NL} || '  ' || {NL}) AS text FROM documents),
{lines_cte('src')},
w AS (SELECT doc_id, line_no, list_append({sql_words('line')}, {NL}) AS ws FROM dlines WHERE line <> ''),
t AS (SELECT doc_id, line_no, j, ws[j] AS tok FROM w, unnest(range(1, len(ws) + 1)) u(j))
SELECT doc_id, string_agg(CAST(CASE WHEN tok = {NL} THEN {NEWLINE_ID} ELSE coalesce(id, 0) END AS VARCHAR), ','
  ORDER BY line_no, j) AS ids FROM t LEFT JOIN vocab ON tok = token GROUP BY doc_id""")
def tok8(spark, sf):
    # the documents hold no white-space-only lines, so some are put in
    src = texts(spark, sf).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n  \n")).alias("text"))
    d = K.encode_lines(src, doc_vocab(spark, sf), line_end=NEWLINE_ID, keep_blank=True)
    return d.select("doc_id", _str("ids").alias("ids"))


@query("tok9_token_len", f"""
WITH {FIRSTS} SELECT round(avg(len({sql_words("coalesce(u, '')")})), 6) AS user_tokens,
  round(avg(len({sql_words("coalesce(a, '')")})), 6) AS answer_tokens FROM firsts""")
def tok9(spark, sf):
    d = instructions(spark, sf).select(words("instruction").alias("u"), words("output").alias("a"))
    d = K.mean_lengths(d, {"user_tokens": "u", "answer_tokens": "a"})
    return d.select(F.round("user_tokens", 6).alias("user_tokens"), F.round("answer_tokens", 6).alias("answer_tokens"))


def _pad(x: str, n: str, pad: str) -> str:
    return f"list_concat({x}, list_transform(range(0, greatest({n} - len({x}), 0)), lambda q: {pad}))"


_DOC_IDS = f"""{_IDS}, docs AS (SELECT doc_id, list(CAST(id AS INT) ORDER BY line_no, j) AS ids FROM ids GROUP BY doc_id)"""


@query("tok10_padded", f"""
WITH {_DOC_IDS}, c AS (SELECT doc_id, list_slice(ids, 1, 128) AS x FROM docs)
SELECT doc_id, {joined(_pad('x', '128', '2'))} AS input_ids, {joined(_pad('x', '128', '2'))} AS labels,
  {joined(_pad("list_transform(x, lambda q: 1)", '128', '0'))} AS attention_mask FROM c""")
def tok10(spark, sf):
    d = K.padded_with_labels(encoded_docs(spark, sf).select("doc_id", "ids"), max_length=128)
    return d.select("doc_id", *[_str(c).alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query("fmt18_keep_right", f"""
WITH {_DOC_IDS} SELECT doc_id, {joined("list_slice(ids, greatest(len(ids) - 72, 0) + 1, len(ids))")} AS ids FROM docs""")
def fmt18(spark, sf):
    return encoded_docs(spark, sf).select("doc_id", _str(K.keep_right("ids", 200, 128)).alias("ids"))


@query("jn4_token_ids", f"""
WITH {vocab_cte(VOCAB)}, w AS (SELECT lang, unnest({sql_words('text')}) AS tok FROM documents)
SELECT lang, tok, CAST(coalesce(max(id), 0) AS INT) AS id, count(*) AS n
FROM w LEFT JOIN vocab ON tok = token GROUP BY lang, tok""")
def jn4(spark, sf):
    """Lookup as a join, after counting: one row per language and word type."""
    types = (documents(spark, sf).select("lang", F.explode(words(text_or_empty("text"))).alias("tok"))
             .groupBy("lang", "tok").agg(F.count("*").alias("n")))
    vocab = K.build_vocab(K.word_counts(texts(spark, sf)), VOCAB)  # at most VOCAB rows
    d = types.join(F.broadcast(vocab.select(F.col("token").alias("tok"), "id")), "tok", "left")
    return d.select("lang", "tok", F.coalesce("id", F.lit(K.UNK)).alias("id"), "n")


# ---- packing -----------------------------------------------------------------------

_PACKED = f"""{_IDS}, packed AS (SELECT pos // {SEQ} AS seq_id, list(CAST(id AS INT) ORDER BY pos) AS input_ids
  FROM ids GROUP BY 1 HAVING count(*) = {SEQ})"""


@query("pck1_pack", f"WITH {_PACKED} SELECT seq_id, {joined('input_ids')} AS input_ids FROM packed")
def pck1(spark, sf):
    return packed_docs(spark, sf).select("seq_id", _str("input_ids").alias("input_ids"))


@query("pck1_pack_bpe", f"""
WITH {_BPE_WORDS}, {tokens_cte()},
li AS (SELECT doc_id, line_no, j, CASE WHEN tok = {NL} THEN '2' ELSE ids END AS ids FROM toks LEFT JOIN wid ON tok = token),
one AS (SELECT unnest(string_split(ids, ',')) AS id, unnest(range(1, len(string_split(ids, ',')) + 1)) AS i, doc_id, line_no, j FROM li),
pos AS (SELECT id, row_number() OVER (ORDER BY doc_id, line_no, j, i) - 1 AS pos FROM one)
SELECT pos // {SEQ} AS seq_id, string_agg(id, ',' ORDER BY pos) AS input_ids FROM pos GROUP BY 1 HAVING count(*) = {SEQ}""")
def pck1_bpe(spark, sf):
    """Subword ids are stored once, then packed: length and content come from one pass."""
    ids = K.encode_lines(texts(spark, sf), bpe_model(spark, sf)).select("doc_id", "ids")
    stored = materialize(ids, "subword-ids")
    return P.pack(stored, SEQ, "doc_id").select("seq_id", _str("input_ids").alias("input_ids"))


@query("pck2_pack_sharded", f"""
WITH {_PACKED} SELECT seq_id // 100 AS shard, count(*) AS n, min(seq_id) AS first_seq, max(seq_id) AS last_seq
FROM packed GROUP BY 1""")
def pck2(spark, sf):
    d = P.with_shard(packed_docs(spark, sf), 100)
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.min("seq_id").alias("first_seq"),
                                  F.max("seq_id").alias("last_seq"))


@query("pck3_pack_by_batch", f"""
WITH {vocab_cte(VOCAB)}, d AS (SELECT doc_id, {sql_words('text')} AS ws, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch
  FROM documents),
w AS (SELECT doc_id, batch, j, ws[j] AS tok FROM d, unnest(range(1, len(ws) + 1)) u(j)),
i AS (SELECT batch, coalesce(id, 0) AS id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, j) - 1 AS pos
  FROM w LEFT JOIN vocab ON tok = token)
SELECT batch, pos // {SEQ} AS seq_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
FROM i GROUP BY 1, 2 HAVING count(*) = {SEQ}""")
def pck3(spark, sf):
    d = K.encode_text(texts(spark, sf), doc_vocab(spark, sf))
    return P.pack_by_batch(d, SEQ, "doc_id", batch_rows=50).withColumn("input_ids", _str("input_ids"))


@query("pck4_pack_training", f"""
WITH {_IDS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT DISTINCT doc_id FROM ids)),
b AS (SELECT *, i // 128 AS block, count(*) OVER (PARTITION BY i // 128) = 128 AS whole FROM o),
s AS (SELECT doc_id, row_number() OVER (ORDER BY block, CASE WHEN whole THEN md5('42|' || doc_id)
        ELSE lpad(CAST(i AS VARCHAR), 32, '0') END, doc_id) AS place FROM b),
p AS (SELECT id, row_number() OVER (ORDER BY place, line_no, j) - 1 AS pos FROM ids JOIN s USING (doc_id)),
q AS (SELECT pos // {SEQ} AS seq_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
      FROM p GROUP BY 1 HAVING count(*) = {SEQ})
SELECT seq_id, input_ids, input_ids AS labels, CAST({SEQ} AS BIGINT) AS ones FROM q""")
def pck4(spark, sf):
    d = training_docs(spark, sf)
    ones = F.size(F.filter("attention_mask", lambda x: x == 1)).cast("bigint")
    return d.select("seq_id", _str("input_ids").alias("input_ids"), _str("labels").alias("labels"), ones.alias("ones"))


# ---- collation -----------------------------------------------------------------------

@query("col1_collate_fixed", f"""
WITH {_DOC_IDS}, c AS (SELECT doc_id, {_pad('x', '200', '0')} AS x FROM (SELECT doc_id, list_slice(ids, 1, 200) AS x FROM docs))
SELECT doc_id, {joined('x')} AS input_ids, {joined('x')} AS labels,
  {joined("list_transform(x, lambda q: CASE WHEN q <> 0 THEN 1 ELSE 0 END)")} AS attention_mask FROM c""")
def col1(spark, sf):
    d = P.collate_fixed(encoded_docs(spark, sf).select("doc_id", F.col("ids").alias("input_ids")), 200)
    return d.select("doc_id", *[_str(c).alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query("col2_collate_dynamic", f"""
WITH {_DOC_IDS}, b AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM docs),
c AS (SELECT doc_id, batch_id, {_pad('ids', 'm', '0')} AS x FROM
      (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM b))
SELECT doc_id, batch_id, {joined('x')} AS input_ids, {joined('x')} AS labels,
  {joined("list_transform(x, lambda q: CASE WHEN q <> 0 THEN 1 ELSE 0 END)")} AS attention_mask FROM c""")
def col2(spark, sf):
    d = encoded_docs(spark, sf).select("doc_id", F.col("ids").alias("input_ids"))
    d = P.collate_dynamic(P.with_batches(d, 16, "doc_id"))
    return d.select("doc_id", "batch_id", *[_str(c).alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query("col3_collate_packed", f"""
WITH {_PACKED} SELECT seq_id, {joined('input_ids')} AS input_ids, {joined('input_ids')} AS labels FROM packed""")
def col3(spark, sf):
    d = P.collate_packed(packed_docs(spark, sf))
    return d.select("seq_id", _str("input_ids").alias("input_ids"), _str("labels").alias("labels"))


# ---- masking ---------------------------------------------------------------------------

MASK_LEN, MASK_RESP, MASK_BATCH = 96, 32, 4


def masked_source(spark, sf, version: int):
    """Prompt and completion ids of first exchanges, in template v2 or v1."""
    d = instructions(spark, sf)
    u, a = text_or_empty("instruction"), text_or_empty("output")
    prompt = C.user_prompt(u) if version == 2 else F.concat(F.lit("User: "), u, F.lit("\nAssistant:"))
    answer = F.when(a != "", F.concat(F.lit("\n" if version == 2 else " "), a)).otherwise("")
    # the line break in front of an answer is a token of its own in template v2
    c_words = F.when(F.col("c").startswith("\n"), F.concat(F.array(F.lit(K.LINE_END)), words("c"))).otherwise(words("c"))
    v = doc_vocab(spark, sf)
    return (d.select("conv_id", prompt.alias("p"), answer.alias("c"))
            .select("conv_id", K.encode(words("p"), v).alias("p_ids"), K.encode(c_words, v).alias("c_ids")))


def _mask_sql(version: int) -> str:
    u, a = "coalesce(u, '')", "coalesce(a, '')"
    prompt = f"'User: ' || {u} || {NL} || 'Assistant:'" + (f" || {NL}" if version == 2 else "")
    lead = f"CASE WHEN {a} <> '' THEN [{NL}] ELSE [] END" if version == 2 else "[]"
    enc = lambda side: (f"(SELECT conv_id, list(CAST(CASE WHEN tok = {NL} THEN 2 ELSE coalesce(id, 0) END AS INT) ORDER BY j) AS x "
                        f"FROM (SELECT conv_id, j, {side}[j] AS tok FROM w, unnest(range(1, len({side}) + 1)) t(j)) "
                        "LEFT JOIN vocab ON tok = token GROUP BY conv_id)")
    return f"""
WITH {FIRSTS}, {vocab_cte(VOCAB)},
w AS (SELECT conv_id, {sql_words(prompt)} AS p, list_concat({lead}, {sql_words(a)}) AS c FROM firsts),
e AS (SELECT w.conv_id, coalesce(a.x, []) AS p, coalesce(b.x, []) AS c FROM w
  LEFT JOIN {enc('p')} a USING (conv_id) LEFT JOIN {enc('c')} b USING (conv_id)),
k AS (SELECT conv_id, c, CASE WHEN len(p) + len(c) > {MASK_LEN} THEN list_slice(p, len(p) + 1 -
  least(greatest(len(p) - (len(p) + len(c) - {MASK_LEN}), 0), {MASK_LEN - MASK_RESP - 1}), len(p)) ELSE p END AS p FROM e),
f AS (SELECT conv_id, p, CASE WHEN len(p) + len(c) > {MASK_LEN}
  THEN list_slice(c, 1, greatest({MASK_RESP}, {MASK_LEN} - len(p))) ELSE c END AS c FROM k),
g AS (SELECT conv_id, list_concat(p, c) AS x, list_concat(list_transform(p, lambda q: -100), c) AS y,
  (row_number() OVER (ORDER BY conv_id) - 1) // {MASK_BATCH} AS batch_id FROM f),
h AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS m FROM g)
SELECT conv_id, batch_id, {joined(_pad('x', 'm', '2'))} AS input_ids, {joined(_pad('y', 'm', '-100'))} AS labels,
  {joined(_pad('list_transform(x, lambda q: 1)', 'm', '0'))} AS attention_mask,
  CAST(len(list_filter(y, lambda q: q <> -100)) AS BIGINT) AS supervised FROM h"""


def masked_rows(spark, sf, version=2):
    d = P.with_batches(masked_source(spark, sf, version), MASK_BATCH, "conv_id")
    return P.mask_completion(d, "p_ids", "c_ids", MASK_LEN, MASK_RESP, batch="batch_id")


def _masked(spark, sf, version):
    d = masked_rows(spark, sf, version)
    return d.select("conv_id", "batch_id", *[_str(c).alias(c) for c in ("input_ids", "labels", "attention_mask")],
                    P.supervised_tokens("labels").cast("bigint").alias("supervised"))


@query("msk1_mask_completion", _mask_sql(2))
def msk1(spark, sf):
    return _masked(spark, sf, 2)


@query("msk2_mask_completion_v1", _mask_sql(1))
def msk2(spark, sf):
    return _masked(spark, sf, 1)


@query("msk3_truncate_pair", f"""
WITH {_DOC_IDS} SELECT doc_id, {joined("list_slice(ids, greatest(len(ids) - 48, 0) + 1, len(ids))")} AS prompt_ids,
  {joined("list_slice(ids, 1, greatest(64 - least(len(ids), 48), 0))")} AS completion_ids FROM docs""")
def msk3(spark, sf):
    d = encoded_docs(spark, sf).select("doc_id", P.truncate_pair("ids", "ids", 48, 64).alias("t"))
    return d.select("doc_id", _str("t.prompt_ids").alias("prompt_ids"), _str("t.completion_ids").alias("completion_ids"))


@query("msk4_supervised_tokens", f"""
WITH {FIRSTS} SELECT conv_id, CAST(len({sql_words("coalesce(a, '')")}) AS BIGINT) AS supervised FROM firsts
WHERE len({sql_words("coalesce(a, '')")}) > 0""")
def msk4(spark, sf):
    d = masked_source(spark, sf, 1)
    d = P.mask_completion(d, "p_ids", "c_ids", 1_000_000)
    n = P.supervised_tokens("labels").cast("bigint")
    return d.select("conv_id", n.alias("supervised")).filter(F.col("supervised") > 0)


# ---- packed-data health ------------------------------------------------------------------

@query("dgn1_id_range", f"""
WITH {_PACKED}, h AS (SELECT * FROM packed ORDER BY seq_id LIMIT 1000)
SELECT min(x) AS min_id, max(x) AS max_id, max(x) < {VOCAB} AND min(x) >= 0 AS vocab_ok
FROM (SELECT unnest(input_ids) AS x FROM h)""")
def dgn1(spark, sf):
    return D.id_range(packed_docs(spark, sf), VOCAB)


@query("dgn2_dataset_facts", f"""
WITH {_PACKED} SELECT count(*) AS rows, CAST(min(len(input_ids)) AS INT) AS min_len, CAST(max(len(input_ids)) AS INT) AS max_len,
  CAST(sum(len(input_ids)) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE len(input_ids) <> {SEQ}) AS BIGINT) AS mismatched
FROM packed""")
def dgn2(spark, sf):
    return D.dataset_facts(packed_docs(spark, sf), seq_len=SEQ)


@query("dgn6_token_budget", f"""
WITH {_PACKED} SELECT count(*) AS dataset_rows, CAST(32 * {SEQ} AS BIGINT) AS tokens_per_step,
  CAST(ceil(1000000 / (32.0 * {SEQ})) AS BIGINT) AS steps, CAST(ceil(1000000 / (32.0 * {SEQ})) AS BIGINT) * 32 AS rows_needed,
  round(CAST(ceil(1000000 / (32.0 * {SEQ})) AS BIGINT) * 32 / CAST(count(*) AS DOUBLE), 6) AS epochs FROM packed""")
def dgn6(spark, sf):
    d = D.token_budget(packed_docs(spark, sf), 1_000_000, SEQ)
    return d.withColumn("epochs", F.round("epochs", 6))

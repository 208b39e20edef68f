"""Count-based scoring, perplexity, preference metrics, rewards, checks, vector health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as X
from ..functions.text import valid_preference, words
from ..operators import diagnostics as D
from ..operators import evaluation as E
from ..operators import ngrams as N
from ..operators import tokens as K
from ..session import materialize
from .registry import conversations, documents, query, table
from .sql import PREFS, WS_RE, ids_cte, strip, words as sql_words, words_cte
from .text_queries import preference_rows
from .token_queries import VOCAB, doc_vocab, encoded_docs

MODELS = ("de", "en", "es", "fr")
_MODELS_SQL = "(VALUES ('de'), ('en'), ('es'), ('fr')) m(model)"
KEEP = 1024

_IDS = ids_cte(VOCAB)
_IDS_LANG = ids_cte(VOCAB, cols="lang")
_BIGRAMS = """tr AS (SELECT coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS ctx, id AS tok FROM ids),
bg AS (SELECT ctx, tok, count(*) AS n FROM tr GROUP BY ctx, tok),
cx AS (SELECT ctx, sum(n) AS ctx_n FROM bg GROUP BY ctx)"""
_BIGRAMS_LANG = """tr AS (SELECT lang AS model, coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS ctx, id AS tok FROM ids),
bg AS (SELECT model, ctx, tok, count(*) AS n FROM tr GROUP BY model, ctx, tok),
cx AS (SELECT model, ctx, sum(n) AS ctx_n FROM bg GROUP BY model, ctx)"""


def doc_bigrams(spark, sf, vocab=None):
    return N.bigram_counts(encoded_docs(spark, sf, vocab))


def lang_bigrams(spark, sf, vocab):
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("model"), "text")
    return N.bigram_counts(K.encode_lines(d, vocab), group=["model"])


# ---- n-grams ---------------------------------------------------------------------------

@query("ngm1_ngram_counts", f"""
WITH {_IDS}, g AS (SELECT id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS c FROM ids
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT a || ',' || b || ',' || c AS gram, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY 1""")
def ngm1(spark, sf):
    return N.ngram_counts(encoded_docs(spark, sf), 3).select(F.array_join("gram", ",").alias("gram"), "n")


def _cut(alias: str, key: str, tbl: str, text: str, keep: int | None = None) -> str:
    """Word ids of a text column, at most ``keep`` per row, with the id before each."""
    return f"""{words_cte('w_' + alias, tbl, key, text)},
{alias} AS (SELECT {key}, j - 1 AS pos, coalesce(lag(coalesce(id, 0)) OVER (PARTITION BY {key} ORDER BY j), 1) AS ctx,
  coalesce(id, 0) AS tok FROM w_{alias} LEFT JOIN vocab v ON w_{alias}.tok = v.token{f' WHERE j <= {keep}' if keep else ''})"""


_LOGP = f"ln((coalesce(n, 0) + 1.0) / (coalesce(ctx_n, 0) + {VOCAB}.0))"
_BENCH = _cut("bt", "item_id", "benchmark", "text")
_BENCH_CUT = _cut("bt", "item_id", "benchmark", "text", KEEP)


def bench_ids(spark, sf, vocab, keep=None):
    """Ids of the benchmark texts; ``keep`` cuts them, as the two truncating evaluations do."""
    d = K.encode_text(table(spark, sf, "benchmark").select("item_id", "text"), vocab)
    return d.select("item_id", F.slice("ids", 1, keep).alias("ids")) if keep else d.select("item_id", "ids")


@query("ngm2_score_tokens", f"""
WITH {_IDS}, {_BIGRAMS}, {_BENCH}
SELECT item_id, pos, CAST(bt.ctx AS INT) AS ctx, CAST(bt.tok AS INT) AS tok, round({_LOGP}, 6) AS logp FROM bt
LEFT JOIN bg ON bg.ctx = bt.ctx AND bg.tok = bt.tok LEFT JOIN cx ON cx.ctx = bt.ctx""")
def ngm2(spark, sf):
    v = doc_vocab(spark, sf)
    t = N.transitions(bench_ids(spark, sf, v), ["item_id"])
    d = N.score_tokens(t, doc_bigrams(spark, sf, v), VOCAB, key=["item_id"])
    return d.select("item_id", "pos", "ctx", "tok", F.round("logp", 6).alias("logp"))


_ITEM_SCORES = f"""sc AS (SELECT model, item_id, round(sum(-{_LOGP}), 6) AS nll, count(*) AS n_tok
FROM (SELECT * FROM bt, {_MODELS_SQL}) b LEFT JOIN bg USING (model, ctx, tok) LEFT JOIN cx USING (model, ctx)
GROUP BY model, item_id)"""
_SCORES = f"{_IDS_LANG}, {_BIGRAMS_LANG}, {_BENCH}, {_ITEM_SCORES}"
_SCORES_CUT = f"{_IDS_LANG}, {_BIGRAMS_LANG}, {_BENCH_CUT}, {_ITEM_SCORES}"


def item_scores(spark, sf, keep=None):
    """Score rows: one model per language, every benchmark item (JN3)."""
    v = doc_vocab(spark, sf)
    t = N.with_models(N.transitions(bench_ids(spark, sf, v, keep), ["item_id"]), list(MODELS))
    d = N.score_tokens(t, lang_bigrams(spark, sf, v), VOCAB, key=["item_id"], group=["model"])
    d = N.seq_logprob(d, ["model", "item_id"])
    return d.select("model", "item_id", F.round(-F.col("logp"), 6).alias("nll"), "n_tok")


def item_losses(spark, sf, keep=None):
    return item_scores(spark, sf, keep).withColumn("loss", F.col("nll") / F.col("n_tok"))


@query("jn3_model_items", f"""
WITH {_SCORES} SELECT model, item_id, nll, n_tok FROM sc""")
def jn3(spark, sf):
    return item_scores(spark, sf)


def _pair_scores_sql() -> str:
    w = sql_words
    return f"""{_IDS_LANG}, {_BIGRAMS_LANG}, {PREFS},
ok AS (SELECT * FROM prefs WHERE prompt <> '' AND length({strip('chosen')}) > 8 AND length({strip('rejected')}) > 8
  AND {strip('chosen')} <> {strip('rejected')}),
plen AS (SELECT conv_id, len({w('prompt')}) AS plen FROM ok),
pa AS (SELECT conv_id, 'chosen' AS side, prompt || ' ' || chosen AS text FROM ok
  UNION ALL SELECT conv_id, 'rejected', prompt || ' ' || rejected FROM ok),
{words_cte('pw', 'pa', 'conv_id', 'text', 'side')},
pt AS (SELECT conv_id, side, j - 1 AS pos, coalesce(lag(coalesce(id, 0)) OVER (PARTITION BY conv_id, side ORDER BY j), 1) AS ctx,
  coalesce(id, 0) AS tok FROM pw LEFT JOIN vocab v ON pw.tok = v.token),
ps AS (SELECT model, conv_id, side, round(sum({_LOGP}), 6) AS logp, count(*) AS n_tok
  FROM (SELECT pt.*, model FROM pt JOIN plen USING (conv_id), {_MODELS_SQL} WHERE pos >= plen) x
  LEFT JOIN bg USING (model, ctx, tok) LEFT JOIN cx USING (model, ctx) GROUP BY model, conv_id, side)"""


_PAIR_SCORES = _pair_scores_sql()


def pair_scores(spark, sf):
    """``model, conv_id, side, logp, n_tok`` of both answers given the prompt."""
    p = preference_rows(spark, sf).filter(valid_preference("prompt", "chosen", "rejected"))
    v = doc_vocab(spark, sf)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.concat("prompt", F.lit(" "), s).alias("text"))
                      for s in ("chosen", "rejected")])
    d = (p.select("conv_id", F.size(words("prompt")).alias("plen"), F.explode(sides).alias("s"))
         .select("conv_id", "plen", "s.side", "s.text"))
    d = K.encode_text(d, v)
    t = N.transitions(d, ["conv_id", "side", "plen"]).filter(F.col("pos") >= F.col("plen"))
    t = N.with_models(t, list(MODELS))
    sc = N.score_tokens(t, lang_bigrams(spark, sf, v), VOCAB, key=["conv_id", "side"], group=["model"])
    out = N.seq_logprob(sc, ["model", "conv_id", "side"])
    return out.withColumn("logp", F.round("logp", 6))


@query("ngm3_seq_logprob", f"""
WITH {_PAIR_SCORES} SELECT model, conv_id, side, logp, n_tok FROM ps""")
def ngm3(spark, sf):
    return pair_scores(spark, sf)


@query("ngm4_next_token_topk", f"""
WITH {_IDS}, {_BIGRAMS}, r AS (SELECT ctx, tok, n, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, tok) AS rank FROM bg)
SELECT CAST(ctx AS INT) AS ctx, CAST(tok AS INT) AS tok, CAST(rank AS INT) AS rank, round(n / CAST(ctx_n AS DOUBLE), 8) AS p
FROM r JOIN cx USING (ctx) WHERE rank <= 10""")
def ngm4(spark, sf):
    return N.next_token_topk(doc_bigrams(spark, sf), 10).withColumn("p", F.round("p", 8))


@query("ngm5_nucleus", f"""
WITH {_IDS}, {_BIGRAMS}, r AS (SELECT ctx, tok, n, row_number() OVER w AS rank,
  sum(n) OVER (PARTITION BY ctx ORDER BY n DESC, tok ROWS UNBOUNDED PRECEDING) AS cum,
  sum(n) OVER (PARTITION BY ctx) AS total FROM bg WINDOW w AS (PARTITION BY ctx ORDER BY n DESC, tok)),
k AS (SELECT * FROM r WHERE rank = 1 OR cum <= CAST(0.9 AS DOUBLE) * total)
SELECT CAST(ctx AS INT) AS ctx, CAST(tok AS INT) AS tok, CAST(rank AS INT) AS rank,
  round(n / CAST(sum(n) OVER (PARTITION BY ctx) AS DOUBLE), 8) AS p FROM k""")
def ngm5(spark, sf):
    return N.nucleus(doc_bigrams(spark, sf), 0.9).withColumn("p", F.round("p", 8))


# ---- perplexity --------------------------------------------------------------------------

@query("ppl1_unweighted", f"""
WITH {_SCORES} SELECT model, count(*) AS n, round(avg(nll / n_tok), 5) AS loss, round(exp(avg(nll / n_tok)), 3) AS ppl
FROM sc GROUP BY model""")
def ppl1(spark, sf):
    d = E.ppl_unweighted(item_losses(spark, sf), group=["model"])
    return d.select("model", "n", F.round("loss", 5).alias("loss"), F.round("ppl", 3).alias("ppl"))


@query("ppl2_weighted", f"""
WITH {_SCORES_CUT} SELECT model, CAST(sum(n_tok) AS BIGINT) AS n_tok, round(sum(nll) / sum(n_tok), 5) AS loss,
  round(exp(sum(nll) / sum(n_tok)), 3) AS ppl FROM sc GROUP BY model""")
def ppl2(spark, sf):
    d = E.ppl_weighted(item_losses(spark, sf, KEEP), group=["model"])
    return d.select("model", "n_tok", F.round("loss", 5).alias("loss"), F.round("ppl", 3).alias("ppl"))


@query("ppl3_completion", f"""
WITH {_PAIR_SCORES} SELECT model, side, CAST(sum(n_tok) AS BIGINT) AS n_tok, round(sum(-logp) / sum(n_tok), 5) AS loss,
  round(exp(sum(-logp) / sum(n_tok)), 3) AS ppl FROM ps GROUP BY model, side""")
def ppl3(spark, sf):
    d = E.ppl_completion(pair_scores(spark, sf).withColumn("nll", -F.col("logp")), group=["model", "side"])
    return d.select("model", "side", "n_tok", F.round("loss", 5).alias("loss"), F.round("ppl", 3).alias("ppl"))


@query("ppl4_compare_models", f"""
WITH {_SCORES_CUT}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY item_id) AS r FROM sc)
SELECT model, count(*) AS n, round(avg(nll / n_tok), 5) AS loss, round(exp(avg(nll / n_tok)), 3) AS ppl
FROM r WHERE r <= 10 GROUP BY model""")
def ppl4(spark, sf):
    d = E.compare_models(item_losses(spark, sf, KEEP))
    return d.select("model", "n", F.round("loss", 5).alias("loss"), F.round("ppl", 3).alias("ppl"))


@query("ldb1_leaderboard_loss", f"""
WITH {_SCORES}, s AS (SELECT model, sum(nll) / sum(n_tok) AS loss FROM sc GROUP BY model)
SELECT model, round(loss, 5) AS loss, row_number() OVER (ORDER BY loss, model) AS rank FROM s""")
def ldb1(spark, sf):
    d = E.leaderboard_loss(E.ppl_weighted(item_losses(spark, sf), group=["model"]))
    return d.select("model", F.round("loss", 5).alias("loss"), F.col("rank").cast("bigint").alias("rank"))


@query("ldb2_leaderboard_ppl", f"""
WITH {_SCORES}, s AS (SELECT model, count(*) AS n, exp(avg(nll / n_tok)) AS ppl FROM sc GROUP BY model)
SELECT model, n, round(ppl, 3) AS ppl, row_number() OVER (ORDER BY ppl, model) AS rank FROM s""")
def ldb2(spark, sf):
    d = E.leaderboard_ppl(E.ppl_unweighted(item_losses(spark, sf), group=["model"]))
    return d.select("model", "n", F.round("ppl", 3).alias("ppl"), F.col("rank").cast("bigint").alias("rank"))


# ---- pairs ---------------------------------------------------------------------------------

_JOINED = """jp AS (SELECT c.model, c.conv_id, c.logp AS lp_chosen, r.logp AS lp_rejected, c.n_tok AS len_chosen,
  r.n_tok AS len_rejected FROM ps c JOIN ps r ON c.model = r.model AND c.conv_id = r.conv_id
  WHERE c.side = 'chosen' AND r.side = 'rejected')"""


def joined_pairs(spark, sf):
    s = pair_scores(spark, sf)
    return E.join_pair_scores(s.filter(F.col("side") == "chosen"), s.filter(F.col("side") == "rejected"),
                              ["model", "conv_id"])


@query("jn1_pair_scores", f"""
WITH {_PAIR_SCORES}, {_JOINED} SELECT model, conv_id, lp_chosen, lp_rejected, len_chosen, len_rejected FROM jp""")
def jn1(spark, sf):
    return joined_pairs(spark, sf)


_METRICS = """SELECT model, count(*) AS n, round(avg(CAST(lp_chosen > lp_rejected AS DOUBLE)), 6) AS acc,
  round(avg(lp_chosen - lp_rejected), 3) AS margin_mean,
  round(quantile_cont(lp_chosen - lp_rejected, 0.5), 3) AS margin_median,
  round(quantile_cont(lp_chosen - lp_rejected, 0.95), 3) AS margin_p95,
  round(avg(len_chosen), 6) AS len_chosen_tokens_mean, round(avg(len_rejected), 6) AS len_reject_tokens_mean
FROM jp GROUP BY model"""


def _rounded_metrics(d):
    places = {"acc": 6, "margin_mean": 3, "margin_median": 3, "margin_p95": 3,
              "len_chosen_tokens_mean": 6, "len_reject_tokens_mean": 6}
    return d.select("model", "n", *[F.round(c, k).alias(c) for c, k in places.items()])


def metrics_by_model(spark, sf):
    # means and quantiles read the score table several times, so it is stored
    scores = materialize(joined_pairs(spark, sf), "pair-scores")
    return _rounded_metrics(E.pair_metrics(scores, ["model"]))


@query("prf1_pair_metrics", f"WITH {_PAIR_SCORES}, {_JOINED} {_METRICS}")
def prf1(spark, sf):
    return metrics_by_model(spark, sf)


@query("prf1_exact_quantiles", """
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.95), 4) AS p95
FROM orders GROUP BY o_orderstatus""")
def prf1_quantiles(spark, sf):
    d = E.exact_quantiles(table(spark, sf, "orders"), "o_totalprice", {"med": 0.5, "p95": 0.95}, ["o_orderstatus"])
    return d.select("o_orderstatus", F.round("med", 4).alias("med"), F.round("p95", 4).alias("p95"))


@query("ldb3_leaderboard_acc", f"""
WITH {_PAIR_SCORES}, {_JOINED}, s AS ({_METRICS})
SELECT model, n, acc, margin_mean, margin_p95, row_number() OVER (ORDER BY acc DESC, model) AS rank FROM s""")
def ldb3(spark, sf):
    d = E.leaderboard_acc(metrics_by_model(spark, sf))
    return d.select("model", "n", "acc", "margin_mean", "margin_p95", F.col("rank").cast("bigint").alias("rank"))


# ---- rewards ---------------------------------------------------------------------------------

_ANSWER = "CASE doc_id % 3 WHEN 0 THEN ' \\boxed{' || n_chars || '}' WHEN 1 THEN ' \\boxed{0}' ELSE ' none' END"


def predictions(spark, sf):
    """Texts that end in a boxed right, boxed wrong, or no answer."""
    k = F.col("doc_id") % 3
    tail = (F.when(k == 0, F.concat(F.lit(" \\boxed{"), "n_chars", F.lit("}")))
            .when(k == 1, " \\boxed{0}").otherwise(" none"))
    return documents(spark, sf).select("doc_id", F.concat("text", tail).alias("completion"))


def truths(spark, sf):
    return documents(spark, sf).select("doc_id", "lang", F.col("n_chars").cast("string").alias("ground_truth"))


@query("jn2_answers_with_truth", f"""
SELECT doc_id, lang, CAST(n_chars AS VARCHAR) AS ground_truth, text || {_ANSWER} AS completion,
  CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM documents""")
def jn2(spark, sf):
    return E.score_answers(predictions(spark, sf), truths(spark, sf), ["doc_id"])


@query("rwd1_boxed_accuracy", """
SELECT lang, count(*) AS n, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 8) AS accuracy
FROM documents GROUP BY lang""")
def rwd1(spark, sf):
    d = E.accuracy(E.score_answers(predictions(spark, sf), truths(spark, sf), ["doc_id"]), ["lang"])
    return d.withColumn("accuracy", F.round("accuracy", 8))


@query("udf5_custom_reward", """
SELECT doc_id, CASE WHEN contains(text || CASE doc_id % 3 WHEN 0 THEN ' \\boxed{' || n_chars || '}' WHEN 1 THEN ' \\boxed{0}' ELSE ' none' END,
  CAST(n_chars AS VARCHAR)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM documents""".replace("\\\\", "\\"))
def udf5(spark, sf):
    X.register_reward("mentions", lambda c, t: F.when(c.contains(t), 1.0).otherwise(0.0))
    d = E.score_answers(predictions(spark, sf), truths(spark, sf), ["doc_id"], kind="mentions")
    return d.select("doc_id", "reward")


# ---- answer checks -----------------------------------------------------------------------------

def answers(spark, sf):
    """Turn texts dressed as answers of several shapes, by turn number."""
    k = F.col("turn") % 5
    body = F.col("text")
    made = (F.when(k == 0, F.concat(F.lit("Sure: "), F.to_json(F.struct(body.alias("answer"), F.lit(1).alias("steps")))))
            .when(k == 1, F.concat(F.lit("- a\n • "), body, F.lit("\n* c")))
            .when(k == 2, F.concat(F.lit(" abc"), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0"),
                                   F.lit("@example.com\n")))
            .when(k == 3, F.concat(F.lit("def is_palindrome(s):\n  return "), body)).otherwise(body))
    return conversations(spark, sf).select("conv_id", "turn", made.alias("answer"), k.alias("k"))


@query("ifc1_json_has_keys", "SELECT conv_id, turn, turn % 5 = 0 AS ok FROM conversations")
def ifc1(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", X.json_has_keys("answer").alias("ok"))


_ANSWERS = """ans AS (SELECT conv_id, turn, turn % 5 AS k, CASE turn % 5 WHEN 0 THEN 'Sure: ' || to_json({'answer': text, 'steps': 1})
  WHEN 1 THEN '- a' || chr(10) || ' • ' || text || chr(10) || '* c'
  WHEN 2 THEN ' abc' || lpad(CAST(conv_id % 100 AS VARCHAR), 2, '0') || '@example.com' || chr(10)
  WHEN 3 THEN 'def is_palindrome(s):' || chr(10) || '  return ' || text ELSE text END AS answer FROM conversations)"""
_BULLET_COUNT = (f"len(list_filter(string_split_regex(answer, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), "
                 f"lambda x: regexp_matches(x, '^[{WS_RE}]*[-•*][{WS_RE}]+[^{WS_RE}]')))")
_WORDS = f"list_filter(string_split_regex(answer, '[{WS_RE}]+'), lambda w: w <> '')"


@query("ifc2_count_bullets", f"WITH {_ANSWERS} SELECT conv_id, turn, CAST({_BULLET_COUNT} AS BIGINT) AS bullets FROM ans")
def ifc2(spark, sf):
    d = answers(spark, sf)
    return d.select("conv_id", "turn", X.count_bullets("answer").cast("bigint").alias("bullets"))


@query("ifc3_full_match", f"""WITH {_ANSWERS} SELECT conv_id, turn,
  regexp_full_match({strip('answer')}, '[a-z]{{3}}\\d{{2}}@example\\.com') AS ok FROM ans""")
def ifc3(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", X.full_match("answer").alias("ok"))


@query("ifc4_contains_all", f"""WITH {_ANSWERS} SELECT conv_id, turn,
  contains(answer, 'def is_palindrome') AND contains(answer, 'return') AS ok FROM ans""")
def ifc4(spark, sf):
    d = answers(spark, sf)
    return d.select("conv_id", "turn", X.contains_all("answer").alias("ok"))


@query("ifc5_word_limit", f"""WITH {_ANSWERS} SELECT conv_id, turn,
  len({_WORDS}) BETWEEN 1 AND 40 AND NOT contains(coalesce(({_WORDS})[1], ''), '-') AS ok FROM ans""")
def ifc5(spark, sf):
    d = answers(spark, sf)
    return d.select("conv_id", "turn", X.word_limit("answer").alias("ok"))


@query("ifc6_pass_rate", f"""WITH {_ANSWERS}, c AS (
  SELECT 'bullets_3' AS "check", {_BULLET_COUNT} = 3 AS ok FROM ans
  UNION ALL SELECT 'regex_email', regexp_full_match({strip('answer')}, '[a-z]{{3}}\\d{{2}}@example\\.com') FROM ans
  UNION ALL SELECT 'python_function', contains(answer, 'def is_palindrome') AND contains(answer, 'return') FROM ans
  UNION ALL SELECT 'word_limit', len({_WORDS}) BETWEEN 1 AND 40 AND NOT contains(coalesce(({_WORDS})[1], ''), '-') FROM ans
  UNION ALL SELECT 'json_format', k = 0 FROM ans)
SELECT "check", CAST(sum(CAST(ok AS INT)) AS BIGINT) AS passed, count(*) AS total, round(avg(CAST(ok AS INT)), 8) AS rate FROM c GROUP BY "check"
UNION ALL SELECT 'all', CAST(sum(CAST(ok AS INT)) AS BIGINT), count(*), round(avg(CAST(ok AS INT)), 8) FROM c""")
def ifc6(spark, sf):
    d = X.run_checks(answers(spark, sf), "answer", ["conv_id", "turn"])
    each = E.pass_rate(d)
    whole = E.pass_rate(d, ()).select(F.lit("all").alias("check"), "passed", "total", "rate")
    return each.unionByName(whole).withColumn("rate", F.round("rate", 8))


@query("udf6_custom_checks", """
SELECT conv_id, turn, unnest(['short', 'asks']) AS check,
  unnest([length(text) <= 200, contains(text, '?')]) AS ok FROM conversations""")
def udf6(spark, sf):
    checks = {"short": lambda c: F.length(c) <= 200, "asks": lambda c: c.contains("?")}
    return X.run_checks(conversations(spark, sf), "text", ["conv_id", "turn"], checks)


# ---- vectors and losses --------------------------------------------------------------------------

@query("dgn3_vector_stats", """
SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(max(abs(x)), 6) AS max_abs,
  bool_or(isnan(x)) AS has_nan, bool_or(isinf(x)) AS has_inf
FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label""")
def dgn3(spark, sf):
    d = D.vector_stats(table(spark, sf, "embeddings"), "embedding", ["label"])
    return d.select("label", "n", "has_nan", "has_inf", *[F.round(c, 6).alias(c) for c in ("mean", "std", "max_abs")])


_LOSS = """CASE doc_id % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE)
  ELSE n_chars / 40.0::DOUBLE END"""


def _losses(spark, sf):
    k = F.col("doc_id") % 5
    loss = (F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf")))
            .otherwise(F.col("n_chars") / F.lit(40.0)))
    return documents(spark, sf).select("doc_id", loss.alias("loss"))


@query("dgn4_sanitize_loss", f"""
SELECT doc_id, round(CASE WHEN isnan(l) OR isinf(l) THEN 10.0::DOUBLE ELSE least(l, 100.0::DOUBLE) END, 6) AS loss
FROM (SELECT doc_id, {_LOSS} AS l FROM documents)""")
def dgn4(spark, sf):
    return _losses(spark, sf).select("doc_id", F.round(D.sanitize_loss("loss"), 6).alias("loss"))


@query("dgn5_loss_verdict", f"""
SELECT doc_id, CASE WHEN l > 100 THEN 'broken' WHEN l > 20 THEN 'high' ELSE 'ok' END AS verdict,
  round(ln({VOCAB}), 8) AS fresh FROM (SELECT doc_id, n_chars / 40.0::DOUBLE AS l FROM documents)""")
def dgn5(spark, sf):
    d = documents(spark, sf).withColumn("loss", F.col("n_chars") / F.lit(40.0))
    return d.select("doc_id", D.loss_verdict("loss").alias("verdict"),
                    F.round(F.lit(D.expected_fresh_loss(VOCAB)), 8).alias("fresh"))

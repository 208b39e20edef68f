"""Message assembly and the instruction, chat and preference formats."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import chat as C
from ..functions import text as T
from ..operators import conversations as V
from .registry import conversations, documents, query
from .sql import FIRSTS, PREFS, strip
from .text_queries import preference_rows

U, A, S = "coalesce(u, '')", "coalesce(a, '')", "coalesce(s, '')"
_INSTR = (f"'### Instruction:' || chr(10) || {strip(U)} || chr(10) || "
          f"CASE WHEN {strip(S)} <> '' THEN chr(10) || '### Input:' || chr(10) || {strip(S)} || chr(10) ELSE '' END"
          " || chr(10) || '### Response:' || chr(10)")


def _tmpl(user: str) -> str:
    return f"'User: ' || {user} || chr(10) || 'Assistant:' || chr(10)"


_EMPTY = "'User:' || chr(10) || 'Assistant:' || chr(10)"


def firsts(spark, sf, **kw):
    return V.first_messages(conversations(spark, sf), **kw)


def instructions(spark, sf):
    """Instruction records: first user, system and assistant texts."""
    m = "messages"
    return firsts(spark, sf).select(
        "conv_id", C.first_text(m, "user").alias("instruction"), C.first_text(m, "system").alias("input"),
        C.first_text(m, "assistant").alias("output"), C.first_text(m, "assistant").alias("response"))


def _pair(df, key, col):
    return df.select(key, col.alias("p")).select(key, "p.*")


@query("agg1_assemble_messages", """
SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS thread FROM conversations GROUP BY conv_id""")
def agg1(spark, sf):
    m = V.assemble_messages(conversations(spark, sf))
    return m.select("conv_id", F.array_join(F.transform(
        "messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("thread"))


@query("agg1_first_messages", f"""WITH {FIRSTS} SELECT conv_id, {S} AS s, {U} AS u, {A} AS a FROM firsts""")
def agg1_first(spark, sf):
    return instructions(spark, sf).select("conv_id", F.col("input").alias("s"),
                                          F.col("instruction").alias("u"), F.col("output").alias("a"))


@query("fmt1_instruction_pair", f"""
WITH {FIRSTS} SELECT conv_id, {_INSTR} AS prompt, {strip(A)} AS completion FROM firsts""")
def fmt1(spark, sf):
    return _pair(instructions(spark, sf), "conv_id", C.instruction_pair())


@query("fmt2_instruction_text", f"""
WITH {FIRSTS} SELECT conv_id, {_INSTR} || {strip(A)} AS text FROM firsts""")
def fmt2(spark, sf):
    return instructions(spark, sf).select("conv_id", C.instruction_text().alias("text"))


@query("fmt3_first_exchange", f"""
WITH {FIRSTS} SELECT conv_id, {strip(U)} AS prompt, {strip(A)} AS completion FROM firsts""")
def fmt3(spark, sf):
    return _pair(firsts(spark, sf), "conv_id", C.first_exchange_pair())


@query("fmt4_first_two", f"""
SELECT conv_id, {strip("coalesce(max(text) FILTER (WHERE rn = 1), '')")} AS prompt,
       {strip("coalesce(max(text) FILTER (WHERE rn = 2), '')")} AS completion
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
GROUP BY conv_id""")
def fmt4(spark, sf):
    return _pair(V.leading_messages(conversations(spark, sf), 2), "conv_id", C.first_two_pair())


@query("fmt5_pair_text", f"""
WITH {FIRSTS} SELECT conv_id, {strip(f"{U} || {A}")} AS text FROM firsts""")
def fmt5(spark, sf):
    d = instructions(spark, sf)
    return d.select("conv_id", C.pair_text("instruction", "output").alias("text"))


@query("fmt6_dialog_text", f"""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<s>user: ' || {strip('text')} || '</s>'
  WHEN 'assistant' THEN 'assistant: ' || {strip('text')} || '</s>'
  ELSE role || ': ' || {strip('text')} END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def fmt6(spark, sf):
    return V.assemble_messages(conversations(spark, sf)).select("conv_id", C.dialog_text().alias("text"))


@query("fmt7_chat_pair", f"""
WITH {FIRSTS} SELECT conv_id, CASE WHEN u IS NULL THEN {_EMPTY} ELSE {_tmpl(strip('u'))} END AS prompt,
  chr(10) || {strip(A)} AS completion FROM firsts""")
def fmt7(spark, sf):
    return _pair(firsts(spark, sf), "conv_id", C.chat_pair())


@query("fmt8_chat_pair_or_empty", f"""
WITH {FIRSTS} SELECT conv_id, CASE WHEN u IS NULL THEN {_EMPTY} ELSE {_tmpl(strip('u'))} END AS prompt,
  CASE WHEN a IS NULL THEN '' ELSE chr(10) || {strip('a')} END AS completion FROM firsts""")
def fmt8(spark, sf):
    return _pair(firsts(spark, sf), "conv_id", C.chat_pair_or_empty())


@query("fmt9_instruction_or_prompt", f"""
WITH {FIRSTS} SELECT conv_id, {_tmpl(strip(f"CASE WHEN {S} <> '' THEN s ELSE {U} END"))} AS prompt,
  chr(10) || {strip(A)} AS completion FROM firsts""")
def fmt9(spark, sf):
    d = instructions(spark, sf)
    col = C.instruction_or_prompt_pair("input", "instruction", F.lit(None).cast("string"), "response")
    return _pair(d, "conv_id", col)


@query("fmt10_flat_message", f"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN {_EMPTY} ELSE {_tmpl(strip('text'))} END AS prompt,
  CASE WHEN role = 'assistant' THEN chr(10) || {strip('text')} ELSE chr(10) END AS completion
FROM conversations""")
def fmt10(spark, sf):
    d = conversations(spark, sf).select("conv_id", "turn", C.flat_message_pair().alias("p"))
    return d.select("conv_id", "turn", "p.*")


def _lead(x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' THEN chr(10) || {strip(x)} ELSE '' END"


@query("fmt11_preference_triple", f"""
WITH {PREFS} SELECT conv_id, {_tmpl(strip('prompt'))} AS prompt, {_lead('chosen')} AS chosen,
  {_lead('rejected')} AS rejected FROM prefs""")
def fmt11(spark, sf):
    # even conversations carry message lists, odd ones plain strings
    d = preference_rows(spark, sf)
    even = F.col("conv_id") % 2 == 0

    def block(x):
        msgs = F.array(F.struct(F.lit("prompter").alias("role"), F.col("prompt").alias("content")),
                       F.struct(F.lit("assistant").alias("role"), F.col(x).alias("content")))
        return (F.when(~even, F.col(x)), F.when(even, msgs))

    (ct, cm), (rt, rm) = block("chosen"), block("rejected")
    return _pair(d, "conv_id", C.preference_triple(ct, cm, rt, rm))


@query("fmt12_identity_triple", f"""
SELECT conv_id, {_tmpl("coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '')")} AS prompt,
  'I am a helpful AI assistant. I aim to be truthful and helpful.' AS chosen,
  'I cannot answer that question.' AS rejected FROM conversations GROUP BY conv_id""")
def fmt12(spark, sf):
    m = firsts(spark, sf, roles=("user",), last=True)
    shared = F.transform("messages", lambda x: F.struct(
        F.lit("human").alias("from"), x["content"].alias("value")))
    return _pair(m.withColumn("conversations", shared), "conv_id", C.identity_triple())


@query("fmt13_plain_triple", f"""
WITH {PREFS} SELECT conv_id,
  CASE WHEN conv_id % 3 = 0 OR {strip('prompt')} = ''
       THEN 'User: Please respond to this request.' || chr(10) || 'Assistant:' || chr(10) ELSE {strip('prompt')} END AS prompt,
  {strip('chosen')} AS chosen, {strip('rejected')} AS rejected FROM prefs""")
def fmt13(spark, sf):
    d = preference_rows(spark, sf).withColumn(
        "prompt", F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.col("prompt")))
    return _pair(d, "conv_id", C.plain_triple())


def _thread_text(col):
    return F.array_join(F.transform(col, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")


@query("fmt14_reply_pair", f"""
WITH {FIRSTS} SELECT conv_id,
  'system=You''re a helpful assistant.|user=' || {U} || '|assistant=' || replace({A}, 'the', 'our') AS chosen,
  'system=You''re a helpful assistant.|user=' || {U} || '|assistant=' || {A} AS rejected FROM firsts""")
def fmt14(spark, sf):
    d = instructions(spark, sf).select("conv_id", C.reply_pair("instruction", "output", "the", "our").alias("p"))
    return d.select("conv_id", _thread_text("p.chosen").alias("chosen"), _thread_text("p.rejected").alias("rejected"))


@query("fmt15_verifiable_record", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS ground_truth,
  'system=You are a helpful assistant that solves problems step-by-step. Always include the final numeric answer inside \\boxed{}.|user=' || text AS prompt
FROM documents""".replace("\\\\", "\\"))
def fmt15(spark, sf):
    answer = F.when(F.col("doc_id") % 4 == 0, F.lit("none")).otherwise(
        F.concat(F.lit("so it is\n#### "), "n_chars"))
    d = documents(spark, sf).select("doc_id", C.verifiable_record("text", answer).alias("p"))
    return d.select("doc_id", "p.ground_truth", _thread_text("p.prompt").alias("prompt"))


@query("fmt16_rendered_chat", """
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System: ' || text || chr(10)
  WHEN 'user' THEN 'User: ' || text || chr(10)
  WHEN 'assistant' THEN 'Assistant: ' || text || ' <|endoftext|>' ELSE '' END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def fmt16(spark, sf):
    return V.assemble_messages(conversations(spark, sf)).select("conv_id", C.rendered_chat().alias("text"))


_TURN = "'User: ' || u || chr(10) || 'Assistant:' || chr(10)"


@query("fmt17_rolling_prompt", f"""
WITH nx AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, turn, text AS u, CASE WHEN nr = 'assistant' THEN nt END AS a FROM nx WHERE role = 'user'),
r AS (SELECT conv_id, turn, {_TURN} AS open_turn,
        {_TURN} || CASE WHEN a IS NULL THEN '' ELSE {strip('a')} || chr(10) END AS done FROM ex)
SELECT conv_id, turn, coalesce(string_agg(done, '') OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), '') || open_turn AS prompt FROM r""")
def fmt17(spark, sf):
    return V.rolling_prompts(V.exchanges(conversations(spark, sf)))


@query("fmt17_dialog_prompt", f"""
WITH nx AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, turn, text AS u, CASE WHEN nr = 'assistant' THEN nt END AS a,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM nx WHERE role = 'user'),
r AS (SELECT conv_id, turn, back, a, {_TURN} || CASE WHEN a IS NULL THEN '' ELSE {strip('a')} || chr(10) END AS done FROM ex)
SELECT conv_id, string_agg(done, '' ORDER BY turn) || CASE WHEN max(a) FILTER (WHERE back = 1) IS NULL THEN ''
  ELSE 'User: ' || chr(10) || 'Assistant:' || chr(10) END AS prompt
FROM r WHERE back <= 8 GROUP BY conv_id""")
def fmt17_record(spark, sf):
    # the prompt needs the last eight exchanges: ranked before they are gathered
    ex = V.exchanges(conversations(spark, sf))
    ex = ex.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("back <= 8")
    h = ex.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "user", "assistant"))).alias("h"))
    hist = F.transform("h", lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant")))
    return h.withColumn("history", hist).select("conv_id", V.dialog_prompt("history").alias("prompt"))


@query("fmt19_sample_view", f"""
WITH {FIRSTS} SELECT conv_id, {U} AS user_prompt, {A} AS assistant_response FROM firsts
ORDER BY conv_id LIMIT 3""")
def fmt19(spark, sf):
    return _pair(firsts(spark, sf).orderBy("conv_id").limit(3), "conv_id", C.sample_view())


@query("udf4_formatter_registry", f"""
WITH {FIRSTS} SELECT conv_id, 'alpaca' AS fmt, {_INSTR} || {strip(A)} AS text FROM firsts
UNION ALL SELECT conv_id, 'dolly', {strip(f"{_INSTR} || {strip(A)}")} FROM firsts""")
def udf4(spark, sf):
    d = instructions(spark, sf)
    alpaca = d.select("conv_id", F.lit("alpaca").alias("fmt"), C.formatter("alpaca")().alias("text"))
    p = C.formatter("dolly")()
    dolly = d.select("conv_id", F.lit("dolly").alias("fmt"),
                     C.pair_text(p["prompt"], p["completion"]).alias("text"))
    return alpaca.unionByName(dolly)


@query("udf1_row_map", f"""
WITH {FIRSTS} SELECT conv_id, {strip(U)} || ' => ' || {strip(A)} AS text FROM firsts""")
def udf1(spark, sf):
    def to_text(df):
        p = C.first_exchange_pair()
        return df.select("conv_id", F.concat(p["prompt"], F.lit(" => "), p["completion"]).alias("text"))
    return firsts(spark, sf).transform(to_text)


@query("udf2_row_filter", f"""
WITH {FIRSTS} SELECT conv_id FROM firsts WHERE {strip(U)} <> '' AND {strip(A)} <> ''""")
def udf2(spark, sf):
    p = C.first_exchange_pair()
    return firsts(spark, sf).filter(T.not_blank(p["prompt"]) & T.not_blank(p["completion"])).select("conv_id")

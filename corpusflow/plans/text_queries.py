"""Text functions, projections, routing and row filters on the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, mixing
from .registry import conversations, documents, query, table
from .sql import PREFS, WS_TRIM, strip

PAD_L, PAD_R = "\u00a0\t\u2003", "\u3000\r\n "


def _padded():
    return F.concat(F.lit(PAD_L), "text", F.lit(PAD_R))


@query("txt1_strip", f"""
SELECT doc_id, trim(p, {WS_TRIM}) AS both_ends, CAST(length(ltrim(p, {WS_TRIM})) AS BIGINT) AS left_len,
       CAST(length(rtrim(p, {WS_TRIM})) AS BIGINT) AS right_len
FROM (SELECT doc_id, '{PAD_L}' || text || '{PAD_R}' AS p FROM documents)""")
def txt1(spark, sf):
    p = _padded()
    return documents(spark, sf).select(
        "doc_id", T.strip(p).alias("both_ends"), F.length(T.lstrip(p)).cast("bigint").alias("left_len"),
        F.length(T.rstrip(p)).cast("bigint").alias("right_len"))


@query("txt2_drop_cr", """
SELECT doc_id, text, CAST(n_chars AS BIGINT) AS n FROM documents""")
def txt2(spark, sf):
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    d = documents(spark, sf).select("doc_id", T.drop_cr(crlf).alias("text"))
    return d.withColumn("n", F.length("text").cast("bigint"))


@query("txt3_cut_at_stop", f"""
SELECT conv_id, turn, {strip("string_split(x, chr(10) || 'User:')[1]")} AS reply
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' ' || chr(10) || 'User:' || text
                                 ELSE ' ' || text END AS x FROM conversations)""")
def txt3(spark, sf):
    x = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" \nUser:"), "text")).otherwise(
        F.concat(F.lit(" "), "text"))
    return conversations(spark, sf).select("conv_id", "turn", T.cut_at_stop(x).alias("reply"))


@query("txt4_after_mark", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text || 'Assistant:' || chr(10) ELSE text END AS answer
FROM conversations""")
def txt4(spark, sf):
    x = F.when(F.col("role") == "assistant",
               F.concat(F.lit("User: q\nAssistant:\n"), "text", F.lit("Assistant:\n"))).otherwise(F.col("text"))
    return conversations(spark, sf).select("conv_id", "turn", T.after_mark(x).alias("answer"))


@query("txt5_boxed", r"""
SELECT doc_id, regexp_extract(x, '\\boxed\{([^\n]*?)\}', 1) AS boxed
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' \boxed{' || n_chars || '} \boxed{1}'
      WHEN 1 THEN text || '\boxed{a' || chr(10) || 'b}' ELSE text END AS x FROM documents)""")
def txt5(spark, sf):
    k = F.col("doc_id") % 3
    x = (F.when(k == 0, F.concat("text", F.lit(" \\boxed{"), "n_chars", F.lit("} \\boxed{1}")))
         .when(k == 1, F.concat("text", F.lit("\\boxed{a\nb}"))).otherwise(F.col("text")))
    return documents(spark, sf).select("doc_id", T.boxed(x).alias("boxed"))


@query("txt6_hash_answer", r"""
SELECT doc_id, nullif(regexp_extract(x, '####\s*(-?\d+)', 1), '') AS answer
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' #### ' || n_chars
      WHEN 1 THEN text || '####-' || n_chars ELSE text END AS x FROM documents)""")
def txt6(spark, sf):
    k = F.col("doc_id") % 3
    x = (F.when(k == 0, F.concat("text", F.lit(" #### "), "n_chars"))
         .when(k == 1, F.concat("text", F.lit("####-"), "n_chars")).otherwise(F.col("text")))
    return documents(spark, sf).select("doc_id", T.hash_answer(x).alias("answer"))


@query("txt7_swap_name", """
SELECT conv_id, turn, replace(text, 'the', 'our') AS reply FROM conversations""")
def txt7(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", T.swap_name("text", "the", "our").alias("reply"))


@query("txt8_leading_newline", f"""
SELECT doc_id, CASE WHEN x <> '' AND NOT starts_with(x, chr(10)) THEN chr(10) || ltrim(x, {WS_TRIM}) ELSE x END AS train,
       CASE WHEN x <> '' AND NOT starts_with(x, chr(10)) THEN chr(10) || x ELSE x END AS eval
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' || text WHEN 1 THEN chr(10) || text ELSE '' END AS x
      FROM documents)""")
def txt8(spark, sf):
    k = F.col("doc_id") % 3
    x = F.when(k == 0, F.concat(F.lit("  "), "text")).when(k == 1, F.concat(F.lit("\n"), "text")).otherwise("")
    return documents(spark, sf).select("doc_id", T.leading_newline(x).alias("train"),
                                       T.leading_newline(x, relstrip=False).alias("eval"))


@query("txt9_truncate_user", f"""
SELECT doc_id, CASE WHEN n_chars > 100 THEN rtrim(substr(text, 1, 100), {WS_TRIM}) ELSE text END AS cut
FROM documents""")
def txt9(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncate_user("text", 100).alias("cut"))


# ---- projections and routing -----------------------------------------------------

@query("prj1_first_filled", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN source ELSE '' END AS picked FROM documents""")
def prj1(spark, sf):
    k = F.col("doc_id") % 3
    a = F.when(k == 0, F.col("text")).when(k == 1, "")
    b = F.when(k == 1, F.col("source"))
    return documents(spark, sf).select("doc_id", T.first_filled(a, b).alias("picked"))


@query("prj2_rename_text", "SELECT page_id, html AS text FROM pages")
def prj2(spark, sf):
    return table(spark, sf, "pages").withColumnRenamed("html", "text").select("page_id", "text")


@query("prj3_merge_fields", "SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') AS merged FROM documents")
def prj3(spark, sf):
    return documents(spark, sf).select("doc_id", T.merge_fields("text", "source").alias("merged"))


@query("prj4_drop_raw", "SELECT doc_id, upper(lang) AS lang_code FROM documents")
def prj4(spark, sf):
    d = documents(spark, sf).withColumn("lang_code", F.upper("lang"))
    return d.drop("text", "lang", "source", "n_chars")


# paths derived from the rows: a folder name by id, then the row's own source
FOLDERS = ("FineWeb/a", "facebook/code", "the-stack/wiki", "OpenWebMath/wiki", "enwiki", "other", "x/gsm8k")


def _doc_path():
    return F.concat(F.lit("/data/"), F.element_at(F.array(*[F.lit(f) for f in FOLDERS]),
                                                  (F.col("doc_id") % len(FOLDERS) + 1).cast("int")),
                    F.lit("/"), "source")


_PATH_SQL = ("'/data/' || [" + ", ".join(f"'{f}'" for f in FOLDERS)
             + f"][CAST(doc_id % {len(FOLDERS)} + 1 AS INT)] || '/' || source")
_BUCKET_SQL = """CASE WHEN regexp_matches(lower(path), 'fineweb|refinedweb|commoncrawl|ccnet') THEN 'fineweb'
  WHEN regexp_matches(lower(path), 'book|gutenberg') THEN 'books'
  WHEN regexp_matches(lower(path), 'code|github|the-stack|starcoder') THEN 'code'
  WHEN regexp_matches(lower(path), 'math|openwebmath|gsm') THEN 'math'
  WHEN regexp_matches(lower(path), 'wiki') THEN 'wikipedia' ELSE 'misc' END"""


@query("prj5_classify_bucket", f"""
SELECT id, kind, {_BUCKET_SQL} AS bucket FROM (
  SELECT doc_id AS id, 'document' AS kind, {_PATH_SQL} AS path FROM documents
  UNION ALL SELECT page_id, 'page', url FROM pages)""")
def prj5(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"),
                                    T.classify_bucket(_doc_path()).alias("bucket"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"),
                                         T.classify_bucket("url").alias("bucket"))
    return d.unionByName(p)


@query("agg2_bucket_counts", f"""
SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM (SELECT {_PATH_SQL} AS path FROM documents) GROUP BY 1""")
def agg2(spark, sf):
    return mixing.bucket_counts(documents(spark, sf).withColumn("path", _doc_path()), "path")


# ---- filters ------------------------------------------------------------------------

@query("flt1_not_blank", f"""
SELECT doc_id, text FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(160) || chr(9) WHEN 1 THEN NULL ELSE text END AS text
  FROM documents) WHERE {strip("coalesce(text, '')")} <> ''""")
def flt1(spark, sf):
    k = F.col("doc_id") % 4
    d = documents(spark, sf).select("doc_id", F.when(k == 0, "\u00a0\t").when(k > 1, F.col("text")).alias("text"))
    return d.filter(T.not_blank("text"))


def preference_rows(spark, sf):
    """Conversations as preferences: first user text, first and second answer."""
    from pyspark.sql import Window
    c = conversations(spark, sf)
    w = Window.partitionBy("conv_id").orderBy("turn")
    top = (c.filter(F.col("role") == "assistant").withColumn("rn", F.row_number().over(w))
           .filter(F.col("rn") <= 2))
    pick = lambda i: F.coalesce(F.max(F.when(F.col("rn") == i, F.col("text"))), F.lit(""))
    answers = top.groupBy("conv_id").agg(pick(1).alias("chosen"), pick(2).alias("rejected"))
    users = c.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"))
    d = users.join(answers, "conv_id", "left")
    return d.select("conv_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("prompt", "chosen", "rejected")])


@query("flt2_valid_preference", f"""
WITH {PREFS} SELECT conv_id, prompt, chosen, rejected FROM prefs
WHERE prompt <> '' AND length({strip('chosen')}) > 8 AND length({strip('rejected')}) > 8
  AND {strip('chosen')} <> {strip('rejected')}""")
def flt2(spark, sf):
    return preference_rows(spark, sf).filter(T.valid_preference("prompt", "chosen", "rejected"))


_RATIO = """CASE WHEN c = '' THEN 0.0 ELSE length(regexp_replace(substr(c, 1, 200), '[^\\x20-\\x7e]', '', 'g'))
  / CAST(length(substr(c, 1, 200)) AS DOUBLE) END"""


@query("flt3_clean_pair", f"""
SELECT doc_id FROM (SELECT doc_id, source AS p, chr(10) || text AS c FROM documents)
WHERE length({strip('c')}) >= 16 AND length(p) + length(c) BETWEEN 16 AND 4000 AND {_RATIO} >= 0.7""")
def flt3(spark, sf):
    d = documents(spark, sf).withColumn("c", F.concat(F.lit("\n"), "text"))
    return d.filter(T.clean_pair("source", "c")).select("doc_id")


@query("flt4_ascii_ratio", f"""
SELECT doc_id, round({_RATIO}, 8) AS ratio FROM (SELECT doc_id, chr(10) || text AS c FROM documents)""")
def flt4(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.round(T.ascii_ratio(F.concat(F.lit("\n"), "text")), 8).alias("ratio"))


@query("flt5_pair_present", """
SELECT conv_id, coalesce(u, '') AS u, coalesce(a, '') AS a FROM (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS u,
         arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
WHERE coalesce(u, '') <> '' OR coalesce(a, '') <> ''""")
def flt5(spark, sf):
    first = lambda r: F.coalesce(F.min_by("text", F.when(F.col("role") == r, F.col("turn"))), F.lit(""))
    d = conversations(spark, sf).groupBy("conv_id").agg(first("user").alias("u"), first("assistant").alias("a"))
    return d.filter(T.pair_present("u", "a"))


@query("flt6_cap_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150")
def flt6(spark, sf):
    return mixing.cap_rows(documents(spark, sf).select("doc_id", "text"), 150, "doc_id")


@query("flt6_cap_rows_by_blocks", "SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity FROM lineitem ORDER BY k LIMIT 20000")
def flt6_large(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_quantity")
    return index.first_n(d, 20_000, "k")


@query("utl1_prefix", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
  CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM documents""")
def utl1(spark, sf):
    d = documents(spark, sf).select("doc_id", "n_chars")
    d = index.row_index(d, "doc_id", "idx")
    return index.prefix_sum(d, F.col("n_chars"), "start", "doc_id").drop("n_chars")

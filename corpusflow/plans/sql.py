"""SQL fragments shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import WS_CHARS

# The white-space set as a trim argument and as an RE2 class.
WS_TRIM = f"'{WS_CHARS}'"
WS_RE = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS_TRIM})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS_RE}]+'), lambda w: w <> '')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


def lines_cte(tbl: str = "documents", key: str = "doc_id", cols: str = "") -> str:
    """``dlines``: key, 1-based line_no, line."""
    extra = f", {cols}" if cols else ""
    return f"""dlines AS (
  SELECT {key}{extra}, i AS line_no, ls[i] AS line
  FROM (SELECT {key}{extra}, string_split(text, {NL}) AS ls FROM {tbl}) d,
       unnest(range(1, len(ls) + 1)) t(i))"""


def tokens_cte(tbl: str = "documents", key: str = "doc_id", cols: str = "") -> str:
    """``toks``: words of non-blank lines with a newline after each line."""
    extra = f", {cols}" if cols else ""
    return f"""{lines_cte(tbl, key, cols)},
wl AS (SELECT {key}{extra}, line_no, list_append({words('line')}, {NL}) AS ws
       FROM dlines WHERE {strip('line')} <> ''),
toks AS (SELECT {key}{extra}, line_no, j, ws[j] AS tok FROM wl, unnest(range(1, len(ws) + 1)) u(j))"""


def vocab_cte(size: int, tbl: str = "documents", name: str = "vocab") -> str:
    """``vocab``: token, n, id over the words of a text table."""
    return f"""{name}_n AS (SELECT token, count(*) AS n FROM
    (SELECT unnest({words('text')}) AS token FROM {tbl}) GROUP BY token),
{name} AS (SELECT token, n, 2 + row_number() OVER (ORDER BY n DESC, token) AS id
    FROM (SELECT * FROM {name}_n ORDER BY n DESC, token LIMIT {size - 3}))"""


def ids_cte(size: int, tbl: str = "documents", key: str = "doc_id", cols: str = "",
            vocab_tbl: str = "documents", line_end: int = 2) -> str:
    """``ids``: token ids of all lines with their place in the corpus (``pos``)."""
    extra = f", {cols}" if cols else ""
    return f"""{tokens_cte(tbl, key, cols)}, {vocab_cte(size, vocab_tbl)},
ids AS (SELECT {key}{extra}, line_no, j,
    CASE WHEN tok = {NL} THEN {line_end} ELSE coalesce(v.id, 0) END AS id,
    row_number() OVER (ORDER BY {key}, line_no, j) - 1 AS pos
  FROM toks LEFT JOIN vocab v ON toks.tok = v.token)"""


def words_cte(name: str, tbl: str, key: str, text: str, cols: str = "") -> str:
    """Words of a text column, one per row: ``key, j, tok`` (1-based j)."""
    extra = f", {cols}" if cols else ""
    return f"""{name} AS (SELECT {key}{extra}, j, ws[j] AS tok FROM
  (SELECT {key}{extra}, {words(text)} AS ws FROM {tbl}) d, unnest(range(1, len(ws) + 1)) u(j))"""


FIRSTS = """firsts AS (SELECT conv_id,
    arg_min(text, turn) FILTER (WHERE role = 'system') AS s,
    arg_min(text, turn) FILTER (WHERE role = 'user') AS u,
    arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a
  FROM conversations GROUP BY conv_id)"""

PREFS = """answers AS (SELECT conv_id, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM conversations WHERE role = 'assistant'),
prefs AS (SELECT f.conv_id, coalesce(f.u, '') AS prompt, coalesce(x.text, '') AS chosen,
    coalesce(y.text, '') AS rejected
  FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS u
        FROM conversations GROUP BY conv_id) f
  LEFT JOIN answers x ON x.conv_id = f.conv_id AND x.rn = 1
  LEFT JOIN answers y ON y.conv_id = f.conv_id AND y.rn = 2)"""

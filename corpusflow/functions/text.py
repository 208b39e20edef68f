"""Text columns: trimming, cutting, extracting, and the row predicates on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters Python's str.isspace() accepts.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class body.
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"
# A run of white space. Most characters are visible ASCII; ruling those out first
# makes splitting about twice as fast.
WS_RUN = f"(?:(?![!-~]){WS})+"
# What Python's str.splitlines() breaks on.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Template texts and markers.
STOP_TEXT = "\nUser:"
ANSWER_MARK = "Assistant:\n"

# Keywords per bucket, tested in this order.
BUCKET_KEYWORDS = (
    ("fineweb", ("fineweb", "refinedweb", "commoncrawl", "ccnet")),
    ("books", ("book", "gutenberg")),
    ("code", ("code", "github", "the-stack", "starcoder")),
    ("math", ("math", "openwebmath", "gsm")),
    ("wikipedia", ("wiki", "wikipedia")),
)
OTHER_BUCKET = "misc"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """Null and missing both read as the empty string."""
    return F.coalesce(_col(c), F.lit(""))


# ---- trimming -------------------------------------------------------------

def strip(c: Column | str) -> Column:
    """Unicode-aware strip; plain ``trim`` only removes U+0020."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(WS_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(WS_CHARS))


def not_blank(c: Column | str) -> Column:
    return strip(text_or_empty(c)) != ""


def drop_cr(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\r"), F.lit(""))


# ---- cutting and extracting -------------------------------------------------

def cut_at_stop(c: Column | str, stop: str = STOP_TEXT) -> Column:
    """Everything before the first stop text, stripped."""
    return strip(F.substring_index(_col(c), stop, 1))


def after_mark(c: Column | str, mark: str = ANSWER_MARK) -> Column:
    """Text after the first mark; the whole text when there is none."""
    c = _col(c)
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + F.lit(len(mark)), F.length(c))).otherwise(c)


def boxed(c: Column | str) -> Column:
    r"""Content of the first ``\boxed{...}`` on one line, else empty."""
    return F.regexp_extract(_col(c), r"\\boxed\{([^\n]*?)\}", 1)


def hash_answer(c: Column | str) -> Column:
    """Integer after ``####``, null when absent."""
    got = F.regexp_extract(_col(c), f"####{WS}*(-?\\p{{Nd}}+)", 1)
    return F.nullif(got, F.lit(""))


def swap_name(c: Column | str, old: str, new: str) -> Column:
    return F.replace(_col(c), F.lit(old), F.lit(new))


def leading_newline(c: Column | str, relstrip: bool = True) -> Column:
    """Non-empty text gets exactly one newline in front unless it starts with one.

    ``relstrip`` drops other leading white space first (the training form); the
    evaluation form keeps it.
    """
    c = _col(c)
    body = lstrip(c) if relstrip else c
    return F.when((c != "") & ~c.startswith("\n"), F.concat(F.lit("\n"), body)).otherwise(c)


def truncate_user(c: Column | str, max_len: int | None) -> Column:
    c = _col(c)
    if max_len is None:
        return c
    return F.when(F.length(c) > max_len, rstrip(F.substring(c, 1, max_len))).otherwise(c)


# ---- splitting --------------------------------------------------------------

def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(_col(c), WS_RUN), "")


def split_lines(c: Column | str) -> Column:
    return F.split(_col(c), LINE_BREAKS)


def strict_json(c: Column | str) -> Column:
    """Variant of a text that is one whole JSON value, else null.

    ``try_parse_json`` stops after the first value and accepts what follows. Inside
    ``[...]`` and inside ``{"v":...}`` nothing can follow a value in both at once.
    """
    c = _col(c)
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    single = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(single & named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


# ---- projections ------------------------------------------------------------

def first_filled(*cols: Column | str) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def merge_fields(a: Column | str, b: Column | str) -> Column:
    return F.concat(text_or_empty(a), F.lit(" "), text_or_empty(b))


def classify_bucket(path: Column | str) -> Column:
    """Route a path by the first keyword group found anywhere in it."""
    low = F.lower(_col(path))
    rule = None
    for bucket, keys in BUCKET_KEYWORDS:
        hit = reduce(lambda x, y: x | y, [low.contains(k) for k in keys])
        rule = F.when(hit, bucket) if rule is None else rule.when(hit, bucket)
    return rule.otherwise(OTHER_BUCKET)


# ---- predicates ---------------------------------------------------------------

def ascii_ratio(c: Column | str, n: int = 200) -> Column:
    """Share of printable ASCII among the first ``n`` characters; empty gives 0."""
    head = F.substring(_col(c), 1, n)
    plain = F.length(F.regexp_replace(head, r"[^\x20-\x7e]", ""))
    return F.when(head == "", F.lit(0.0)).otherwise(plain / F.length(head))


def clean_pair(prompt: Column | str, completion: Column | str, min_chars: int = 16,
               max_chars: int = 4000, ratio: float = 0.7) -> Column:
    p, c = text_or_empty(prompt), text_or_empty(completion)
    total = F.length(p) + F.length(c)
    return ((F.length(strip(c)) >= min_chars) & total.between(min_chars, max_chars)
            & (ascii_ratio(c) >= ratio))


def valid_preference(prompt: Column | str, chosen: Column | str, rejected: Column | str,
                     min_len: int = 8) -> Column:
    p, a, b = text_or_empty(prompt), strip(text_or_empty(chosen)), strip(text_or_empty(rejected))
    return (p != "") & (F.length(a) > min_len) & (F.length(b) > min_len) & (a != b)


def pair_present(user: Column | str, assistant: Column | str) -> Column:
    return not_blank(user) | not_blank(assistant)

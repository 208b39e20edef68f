"""Answer checks and rewards: boolean or double Columns, kept in registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .text import NOT_WS, WS, boxed, split_lines, strict_json, strip, text_or_empty, words

# Parameters of the five standard checks.
JSON_KEYS = ("answer", "steps")
EMAIL_PATTERN = r"[a-z]{3}\d{2}@example\.com"
CODE_SNIPPETS = ("def is_palindrome", "return")
MAX_WORDS = 40
BULLETS = 3


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_text(value: str) -> Callable[[Column], Column]:
    """Predicate on a variant: the JSON string ``value``."""
    return lambda x: F.coalesce((F.schema_of_variant(x) == "STRING")
                                & (F.try_variant_get(x, "$", "string") == value), F.lit(False))


def json_has_keys(c: Column | str, keys: tuple[str, ...] = JSON_KEYS) -> Column:
    """JSON with all keys. Text from the first ``{`` counts when it ends with ``}``."""
    raw = text_or_empty(c)
    block = F.regexp_extract(strip(raw), r"(\{[\s\S]*\})\z", 1)
    v = strict_json(F.when(block != "", block).otherwise(raw))
    kind = F.schema_of_variant(v)
    as_list = F.try_variant_get(v, "$", "array<variant>")
    as_text = F.try_variant_get(v, "$", "string")
    ok = F.lit(True)
    for k in keys:
        field = F.variant_get(v, f'$["{k}"]', "variant").isNotNull()
        item = F.exists(as_list, _is_text(k))
        ok = ok & (F.when(kind.startswith("OBJECT"), field)
                   .when(kind.startswith("ARRAY"), item)
                   .when(kind == "STRING", as_text.contains(k))
                   .otherwise(False))
    return F.coalesce(ok, F.lit(False))


def count_bullets(c: Column | str) -> Column:
    return F.size(F.filter(split_lines(text_or_empty(c)),
                           lambda x: x.rlike(f"^{WS}*[-•*]{WS}+{NOT_WS}")))


def full_match(c: Column | str, pattern: str = EMAIL_PATTERN) -> Column:
    return strip(text_or_empty(c)).rlike(f"^(?:{pattern})\\z")


def contains_all(c: Column | str, parts: tuple[str, ...] = CODE_SNIPPETS) -> Column:
    t = text_or_empty(c)
    ok = F.lit(True)
    for p in parts:
        ok = ok & t.contains(p)
    return ok


def word_limit(c: Column | str, n: int = MAX_WORDS) -> Column:
    """At most ``n`` words and no dash in the first; an empty answer fails."""
    w = words(text_or_empty(c))
    return F.coalesce((F.size(w) <= n) & ~F.get(w, F.lit(0)).contains("-"), F.lit(False))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "json_format": json_has_keys,
    "bullets_3": lambda c: count_bullets(c) == BULLETS,
    "regex_email": full_match,
    "python_function": contains_all,
    "word_limit": word_limit,
}


def register_check(name: str, builder: Callable[[Column], Column]) -> None:
    CHECKS[name] = builder


def run_checks(df: DataFrame, answer: str, keys: list[str],
               checks: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per (answer, check): ``keys..., check, ok``. Narrow, no shuffle."""
    checks = CHECKS if checks is None else checks
    rows = F.array(*[F.struct(F.lit(n).alias("check"), b(F.col(answer)).alias("ok"))
                     for n, b in checks.items()])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.check", "r.ok")


def boxed_reward(completion: Column | str, truth: Column | str) -> Column:
    """1.0 when the boxed content equals the truth, else 0.0 (also for a null truth)."""
    return F.when(boxed(text_or_empty(completion)) == _c(truth), 1.0).otherwise(0.0)


REWARDS: dict[str, Callable[[Column, Column], Column]] = {"boxed": boxed_reward}


def reward(name: str) -> Callable[[Column, Column], Column]:
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name!r}; known: {', '.join(sorted(REWARDS))}")
    return REWARDS[name]


def register_reward(name: str, builder: Callable[[Column, Column], Column]) -> None:
    REWARDS[name] = builder

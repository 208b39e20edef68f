"""Instruction, chat and preference formats as Column builders.

A message list is ``array<struct<role, content>>``. Missing fields, roles and
lists read as empty text. Each builder returns a struct (or a string) so it can
be used in ``select`` and stays inside one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import (ANSWER_MARK, first_filled, hash_answer, leading_newline, strip, swap_name,
                   text_or_empty, truncate_user)

# Prompt templates.
INSTRUCTION_HEAD = "### Instruction:\n"
INPUT_HEAD = "\n### Input:\n"
RESPONSE_HEAD = "\n### Response:\n"
USER_HEAD = "User: "
EMPTY_USER_PROMPT = "User:\nAssistant:\n"
DEFAULT_PREFERENCE_PROMPT = "User: Please respond to this request.\nAssistant:\n"
IDENTITY_CHOSEN = "I am a helpful AI assistant. I aim to be truthful and helpful."
IDENTITY_REJECTED = "I cannot answer that question."
PAIR_SYSTEM = "You're a helpful assistant."
MATH_SYSTEM = ("You are a helpful assistant that solves problems step-by-step. "
               "Always include the final numeric answer inside \\boxed{}.")
END_OF_TEXT = "<|endoftext|>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pair(prompt: Column, completion: Column) -> Column:
    return F.struct(prompt.alias("prompt"), completion.alias("completion"))


def user_prompt(user: Column) -> Column:
    return F.concat(F.lit(USER_HEAD), user, F.lit("\n" + ANSWER_MARK))


# ---- access to message lists ------------------------------------------------

def by_role(msgs: Column | str, *roles: str) -> Column:
    return F.filter(_c(msgs), lambda m: m["role"].isin(*roles))


def has_role(msgs: Column | str, *roles: str) -> Column:
    return F.coalesce(F.exists(_c(msgs), lambda m: m["role"].isin(*roles)), F.lit(False))


def first_text(msgs: Column | str, *roles: str) -> Column:
    return text_or_empty(F.get(by_role(msgs, *roles), F.lit(0))["content"])


def nth_text(msgs: Column | str, n: int) -> Column:
    return text_or_empty(F.get(_c(msgs), F.lit(n))["content"])


# ---- instruction records ------------------------------------------------------

def _instruction_prompt(instruction: Column | str, extra: Column | str) -> Column:
    i, x = strip(text_or_empty(instruction)), strip(text_or_empty(extra))
    return F.concat(F.lit(INSTRUCTION_HEAD), i, F.lit("\n"),
                    F.when(x != "", F.concat(F.lit(INPUT_HEAD), x, F.lit("\n"))).otherwise(""),
                    F.lit(RESPONSE_HEAD))


def instruction_pair(instruction="instruction", extra="input", response="response") -> Column:
    return _pair(_instruction_prompt(instruction, extra), strip(text_or_empty(response)))


def instruction_text(instruction="instruction", extra="input", output="output") -> Column:
    return F.concat(_instruction_prompt(instruction, extra), strip(text_or_empty(output)))


def instruction_or_prompt_pair(instruction="instruction", prompt="prompt", output="output",
                               response="response") -> Column:
    return _pair(user_prompt(strip(first_filled(instruction, prompt))),
                 F.concat(F.lit("\n"), strip(first_filled(output, response))))


def pair_text(prompt="prompt", completion="completion") -> Column:
    return strip(F.concat(text_or_empty(prompt), text_or_empty(completion)))


# ---- chats ----------------------------------------------------------------------

def first_exchange_pair(msgs="messages") -> Column:
    return _pair(strip(first_text(msgs, "user")), strip(first_text(msgs, "assistant")))


def first_two_pair(msgs="messages") -> Column:
    return _pair(strip(nth_text(msgs, 0)), strip(nth_text(msgs, 1)))


def dialog_text(msgs="messages") -> Column:
    def one(m: Column) -> Column:
        role = F.coalesce(m["role"], F.lit("user"))
        body = strip(text_or_empty(m["content"]))
        return (F.when(role == "user", F.concat(F.lit("<s>user: "), body, F.lit("</s>")))
                .when(role == "assistant", F.concat(F.lit("assistant: "), body, F.lit("</s>")))
                .otherwise(F.concat(role, F.lit(": "), body)))
    return F.coalesce(F.array_join(F.transform(_c(msgs), one), ""), F.lit(""))


def _chat_prompt(msgs: Column | str) -> Column:
    return F.when(has_role(msgs, "user"), user_prompt(strip(first_text(msgs, "user")))
                  ).otherwise(EMPTY_USER_PROMPT)


def chat_pair(msgs="messages") -> Column:
    """User/Assistant template; the completion is one newline when nobody answers."""
    return _pair(_chat_prompt(msgs), F.concat(F.lit("\n"), strip(first_text(msgs, "assistant"))))


def chat_pair_or_empty(msgs="messages") -> Column:
    """As ``chat_pair`` with an empty completion when nobody answers."""
    return _pair(_chat_prompt(msgs),
                 F.when(has_role(msgs, "assistant"),
                        F.concat(F.lit("\n"), strip(first_text(msgs, "assistant")))).otherwise(""))


def flat_message_pair(role="role", text="text") -> Column:
    body = strip(text_or_empty(text))
    answer = F.coalesce(_c(role) == "assistant", F.lit(False))
    return _pair(F.when(answer, EMPTY_USER_PROMPT).otherwise(user_prompt(body)),
                 F.when(answer, F.concat(F.lit("\n"), body)).otherwise("\n"))


def rendered_chat(msgs="messages") -> Column:
    def one(m: Column) -> Column:
        body = text_or_empty(m["content"])
        return (F.when(m["role"] == "system", F.concat(F.lit("System: "), body, F.lit("\n")))
                .when(m["role"] == "user", F.concat(F.lit("User: "), body, F.lit("\n")))
                .when(m["role"] == "assistant",
                      F.concat(F.lit("Assistant: "), body, F.lit(f" {END_OF_TEXT}")))
                .otherwise(""))
    return F.coalesce(F.array_join(F.transform(_c(msgs), one), ""), F.lit(""))


def sample_view(msgs="messages") -> Column:
    return F.struct(first_text(msgs, "user").alias("user_prompt"),
                    first_text(msgs, "assistant").alias("assistant_response"))


# ---- preferences ----------------------------------------------------------------

def _block(text: Column | str, msgs: Column | str) -> tuple[Column, Column]:
    """(user, answer) of a block that is either a string or a message list."""
    t, m = _c(text), _c(msgs)
    user = F.when(t.isNotNull(), "").otherwise(strip(first_text(m, "user", "prompter")))
    answer = F.when(t.isNotNull(), strip(t)).otherwise(strip(first_text(m, "assistant")))
    return user, answer


def preference_triple(chosen_text, chosen_msgs, rejected_text, rejected_msgs, prompt="prompt",
                      max_user_len: int | None = None, relstrip: bool = True) -> Column:
    uc, ac = _block(chosen_text, chosen_msgs)
    ur, ar = _block(rejected_text, rejected_msgs)
    user = truncate_user(strip(first_filled(uc, ur, prompt)), max_user_len)
    return F.struct(user_prompt(user).alias("prompt"),
                    leading_newline(ac, relstrip).alias("chosen"),
                    leading_newline(ar, relstrip).alias("rejected"))


def identity_triple(conversations="conversations") -> Column:
    """Last human message with fixed answers (share-style ``from``/``value`` lists)."""
    human = F.filter(_c(conversations), lambda m: m["from"] == "human")
    last = text_or_empty(F.try_element_at(human, F.lit(-1))["value"])
    return F.struct(user_prompt(last).alias("prompt"), F.lit(IDENTITY_CHOSEN).alias("chosen"),
                    F.lit(IDENTITY_REJECTED).alias("rejected"))


def plain_triple(prompt="prompt", chosen="chosen", rejected="rejected") -> Column:
    p = strip(text_or_empty(prompt))
    return F.struct(F.when(p == "", DEFAULT_PREFERENCE_PROMPT).otherwise(p).alias("prompt"),
                    strip(text_or_empty(chosen)).alias("chosen"),
                    strip(text_or_empty(rejected)).alias("rejected"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _thread(system: str, user: Column, answer: Column | None = None) -> Column:
    parts = [_message("system", F.lit(system)), _message("user", user)]
    if answer is not None:
        parts.append(_message("assistant", answer))
    return F.array(*parts)


def reply_pair(prompt, reply, old: str, new: str, system: str = PAIR_SYSTEM) -> Column:
    """One reply as the rejected side, the same reply with a name swapped as the chosen."""
    p, r = text_or_empty(prompt), text_or_empty(reply)
    return F.struct(_thread(system, p, swap_name(r, old, new)).alias("chosen"),
                    _thread(system, p, r).alias("rejected"))


def verifiable_record(question="question", answer="answer", system: str = MATH_SYSTEM) -> Column:
    return F.struct(hash_answer(answer).alias("ground_truth"),
                    _thread(system, text_or_empty(question)).alias("prompt"))


# ---- registry -------------------------------------------------------------------

FORMATTERS: dict[str, Callable[..., Column]] = {
    "alpaca": instruction_text,
    "dolly": instruction_pair,
    "chat": dialog_text,
    "generic_chat": first_two_pair,
    "ultrachat": first_exchange_pair,
    "ultrachat_template": chat_pair,
    "hermes": instruction_or_prompt_pair,
    "oasst": flat_message_pair,
    "ultrafeedback": preference_triple,
    "identity": identity_triple,
    "custom": plain_triple,
    "math": verifiable_record,
}


def formatter(name: str) -> Callable[..., Column]:
    try:
        return FORMATTERS[name]
    except KeyError:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(sorted(FORMATTERS))}") from None


def register_formatter(name: str, builder: Callable[..., Column]) -> None:
    FORMATTERS[name] = builder

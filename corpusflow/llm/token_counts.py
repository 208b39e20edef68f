"""Token counts with a whole-token shortcut (operator 4).

No piece of the vocabulary holds the space mark after another character, so merges never cross
the start of a run of space marks; a character that no longer piece holds is crossed by none
either. Texts are cut there into pre-tokens that are encoded independently. Both facts, and
that the library neither changes nor drops characters, are checked on the model first; if one
fails, whole texts are encoded.

Which vocabulary strings encode alone as one token is proved once by encoding each; pre-tokens
among them count 1 without any merging, and so do words between single spaces that are one
with their space mark. The library merges the rest, each distinct one once while remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
MEMO = 200_000  # remembered pre-tokens of a task; emptied when full, which changes no count


class Counter:
    """Counts tokens of single texts; built once per task from the model's bytes."""

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        joined = {c for p in pieces if len(p) > 1 for c in p} | {MARK}
        plain = "a  b ﬁ Å　 c\n \td "
        self.cuts = (not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
                     and sp.decode(sp.encode(plain)) == plain and sp.encode("a", out_type=str)[0].startswith(MARK))
        # a lone character ends up alone, so a line break in front of a pre-token hides the mark
        # that the library sets before a text
        self.front = len(sp.encode("\n"))
        self.line = sp.encode("\n")[-1]
        if not self.cuts or "\n" in joined or self.front != 2:
            self.cuts = False
            return
        inner = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        self.pattern = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]+")
        self.whole = {p: 1 for p in pieces if self.pattern.fullmatch(p) and self._merge([p]) == [1]}
        self.parts = dict(self.whole)
        self.start = {p[1:]: 1 for p in self.whole if p[0] == MARK and p[1:2] not in ("", MARK)}
        self.start[MARK] = 1
        self.memo = dict(self.start)

    def _merge(self, parts: list[str]) -> list[int]:
        """Tokens of each pre-token, by the library: one call, line breaks between them."""
        alone = [p for p in parts if "\n" in p]
        other = {p: len(self.sp.encode("\n" + p)) - self.front for p in alone}
        ids = np.array(self.sp.encode("".join(["\n" + p for p in parts if "\n" not in p]), num_threads=1), np.int64)
        ends = np.append(np.flatnonzero(ids == self.line), len(ids))
        sizes = iter((np.diff(ends) - 1).tolist())
        return [other[p] if p in other else next(sizes) for p in parts]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text, num_threads=1))
        return sum(self._count(x) for x in self._slices(text))

    def _slices(self, text: str, size: int = 1 << 20) -> Iterator[str]:
        """Parts of a very long text, cut before a space after another character."""
        at = 0
        while len(text) - at > size:
            end = text.find(" ", at + size)
            while end > 0 and text[end - 1] in (" ", MARK):
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def _count(self, text: str) -> int:
        """Tokens of a space mark and ``text``."""
        if len(self.memo) > MEMO:
            self.memo = dict(self.start)
        # words between single spaces; a line break stands in front of a word without a mark
        words = text.replace("\n", " \n").split(" ")
        if words[0] == "" and text[0] == "\n":
            words[0] = MARK
        if "" in words or MARK in text:  # runs of spaces belong together
            return self._pre_tokens(self.pattern.findall(MARK + text.replace(" ", MARK)))
        n = list(map(self.memo.get, words))
        if None in n:
            new = list(dict.fromkeys(w for w, k in zip(words, n) if k is None))
            ids = self.sp.encode("".join([w if w[0] == "\n" else "\n" + MARK + w for w in new]), num_threads=1)
            ends = np.append(np.flatnonzero(np.array(ids) == self.line), len(ids))
            sizes = (np.diff(ends) - 1).tolist()
            self.memo.update((w, k + (w[0] == "\n")) for w, k in zip(new, sizes))
            n = map(self.memo.__getitem__, words)
        return sum(n)

    def _pre_tokens(self, parts: list[str]) -> int:
        """Sum over pre-tokens: 1 for whole tokens, the library's merges for the rest."""
        if len(self.parts) > MEMO:
            self.parts = dict(self.whole)
        new = [p for p in dict.fromkeys(parts) if p not in self.parts]
        if new:
            self.parts.update(zip(new, self._merge(new)))
        return sum(map(self.parts.__getitem__, parts))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes (UTF-8), n_tokens and over_limit.

    ``model_path`` is a sentencepiece BPE model the driver can read; its bytes travel with the
    plan. No begin, end or other special tokens; special strings in a text are ordinary text. Null
    text is empty and has 0 tokens; repeated rows and null ids are counted like any other; an empty
    table gives an empty result; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for b in batches:
            n = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col))

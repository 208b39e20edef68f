"""Arrow helpers for encoding: whole batches, no per-row Python.

``utf8_split_whitespace`` breaks on the same characters as the Column functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# flat words -> (ids, ids per word)
WordIds = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


PART_BYTES = 4 << 20  # of text that is split at a time; splitting takes many times as much memory


def in_parts(col: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` on runs of rows of about ``PART_BYTES``, so a task needs no more however long the texts of a batch are."""
    size = (pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not pa.types.is_list(col.type) else _list_bytes(col))
    part = (np.cumsum(size) - size) // PART_BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(col)]
    if len(cuts) <= 2:
        return work(col)
    return pa.concat_arrays([work(col.slice(a, b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])


def _list_bytes(col: pa.Array) -> np.ndarray:
    """Bytes of the strings of each list, with their offsets."""
    flat = pc.binary_length(col.flatten()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 4
    return _row_sums(flat, lengths(col))


def lengths(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more than 2**31 ids in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.array(ends.astype(np.int32))


def split_words(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each line and the line number of each word."""
    parts = pc.utf8_split_whitespace(lines)
    flat = parts.flatten()
    line_of = np.repeat(np.arange(len(lines)), lengths(parts))
    full = pc.not_equal(flat, "")
    return flat.filter(full), line_of[full.to_numpy(zero_copy_only=False)]


def split_lines(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    parts = pc.split_pattern(text, "\n")
    return parts.flatten(), lengths(parts)


def kept_lines(lines: pa.Array, line_of: np.ndarray, keep_blank: bool) -> np.ndarray:
    """1 for lines that are kept: with a word, or merely not empty with ``keep_blank``."""
    if keep_blank:
        return pc.not_equal(lines, "").to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.bincount(line_of, minlength=len(lines)) > 0).astype(np.int64)


def _row_sums(per_line: np.ndarray, lines_per_row: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(per_line)])
    rows = np.concatenate([[0], np.cumsum(lines_per_row)])
    return np.diff(ends[rows])


def count_line_tokens(text: pa.Array, keep_blank: bool) -> pa.Array:
    """Words of all kept lines plus one end mark per line."""
    return in_parts(text, lambda part: _count_line_tokens(part, keep_blank))


def _count_line_tokens(text: pa.Array, keep_blank: bool) -> pa.Array:
    lines, per_row = split_lines(text)
    words, line_of = split_words(lines)
    n = np.bincount(line_of, minlength=len(lines)) + kept_lines(lines, line_of, keep_blank)
    return pa.array(_row_sums(n, per_row).astype(np.int32))


def line_ids(text: pa.Array, word_ids: WordIds, line_end: int, keep_blank: bool) -> pa.Array:
    """Ids of all kept lines in order, ``line_end`` after each."""
    return in_parts(text, lambda part: _line_ids(part, word_ids, line_end, keep_blank))


def _line_ids(text: pa.Array, word_ids: WordIds, line_end: int, keep_blank: bool) -> pa.Array:
    lines, per_row = split_lines(text)
    words, line_of = split_words(lines)
    ids, width = word_ids(words)
    kept = kept_lines(lines, line_of, keep_blank)
    n = np.bincount(line_of, weights=width, minlength=len(lines)).astype(np.int64) + kept
    out = np.full(int(n.sum()), line_end, np.int32)
    # an id moves right by the number of end marks before its line
    marks_before = np.cumsum(kept) - kept
    out[np.arange(len(ids)) + np.repeat(marks_before[line_of], width)] = ids
    return pa.ListArray.from_arrays(offsets(_row_sums(n, per_row)), pa.array(out))


def text_ids(text: pa.Array, word_ids: WordIds) -> pa.Array:
    """Ids of all words of a text."""
    return in_parts(text, lambda part: _text_ids(part, word_ids))


def _text_ids(text: pa.Array, word_ids: WordIds) -> pa.Array:
    words, row_of = split_words(text)
    ids, width = word_ids(words)
    n = np.bincount(row_of, weights=width, minlength=len(text)).astype(np.int64)
    return pa.ListArray.from_arrays(offsets(n), pa.array(ids))


def list_ids(tokens: pa.Array, word_ids: WordIds) -> pa.Array:
    """Ids of ready-made token lists."""
    return in_parts(tokens, lambda part: _list_ids(part, word_ids))


def _list_ids(tokens: pa.Array, word_ids: WordIds) -> pa.Array:
    ids, width = word_ids(tokens.flatten().cast(pa.string()))
    ends = np.concatenate([[0], np.cumsum(width)])
    rows = np.concatenate([[0], np.cumsum(lengths(tokens))])
    return pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), pa.array(ids))

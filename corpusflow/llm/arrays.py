"""Numpy views of Arrow text columns: bytes, words, window hashes and sampled anchors.

A *unit* is a byte or a word, given as a 64-bit code. An *anchor* is a unit position picked
by winnowing: every window of ``length`` units holds at least one, and equal windows hold
theirs at the same place. About ``2 / (length - gram)`` of all positions are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_S31, _S29, _S32 = U64(31), U64(29), U64(32)
PIECE = 1 << 16
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(9, 14)]] = True


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b); the order matters."""
    x = a * _A
    x += b
    x ^= x >> _S31
    x *= _B
    x ^= x >> _S29
    return x


def _codes(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)
    return mix(mix(x, x), x)


BYTE_CODES = _codes(256, 1)
PAD = _codes(1, 77)[0]  # stands before the first and after the last unit of a text


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o.astype(np.int64)


_STEP = U64(0x2545F4914F6CDD1D)
_BACK = U64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_SPAN = 1 << 20


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(_SPAN + 1, base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW: list[np.ndarray] = []


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit codes of the white-space separated words of some bytes."""
    if not _POW:
        _POW.extend((_powers(_STEP), _powers(_BACK)))
    full = np.empty(len(data) + 2, bool)
    full[0] = full[-1] = False
    np.logical_not(SPACES[data], out=full[1:-1])
    edge = np.flatnonzero(full[1:] != full[:-1])
    starts, ends = edge[::2], edge[1::2]
    codes = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):  # runs of words within _SPAN bytes; a longer word is cut into several sums
        base = starts[i]
        j = int(np.searchsorted(ends, base + _SPAN, "right"))
        if j <= i:
            h = U64(0)
            for a in range(base, ends[i], _SPAN):
                part = BYTE_CODES[data[a:min(a + _SPAN, ends[i])]]
                h = mix(np.array([h]), np.array([(part * _POW[0][:len(part)]).sum(dtype=U64)]))[0]
            codes[i] = h
            i += 1
            continue
        part = BYTE_CODES[data[base:ends[j - 1]]] * _POW[0][:ends[j - 1] - base]
        run = np.concatenate([np.zeros(1, U64), np.cumsum(part, dtype=U64)])
        s, e = starts[i:j] - base, ends[i:j] - base
        codes[i:j] = mix((run[e] - run[s]) * _POW[1][s], (e - s).astype(U64))
        i = j
    return starts, ends, codes


def row_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all rows, and where each row's words begin and end."""
    codes, cuts = [], np.zeros(len(off), np.int64)
    for r in range(len(off) - 1):
        c = word_codes(data[off[r]:off[r + 1]])[2]
        codes.append(c)
        cuts[r + 1] = cuts[r] + len(c)
    return (np.concatenate(codes) if codes else np.zeros(0, U64)), cuts


def grams(u: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` units from each position on; built from powers of two."""
    out, cur, size, done = None, u, 1, 0
    while True:
        if k & size:
            if out is None:
                out = cur
            else:
                m = len(u) - done - size + 1
                out = mix(out[:m], cur[done:done + m])
            done += size
        if size * 2 > k:
            return out[:len(u) - k + 1]
        cur = mix(cur[:-size], cur[size:])
        size *= 2


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over each ``w`` neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:len(x) - (w - size)], x[w - size:]) if w > size else x


def gram_size(length: int) -> int:
    return max(1, length // 5)


def _pieces(cuts: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lists of (row, core start, core end, start, end), about PIECE units a list.

    A long row is cut into cores with ``length`` units of its own text on both sides, so
    memory does not follow the longest row.
    """
    batch, n = [], 0
    for r in range(len(cuts) - 1):
        a, b = int(cuts[r]), int(cuts[r + 1])
        if b - a < length:
            continue
        for s in range(a, b, PIECE):
            e = min(s + PIECE, b)
            lo, hi = max(a, s - length), min(b, e + length)
            batch.append((r, s, e, lo, hi))
            n += hi - lo + length
            if n >= PIECE:
                yield batch
                batch, n = [], 0
    if batch:
        yield batch


def anchors(units: np.ndarray, cuts: np.ndarray, length: int, codes: np.ndarray | None = None):
    """Yield (row, position in the row, gram hash, context hash) of the anchors.

    The context of an anchor at ``p`` is ``[p - (length - gram), p + length)``: every window
    that can hold the anchor's gram. Places outside the text count as one special unit.
    ``codes`` maps small units (bytes) to 64-bit codes.
    """
    k = gram_size(length)
    w = length - k + 1
    steps = sorted({*range(-(w - 1), w, k), w - 1})
    gap = np.full(length, PAD, U64)
    for batch in _pieces(cuts, length):
        parts, at, begins = [gap], length, []
        for _, _, _, lo, hi in batch:
            part = units[lo:hi]
            parts += [codes[part] if codes is not None else part, gap]
            begins.append(at)
            at += hi - lo + length
        u = np.concatenate(parts)
        g = grams(u, k)
        order = (g >> _S32).astype(np.uint32)
        np.maximum(order, 1, out=order)
        least = _slide(order, w, np.minimum)
        real = np.zeros(len(least), bool)  # windows inside one text
        core = np.zeros(len(g), bool)
        for (_, s, e, lo, hi), b in zip(batch, begins):
            real[b:b + hi - lo - length + 1] = True
            core[b + s - lo:b + min(e, hi - k + 1) - lo] = True
        least[~real] = 0
        front = np.zeros(w - 1, np.uint32)
        most = _slide(np.concatenate([front, least, front]), w, np.maximum)[:len(g)]
        p = np.flatnonzero((most == order) & core)
        if not len(p):
            continue
        ctx = np.full(len(p), len(steps), U64)
        for step in steps:
            ctx = mix(ctx, g[p + step])
        which = np.searchsorted(begins, p, "right") - 1
        rows = np.array([x[0] for x in batch])[which]
        shift = np.array([x[3] - cuts[x[0]] for x in batch])[which] - np.array(begins)[which]
        yield rows, p + shift, g[p], ctx


def merge_spans(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Sorted, cut to ``[0, n)``, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        s, e = max(s, 0), min(e, n)
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]

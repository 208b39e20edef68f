"""Small tables with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, th int, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int = 1, words: int = 40, n: int = 40) -> list[str | None]:
    """Random texts with copies, near copies, shared passages, periods, blanks, nulls and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    make = lambda k: r.choice([" ", "  ", "\n", "\t"]).join(r.choice(vocab) for _ in range(k))
    out: list[str | None] = [make(r.randrange(0, words)) for _ in range(n)]
    passage = make(words)
    out += [make(3) + " " + passage + " " + make(2), make(1) + " " + passage, passage + " x", passage[: len(passage) // 2]]
    out += [out[2], out[2], out[3] and out[3] + " y", None, "", " \n\t ", "a" * 60, "ab " * 40, "ab " * 41, "É ß ſ K"]
    out += [" ".join(r.choice(vocab) for _ in range(5000))]
    return out


def table(spark, rows: list[str | None], partitions: int = 3):
    data = [(i, t, "en", [None, "b", "a", "c"][i % 4], None, 0.5, "s", 1, "x") for i, t in enumerate(rows)]
    data += [(None, "a null id", None, None, 1, None, None, None, None), (0, rows[0], "en", None, None, 0.5, "s", 1, "x"),
             (1, "another text of a repeated id", "en", "a", None, 0.5, "s", 1, "x")]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def covered(units: list[list], length: int) -> list[list[bool]]:
    seen = Counter(tuple(u[p:p + length]) for u in units for p in range(len(u) - length + 1))
    out = []
    for u in units:
        hit = [False] * len(u)
        for p in range(len(u) - length + 1):
            if seen[tuple(u[p:p + length])] > 1:
                hit[p:p + length] = [True] * length
        out.append(hit)
    return out


def phrases(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    return sorted((str(i), len(w), sum(h), b" ".join(x for x, k in zip(w, h) if not k).decode())
                  for (i, _), w, h in zip(rows, words, covered(words, length)))


def suffixes(rows, length):
    data = [list((t or "").encode()) for _, t in rows]
    return sorted((str(i), len(d), sum(h), sum(k and not (j and h[j - 1]) for j, k in enumerate(h)),
                   bytes(x for x, k in zip(d, h) if not k)) for (i, _), d, h in zip(rows, data, covered(data, length)))


def fingerprint(text: str | None) -> int:
    w = WORD.findall((text or "").translate(A_Z))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(fps: list[int]) -> list[int]:
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def components(fps: list[int], ids: list) -> list:
    of, least = classes(fps), {}
    for k, x in zip(of, ids):
        if x is not None and (least.get(k) is None or x < least[k]):
            least[k] = x
    return [least.get(k) for k in of]


def plain_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def contamination(rows, items, window):
    asked = []
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        asked += [(tuple(w[k:k + n]), str(i)) for k in range(len(w) - n + 1) if n]
    out = []
    for i, t in rows:
        w = plain_words(t)
        hit, found = set(), set()
        for a, item in asked:
            for p in range(len(w) - len(a) + 1):
                if tuple(w[p:p + len(a)]) == a:
                    hit |= set(range(p, p + len(a)))
                    found.add(item)
        out.append((str(i), len(w), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()

"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 3).

*Folding.* Letters that look like Latin ones become those, then everything is lower case, digit
and sign substitutions are undone, and i, l, 1 and | fall together, in texts and in the lexicon
alike. An entry of four letters or more matches at the start of a word, a shorter one is a whole word.

*Lexicon.* Learned from labelled texts, one of each group of near copies: word beginnings that are
far more frequent in toxic than in other texts, beyond chance, each with its log-odds as weight. A
beginning is lengthened while it keeps nearly all its texts. Neighbouring word pairs around an entry that appear in clean texts only are
*exception phrases*: an entry inside one does not count.

*Score.* The weights of a text's matches, as they are and normalised by its length, go through a
logistic fit on the same labelled texts. Fitting takes at most ``per_class`` texts of each label;
scoring covers every text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

# Look-alikes: the character on the left is read as the one on the right.
LOOK_ALIKE = str.maketrans(
    "аеорсухікмтвнѕјԁһԛԝ" "АЕОРСУХІКМТВНЅЈ" "αορνικτυχεη" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ɑɡıℓ",
    "aeopcyxikmtbhsjdhqw" "aeopcyxikmtbhsj" "aopviktuxen" "abezhikmnoptyx" "agil")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}  # full-width forms of ASCII
_WIDE |= dict.fromkeys([*range(0xA0, 0xC0), *range(0x2000, 0x2070)], " ")  # signs and punctuation
SUBSTITUTED = ("0134578@$|l", "oieastbasii")  # digits and signs, then what they stand for
_ASCII = bytearray(range(256))
for _c in range(128):
    if not chr(_c).isalnum():
        _ASCII[_c] = 0x20
    elif chr(_c).isupper():
        _ASCII[_c] = ord(chr(_c).lower())
for _a, _b in zip(*SUBSTITUTED):
    _ASCII[ord(_a)] = ord(_b)
_ASCII[ord("L")] = ord("i")
_ASCII = bytes(_ASCII)
# lead bytes of the UTF-8 forms of look-alikes
_LEADS = sorted({chr(c).encode()[:1] for c in [*LOOK_ALIKE, *_WIDE]})

SHORT, LONGEST = 4, 14  # characters of an entry that is a beginning; shorter words are entries with their end


def fold(text: str) -> str:
    """The folded text, one character per UTF-8 byte, blank where there is no letter."""
    if not text.isascii():
        raw = text.encode()
        if any(x in raw for x in _LEADS):
            text = text.translate(LOOK_ALIKE).translate(_WIDE)
        text = text.lower()
    return text.encode().translate(_ASCII).decode("latin-1")


@dataclass
class Lexicon:
    """Folded entries with weights, exception phrases, and the logistic fit."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    coef: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self):
        auto = ahocorasick.Automaton()
        for w, x in self.weights.items():
            auto.add_word(" " + w, (len(w), x))
        if self.weights:
            auto.make_automaton()
        return auto if self.weights else None


def hits(folded: str, auto, exceptions=frozenset()) -> tuple[float, int]:
    """Summed weights of the entries found, and how many."""
    total, n = 0.0, 0
    if auto is None:
        return total, n
    text = " " + folded + " "
    for end, (size, weight) in auto.iter(text):
        if exceptions:
            word, before, after = around(text, end - size + 1)
            if (before, word) in exceptions or (word, after) in exceptions:
                continue
        total += weight
        n += 1
    return total, n


def around(text: str, start: int) -> tuple[str, str, str]:
    """The word at ``start`` and its neighbours; empty at the ends."""
    end = text.find(" ", start)
    end = len(text) if end < 0 else end
    before = text[max(0, start - 60):start].split()
    after = text[end:end + 60].split()
    return text[start:end], before[-1] if before else "", after[0] if after else ""


def beginnings_of(word: str) -> list[str]:
    """What may become an entry: the beginnings of a word, or a short word with the blank that ends it."""
    if len(word) < SHORT:
        return [word + " "]
    return [word[:k] for k in range(SHORT, min(len(word), LONGEST) + 1)]


def features(total: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(total), math.log1p(100.0 * total / (words + 20.0))


def score(lex: Lexicon, total: float, words: int) -> float:
    z = sum(a * b for a, b in zip(lex.coef, features(total, words)))
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both labels have the same total weight."""
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (w * (p - y)) + 0.01 * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _surprise(a, b, share: float, log=math.log):
    """Likelihood ratio of ``a`` toxic among ``a + b`` texts against the share of all texts."""
    n = a + b
    return 2 * (a * log(a / (n * share)) + (b + 1e-9) * log((b + 1e-9) / (n * (1 - share))))


def _entries(counts: Iterable[tuple[str, int, int]], n_bad: int, n_good: int, odds: float) -> dict[str, float]:
    """Word beginnings to weights. ``counts``: (beginning, toxic texts, other texts)."""
    c = {w: (a, b) for w, a, b in counts}

    def weight(w: str) -> float:
        a, b = c[w]
        return math.log((a + 0.5) / (n_bad + 1)) - math.log((b + 0.5) / (n_good + 1))

    longer: dict[str, list[str]] = {}
    for w in c:
        longer.setdefault(w[:-1], []).append(w)
    out: dict[str, float] = {}
    for w in sorted(c, key=lambda w: (len(w), w)):
        if any(w[:k] in out for k in range(1, len(w))) or weight(w) < odds:
            continue
        while True:
            keeps = [x for x in longer.get(w, ()) if c[x][0] >= 0.9 * c[w][0]]
            if not keeps:
                break
            w = max(keeps, key=lambda x: c[x])
        out[w] = weight(w)
    return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """``(text, y)``: labelled texts, at most ``per_class`` of each label, chosen by a hash of the id.

    Chosen ids are few (``2 * per_class`` rows at most), so the join never moves the texts.
    """
    y = (labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
         .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("y")))
    known = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    y = y.join(known, "id").withColumn("h", F.xxhash64("id"))
    chosen = y.where("y = 1").orderBy("h", "id").limit(per_class).unionByName(
        y.where("y = 0").orderBy("h", "id").limit(per_class)).select("id", "y")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("text", "y")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One text of each label and least hash of a three-word shingle; near copies share it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = []
            for text in b.column("text").to_pylist():
                w = fold(text).split()
                sig.append(min((zlib.crc32(" ".join(w[i:i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("y"), pa.array(sig, pa.int64())], ["text", "y", "sig"])
    kind = rows.schema["y"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = rows.repartition(parts).mapInArrow(run, f"text string, y {kind}, sig bigint")
    return signed.groupBy("sig", "y").agg(F.min("text").alias("text")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 8000, surprise: float = 30.0, odds: float = 2.5,
          id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Lexicon and fit from ``labels`` (id, toxic). Without both labels everything scores low.

    Bound: ``per_class`` texts of each label, which bounds what the test against chance lets through.
    """
    rows = materialize(_one_of_each(sample(docs, labels, per_class, id_col, text_col)), "labelled")
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = seen.get(1, 0), seen.get(0, 0)
    if not n_bad or not n_good:
        return Lexicon()

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, good = Counter(), Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                (bad if y else good).update({x for w in set(fold(text).split()) for x in beginnings_of(w)})
            names = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([bad[w] for w in names], pa.int64()),
                 pa.array([good[w] for w in names], pa.int64())], ["w", "a", "b"])

    share = n_bad / (n_bad + n_good)
    counts = (rows.mapInArrow(beginnings, "w string, a bigint, b bigint").groupBy("w")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 0")
              .where((F.ln((F.col("a") + 0.5) / (n_bad + 1)) - F.ln((F.col("b") + 0.5) / (n_good + 1)) >= odds)
                     & (_surprise(F.col("a"), F.col("b"), share, F.ln) >= surprise)))
    lex = Lexicon(_entries([tuple(r) for r in counts.collect()], n_bad, n_good, odds))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            out: dict[tuple[str, str], list[int]] = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                t = " " + fold(text) + " "
                for end, (size, _) in auto.iter(t) if auto else ():
                    word, before, after = around(t, end - size + 1)
                    for p in ((before, word), (word, after)):
                        out.setdefault(p, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.string()),
                 pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.int64())],
                ["p", "q", "good", "bad"])

    found = (rows.mapInArrow(pairs, "p string, q string, good bigint, bad bigint").groupBy("p", "q")
             .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where((F.col("good") >= 4) & (F.col("bad") == 0)))
    lex.exceptions = frozenset((r["p"], r["q"]) for r in found.collect() if r["p"] and r["q"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            f = [fold(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hits(t, auto, lex.exceptions)[0] for t in f], pa.float64()),
                 pa.array([len(t.split()) for t in f], pa.int64()), b.column("y")], ["total", "words", "y"])

    kind = rows.schema["y"].dataType.simpleString()
    got = rows.mapInArrow(measured, f"total double, words bigint, y {kind}").orderBy("total", "words", "y").toArrow()
    x = np.array([features(t, n) for t, n in zip(got["total"].to_pylist(), got["words"].to_pylist())])
    if lex.weights:
        b = _logistic(x, np.array(got["y"].to_pylist(), float))
        lex.coef = (min(float(b[0]), -0.5), float(b[1]), float(b[2]))  # a text without a match is never toxic
    return lex


def score_texts(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns ``score`` (0 to 1), ``n_hits`` and ``weight`` in place of any of that name."""
    keep = [c for c in docs.columns if c not in ("score", "n_hits", "weight")]
    schema = docs.select(keep).schema.add("score", "double").add("n_hits", "long").add("weight", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for b in batches:
            s, n, w = [], [], []
            for text in b.column(text_col).to_pylist():
                t = fold(text or "")
                total, k = hits(t, auto, lex.exceptions)
                s.append(score(lex, total, len(t.split())))
                n.append(k)
                w.append(total)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(w, pa.float64())],
                [*keep, "score", "n_hits", "weight"])
    return docs.select(keep).mapInArrow(run, schema)


def training_labels(labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fold, ``crc32(id as text) mod folds``."""
    return labels.where(fold_of(F.col(id_col), folds) != held_out)


def fold_of(key, folds: int = 5):
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 8000,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text: all columns of ``docs`` plus score, n_hits, weight, held_out and predicted.

    Labels of the held-out fold are never read. Null and empty texts have no match and score as
    such; a null id belongs to the fold of the empty text; repeated rows are scored each; an empty
    table gives an empty result; columns of ``docs`` with a result's name are replaced.
    """
    lex = learn(docs, training_labels(labels, id_col=id_col), per_class, id_col=id_col, text_col=text_col)
    return (score_texts(docs, lex, id_col, text_col)
            .withColumn("held_out", fold_of(F.col(id_col)) == 0)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))

"""Secret scans: fixed rules, and a character convolutional network for the rest (operator 6).

A text has the spans of the rules and all other *candidates*: runs of key characters as long as the
shortest value of a rule, what a rule took cut out. Both are labelled findings: the rules' are secrets, the rest are not known
to be. As the rules' findings teach no more than the rules, keys of other ``FAMILIES`` are drawn and set in
the place of findings of the rest: as many labelled secrets whose surroundings tell nothing. The network reads
windows with the characters around them, overlapping along the whole of a long finding; the greatest score
counts. Training starts from a bounded number of windows of each label (secrets, others with a letter and a digit, others
without) and goes on over the windows of all rows: rows are dealt to lanes by hash, each lane trains a copy along all its
windows, and the mean of the copies is kept, as in parameter mixing. A window's loss is the logistic one, level beyond a
margin, so windows told apart clearly need no gradient. Each label has its share of the loss, however rare.
A third of each has its surroundings blanked so that the value itself must tell, a third of the rules'
secrets is set behind another finding, some of the last are also in capitals. A quarter of the rules' secrets, by hash, is never
trained on: the threshold is the greatest that still finds ``recall`` of all distinct ones of that quarter, and of drawn keys
of each family kept out. What passes is added to the rules' spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

# Keys drawn for training: beginnings, characters and lengths behind the beginning.
BASE36, BASE62 = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FAMILIES = {
    "hex": (("",), "0123456789abcdef", (16, 31)),
    "upper hex": (("",), "0123456789ABCDEF", (16, 48)),
    "base 36": (("",), BASE36, (20, 40)),
    "base 62": (("",), BASE62, (20, 64)),
    "base 64": (("",), BASE62 + "+/", (24, 88)),
    "prefixed": (("ghp_", "gho_", "sk_test_", "npm_", "hf_"), BASE62, (24, 40)),
    "dashed": (("sk-", "xoxb-", "key-"), BASE62, (24, 48)),
}

CANDIDATE_LEAST = 8
BEFORE, INSIDE, AFTER = 16, 40, 8
STEP = INSIDE // 2
SIZE = BEFORE + INSIDE + AFTER
GROUP = 1 << 18  # characters of texts whose windows are made together
LANE = 1 << 19  # windows a lane trains on, about
STEP_WINDOWS, STEP_KEYS, RATE, MARGIN = 4096, 32, 0.006, 4.0  # of training in lanes
LOUD = 16  # of so many windows without a letter and a digit, one is also seen in capitals
SHARES = {"rules": 0.25, "keys": 0.25, "mixed": 0.2, "plain": 0.2, "loud": 0.1}  # of the loss
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = bytes(0x78 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_LEAST)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches, in order."""
    raw = text.encode()
    out = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in raw.translate(_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters outside the spans of the rules; of a run that a span cuts, every part long enough."""
    out, k = [], 0
    for m in _TOKEN.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][2] <= at:
            k += 1
        i = k
        while i < len(base) and base[i][0] < end:
            if base[i][0] - at >= CANDIDATE_LEAST:
                out.append((at, base[i][0]))
            at = max(at, base[i][2])
            i += 1
        if end - at >= CANDIDATE_LEAST:
            out.append((at, end))
    return out


def window(text: str, s: int, e: int) -> str:
    """A fixed number of characters before, in and after a span."""
    return (text[max(0, s - BEFORE):s].rjust(BEFORE, "\0") + text[s:min(e, s + INSIDE)].ljust(INSIDE, "\0")
            + text[e:e + AFTER].ljust(AFTER, "\0"))


_CODES = np.array([0, *[1] * 31, *range(2, 97), 1], np.uint8)


def encode(windows: list[str]) -> np.ndarray:
    """Characters as numbers: 0 for outside the text, 1 for anything but printable ASCII."""
    flat = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), -1)
    return _CODES[np.minimum(flat, 127)]


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded windows along the spans, as in ``window``, and the number of the span of each.

    A span of up to ``INSIDE`` characters has one; a longer one has one every ``STEP`` and one at its end.
    """
    return windows_in(*joined([text], [spans]))


def joined(texts: list[str], spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The encoded texts, far enough apart for windows to meet one only, and all spans there as rows of start and end."""
    flat = encode(["\0" * BEFORE + "".join(t + "\0" * (INSIDE + AFTER) for t in texts)])[0]
    at = BEFORE + np.cumsum([0] + [len(t) + INSIDE + AFTER for t in texts])[:-1]
    return flat, np.array([x for k in spans for x in k], np.int64).reshape(-1, 2) + np.repeat(at, [len(k) for k in spans])[:, None]


def windows_in(flat: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of the spans of ``joined`` texts."""
    s, e = spans.T
    n = np.maximum(0, -((INSIDE + s - e) // STEP)) + 1
    of = np.repeat(np.arange(len(s)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    s, e = np.minimum(s[of] + STEP * step, np.maximum(s[of], e[of] - INSIDE)), e[of]
    e = np.minimum(e, s + INSIDE)
    view = np.lib.stride_tricks.sliding_window_view
    x = view(flat, BEFORE + INSIDE)[s - BEFORE] * _KEPT[e - s]
    return np.concatenate([x, view(flat, AFTER)[e]], 1), of


_KEPT = (np.arange(BEFORE + INSIDE) < BEFORE + np.arange(INSIDE + 1)[:, None]).astype(np.uint8)


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``GROUP`` characters together."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= GROUP:
            yield out
            out, size = [], 0
    if out:
        yield out


SYMBOLS = 98
ROUNDING = 1e-5  # of single precision, which may differ with the windows scored together


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over places, one output; then a calibrated threshold."""
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    WIDTH = 5

    @classmethod
    def start(cls, seed: int, dim: int = 8, filters: int = 24) -> "Network":
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (SYMBOLS, dim)), r.normal(0, (2 / (cls.WIDTH * dim)) ** 0.5, (cls.WIDTH * dim, filters)),
                   np.zeros(filters), np.r_[r.normal(0, 0.1, 2 * filters), 0.0])

    def _forward(self, x: np.ndarray):
        e = self.emb[x]
        n, t, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, 1).transpose(0, 1, 3, 2).reshape(n, t - self.WIDTH + 1, -1)
        z = cols @ self.conv + self.bias
        a = np.maximum(z, 0)
        at = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, at[:, None], 1)[:, 0], a.mean(1), np.ones((n, 1))], 1)
        return cols, z, at, pooled, pooled @ self.out

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores, in single precision: ``_forward`` without what only training needs.

        The convolution is a sum of rows of tables by pairs of characters. Windows of like length go together; of the
        places that see nothing but the filling behind a short value, one is computed.
        """
        f, w, out = len(self.bias), self.WIDTH, np.zeros(len(x))
        one, two, three, four, five = (self.emb @ self.conv.reshape(w, -1, f)).astype(np.float32)
        pairs = [(p[:, None] + q).reshape(-1, f) for p, q in ((one, two), (three, four))]
        five += self.bias.astype(np.float32)
        most, mean = self.out[:f].astype(np.float32), self.out[f:2 * f].astype(np.float32)
        empty = np.maximum(pairs[0][0] + pairs[1][0] + five[0], 0)
        filled = x[:, BEFORE + INSIDE - 1:BEFORE - 1:-1] > 0
        length = np.where(filled.any(1), INSIDE - filled.argmax(1), 0).astype(np.uint8)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(x), 128):
            rows = order[i:i + 128]
            end = BEFORE + int(length[rows[-1]]) + w
            left, part = max(0, BEFORE + INSIDE - end), x[rows]
            if left:
                part = np.concatenate([part[:, :end], part[:, BEFORE + INSIDE:]], 1)
            chars = np.ascontiguousarray(part.T).astype(np.intp)
            pair, t = chars[:-1] * len(self.emb) + chars[1:], len(chars) - w + 1
            a = pairs[0].take(pair[:t], 0)
            a += pairs[1].take(pair[2:2 + t], 0)
            a += five.take(chars[4:], 0)
            np.maximum(a, 0, out=a)
            out[rows] = a.max(0) @ most + (a.sum(0) + left * empty) @ (mean / np.float32(t + left)) + self.out[2 * f]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -40, 40)))

    def _gradients(self, x: np.ndarray, cols: np.ndarray, z: np.ndarray, at: np.ndarray, pooled: np.ndarray, d: np.ndarray):
        """Of the parameters, where ``d`` is the loss's derivative by each score."""
        f, (n, t, _) = len(self.bias), z.shape
        g_pool = d[:, None] * self.out[None, :2 * f]
        g_a = np.repeat(g_pool[:, None, f:] / t, t, 1)
        k, c = np.ogrid[:n, :f]
        g_a[k, at, c] += g_pool[:, :f]
        g_z = g_a * (z > 0)
        flat = g_z.reshape(-1, f)
        g_conv = cols.reshape(len(flat), -1).T @ flat
        g_cols = (flat @ self.conv.T).reshape(n, t, self.WIDTH, -1)
        g_x = np.zeros((n, x.shape[1], self.emb.shape[1]), flat.dtype)
        for w in range(self.WIDTH):
            g_x[:, w:w + t] += g_cols[:, :, w]
        g_emb = np.stack([np.bincount(x.ravel(), g.ravel(), len(self.emb)) for g in np.moveaxis(g_x, 2, 0)], 1)
        return g_emb, g_conv, g_z.sum((0, 1)), pooled.T @ d

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 8, rate: float = 0.01) -> None:
        """Adam on the weighted logistic loss."""
        r, adam = np.random.default_rng(seed), Adam(self.params, rate)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), 64):
                rows = order[i:i + 64]
                *places, s = self._forward(x[rows])
                d = weight[rows] * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y[rows]) / len(rows)
                adam.step(self._gradients(x[rows], *places, d))

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: "Adam") -> None:
        """One step on the logistic loss that is level beyond the margin: only what lies within has a gradient."""
        sign = np.where(y > 0, -1.0, 1.0)
        d = 1 / (1 + np.exp(-np.clip(sign * self.raw(x), -40, 40))) - 1 / (1 + np.exp(MARGIN))
        rows = np.flatnonzero(d > 0)
        if len(rows):
            single = self.with_params(np.concatenate([p.ravel() for p in self.params]).astype(np.float32))
            *places, _ = single._forward(x[rows])
            adam.step(single._gradients(x[rows], *places, ((sign * weight * d)[rows] / weight.sum()).astype(np.float32)))

    @property
    def params(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.bias, self.out]

    def with_params(self, flat: np.ndarray) -> "Network":
        parts = np.split(flat, np.cumsum([p.size for p in self.params])[:-1])
        return replace(self, **{k: v.reshape(p.shape) for k, v, p in zip(("emb", "conv", "bias", "out"), parts, self.params)})

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling, then the greatest threshold with at least ``recall`` of the secrets of each positive label."""
        s, is_secret = self.raw(x), y > 0
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
            w = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [((p - is_secret) * s).sum() + 1e-3 * (a - 1), (p - is_secret).sum()])
            a, b = a - da, b - db
        self.scale = (max(a, 1e-3), b)
        self.threshold = self.least(x, y, recall)

    def least(self, x: np.ndarray, y: np.ndarray, recall: float) -> float:
        """The greatest threshold that finds ``recall`` of the windows of each positive label."""
        sorts = [np.sort(self.probability(x[y == v])) for v in np.unique(y[y > 0])]
        return min((float(p[int((1 - recall) * len(p))]) - ROUNDING for p in sorts), default=2.0)

    def passes(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Whether a window of each span reaches the threshold."""
        return self.passes_in([text], [spans])

    def passes_in(self, texts: list[str], spans: list[list[tuple[int, int]]]) -> np.ndarray:
        """``passes`` of all spans of several texts, one after the other."""
        flat, spans = joined(texts, spans)
        x, of = windows_in(flat, spans)
        best = np.zeros(len(spans))
        np.maximum.at(best, of, self.probability(x))
        return best >= self.threshold


class Adam:
    """Steps of Adam on arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.n = params, rate, 0
        self.m1, self.m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: Iterable[np.ndarray]) -> None:
        self.n += 1
        for p, g, a, b in zip(self.params, grads, self.m1, self.m2):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= self.rate * (a / (1 - 0.9 ** self.n)) / (np.sqrt(b / (1 - 0.999 ** self.n)) + 1e-8)


def value_start(text: str, kind: int, s: int, e: int) -> int:
    """Where the value of a finding starts: behind the name for assignments."""
    return s + ASSIGN.match(text[s:e]).start(2) if kind == 0 else s


def _order(x: np.ndarray) -> np.ndarray:
    """A hash of each window."""
    h = np.zeros(len(x), np.uint64)
    for c in np.ascontiguousarray(x).view(np.uint64).T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def labelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, their labels and hashes.

    Labels: 2 for the rules' spans, 1 for candidates with a letter and a digit, 0 for the others.
    """
    bases = [base_spans(t) for t in texts]
    more = [candidates(t, b) for t, b in zip(texts, bases)]
    flat, spans = joined(texts, [[(value_start(t, k, s, e), e) for s, k, e in b] + m for t, b, m in zip(texts, bases, more)])
    rule = np.concatenate([np.arange(len(b) + len(m)) < len(b) for b, m in zip(bases, more)])
    both = np.bitwise_or.reduceat(_SORTS[flat], spans.ravel())[::2] == 3 if len(spans) else np.zeros(0, bool)
    x, of = windows_in(flat, spans)
    return x, np.where(rule, 2, both)[of], _order(x)


_SORTS = np.zeros(SYMBOLS, np.uint8)  # 1 for digits, 2 for letters
_SORTS[_CODES[[c for c in range(128) if chr(c).isdigit()]]] = 1
_SORTS[_CODES[[c for c in range(128) if chr(c).isalpha()]]] = 2


def held_out(h: np.ndarray) -> np.ndarray:
    """Whether windows of these hashes are kept out of training."""
    return h % np.uint64(4) == 3


@dataclass
class Findings:
    """What the rules and the candidates give in the ``texts`` of a table, made anew in each pass over it."""
    texts: DataFrame
    per_class: int

    def first(self) -> DataFrame:
        """``(label, h, window, n)``: of each label every task's ``per_class`` windows of least hash (``n`` null), and
        the number of all (``window`` null); label 3: the rules' spans kept out of training, all of them."""
        per_class = self.per_class

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: list[dict[bytes, int]] = [{}, {}, {}]
            bound, n = [1 << 64] * 3, [0, 0, 0]

            def cut(y: int) -> None:
                keep = sorted((h, w) for w, h in least[y].items())[:per_class]
                least[y] = {w: h for h, w in keep}
                if len(keep) == per_class:
                    bound[y] = keep[-1][0]

            def rows(label: int, hashes: list[int], found: list[bytes | None], n: list[int | None]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(found), pa.int32()), pa.array([h - 2**63 for h in hashes], pa.int64()),
                     pa.array(found, pa.binary()), pa.array(n, pa.int64())], ["label", "h", "window", "n"])
            for texts in groups(t for b in batches for t in b.column("text").to_pylist()):
                x, y, h = labelled(texts)
                for v in (0, 1, 2):
                    n[v] += int((y == v).sum())
                    at = np.flatnonzero((y == v) & (h <= np.uint64(min(bound[v], 2**64 - 1))))
                    least[v].update(zip(map(bytes, x[at]), h[at].tolist()))
                    if len(least[v]) > 4 * per_class:
                        cut(v)
                at = np.flatnonzero((y == 2) & held_out(h))
                if len(at):
                    yield rows(3, h[at].tolist(), list(map(bytes, x[at])), [None] * len(at))
            for v in (0, 1, 2):
                cut(v)
                yield rows(v, list(least[v].values()), list(least[v]), [None] * len(least[v]))
                yield rows(v, [0], [None], [n[v]])
        return self.texts.select("text").mapInArrow(run, "label int, h bigint, window binary, n bigint")

    def learned(self, net: Network, n: list[int], seed: int) -> Network:
        """The mean of copies of ``net``, each trained along all windows of a lane; ``n``: how many there are of each label.

        Rows go to lanes and are put in order there by hash, so the layout of the table does not matter.
        """
        share = {k: SHARES[k] * sum(n) / max(1, m) for k, m in
                 {"plain": n[0], "mixed": n[1], "rules": 0.75 * n[2], "loud": n[0] / LOUD}.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = replace(net, **{k: getattr(net, k).copy() for k in ("emb", "conv", "bias", "out")})
            adam, total = Adam(own.params, RATE), 0
            for texts in groups(t for b in batches for t in b.column("text").to_pylist()):
                every = labelled(texts)
                for i in range(0, len(every[0]), STEP_WINDOWS):
                    x, y, h = (v[i:i + STEP_WINDOWS] for v in every)
                    total += len(x)
                    rest, plain = x[y < 2], (y == 0) & (h // np.uint64(64) % np.uint64(LOUD) == 1)
                    use = (y < 2) | ~held_out(h)
                    weight = np.choose(y[use], [share["plain"], share["mixed"], share["rules"]])
                    if len(rest):
                        keys = planted(rest, STEP_KEYS, [seed, int(h[0])])
                        parts = [varied(x[use], h[use], y[use] == 2, rest), blanked(keys, np.arange(len(keys))), capitals(x[plain])]
                        weight = np.r_[weight, np.full(len(keys), SHARES["keys"] * len(x) / len(keys)), np.full(plain.sum(), share["loud"])]
                        target = np.r_[y[use] == 2, np.ones(len(keys), bool), np.zeros(plain.sum(), bool)]
                        own.learn(np.concatenate(parts), target, weight, adam)
                    elif use.any():
                        own.learn(varied(x[use], h[use], y[use] == 2, rest), y[use] == 2, weight, adam)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([p.ravel() for p in own.params]).tolist()], pa.list_(pa.float64())),
                                                  pa.array([total], pa.int64())], ["params", "n"])
        lanes = self.texts.repartition(-(-sum(n) // LANE), "k").sortWithinPartitions("k").select("text")
        means = (lanes.mapInArrow(run, "params array<double>, n bigint").select("n", F.posexplode("params").alias("at", "value"))
                 .groupBy("at").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value")).orderBy("at").collect())
        return net.with_params(np.array([r["value"] for r in means]))


def findings(docs: DataFrame, id_col: str, text_col: str, per_class: int = 1500) -> Findings:
    key = F.xxhash64(*[F.col(c) for c in (id_col, text_col) if c in docs.columns])
    return Findings(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("k")), per_class)


def blanked(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Windows, those whose ``u`` a third divides without their surroundings."""
    x, at = x.copy(), u % 3 == 0
    x[at, :BEFORE] = 0
    x[at, BEFORE + INSIDE:] = 0
    return x


def varied(x: np.ndarray, h: np.ndarray, secret: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Windows as the network is shown them, by their hash: a third blanked, and a third of the secrets
    behind the beginning of a long one of ``others``, as a key at the end of a path."""
    u = (h >> np.uint64(16)).astype(np.int64)
    out, long = blanked(x, u), others[others[:, BEFORE + INSIDE - 1] > 0]
    for i in np.flatnonzero(secret & (u % 3 == 1)) if len(long) else []:
        k, donor = BEFORE + (8, 16, 24)[u[i] // 3 % 3], long[u[i] // 9 % len(long)]
        out[i, :k] = donor[:k]
        out[i, k:BEFORE + INSIDE] = x[i, BEFORE:2 * BEFORE + INSIDE - k]
    return out


def capitals(x: np.ndarray) -> np.ndarray:
    """Windows in capitals, which texts hold too seldom for a sample to teach."""
    low = (x >= _CODES[ord("a")]) & (x <= _CODES[ord("z")])
    return np.where(low, x - np.uint8(32), x)


def drawn(r: np.random.Generator, family: tuple[tuple[str, ...], str, tuple[int, int]]) -> str:
    """A key of a family, with a letter and a digit."""
    heads, letters, (least, most) = family
    while True:
        key = heads[r.integers(len(heads))] + "".join(map(letters.__getitem__, r.integers(0, len(letters), r.integers(least, most + 1)).tolist()))
        if mixed(key):
            return key


def planted(hosts: np.ndarray, n: int, seed: int | list[int], families: dict = FAMILIES) -> np.ndarray:
    """One window of each of ``n`` drawn keys, family by family, in the place of what the windows ``hosts`` hold."""
    if not n:
        return np.zeros((0, SIZE), np.uint8)
    r, kinds = np.random.default_rng(seed), list(families.values())
    keys = [drawn(r, kinds[i % len(kinds)]) for i in range(n)]
    used = ["".join(_CHARS[c] for c in hosts[i % len(hosts)].tolist()) for i in range(n)]
    x, of = windows_in(*joined([u[:BEFORE] + k + u[BEFORE + INSIDE:] for u, k in zip(used, keys)],
                               [[(BEFORE, BEFORE + len(k))] for k in keys]))
    many = np.bincount(of, minlength=n)
    return x[np.cumsum(many) - many + r.integers(many)]


_CHARS = ["\0", "é", *map(chr, range(32, 128))]  # of the codes


def mixed(run: str) -> bool:
    return _DIGIT.search(run) is not None and _LETTER.search(run) is not None


def train(found: Findings, per_class: int = 1500, recall: float = 0.98, seed: int = 7) -> Network | None:
    """The network from all windows of ``findings``.

    It starts from at most ``per_class`` distinct windows of each label, chosen by hash, and as many drawn keys,
    no more than there are others. All windows then take part in training, and all rules' secrets kept out of it
    in the threshold, as do drawn keys kept out, family by family. The scale of the probabilities, which does not order
    them anew, is fitted to the first windows kept out.
    None without secrets and others: then only the rules count.
    """
    stored = materialize(found.first(), "findings")
    n = dict(stored.where("n IS NOT NULL").groupBy("label").agg(F.sum("n")).collect())
    parts = [stored.where(F.col("n").isNull() & (F.col("label") == y)).select("h", "window").distinct().orderBy("h", "window")
             .limit(per_class).collect() for y in (2, 1, 0)]
    (good, h_good), *others = ((np.frombuffer(b"".join(r["window"] for r in p), np.uint8).reshape(-1, SIZE),
                                np.array([r["h"] + 2**63 for r in p], np.uint64)) for p in parts)
    rest, h_rest = (np.concatenate(v) for v in zip(*others))
    if len(good) < 8 or len(rest) < 8:
        release(stored)
        return None
    keys = planted(rest, min(per_class, len(rest)), seed)
    loud = len(others[0][0]) + 1 + 3 * np.arange((len(others[1][0]) + 1) // 3)
    x = np.concatenate([varied(good, h_good, np.ones(len(good), bool), rest), blanked(keys, np.arange(len(keys))),
                        varied(rest, h_rest, np.zeros(len(rest), bool), rest), capitals(rest[loud])])
    y = np.r_[np.ones(len(good)), 2 + np.arange(len(keys)) % len(FAMILIES), np.zeros(len(rest) + len(loud))]
    held = np.r_[held_out(h_good), np.arange(len(keys)) % 4 == 3, held_out(h_rest), held_out(h_rest[loud])]
    net = Network.start(seed)
    net.fit(x[~held], (y[~held] > 0).astype(float), seed)
    net = found.learned(net, [n.get(v, 0) for v in (0, 1, 2)], seed)
    net.calibrate(x[held], y[held], recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = np.frombuffer(b"".join(b.column("window").to_pylist()), np.uint8).reshape(-1, SIZE)
                h = (b.column("h").to_numpy() ^ np.int64(-2**63)).view(np.uint64)
                p = net.probability(varied(w, h, np.ones(len(w), bool), rest))
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64())], ["p"])
    scores = materialize(stored.where("label = 3").select("h", "window").distinct().mapInArrow(run, "p double"), "scores")
    least = scores.orderBy("p").limit(int((1 - recall) * scores.count()) + 1).agg(F.max("p")).first()[0]
    of_keys = net.least(x[held & (y != 1)], y[held & (y != 1)], recall)
    net.threshold = min([of_keys, *([] if least is None else [least - ROUNDING])])
    release(scores)
    release(stored)
    return net


def scan(docs: DataFrame, per_class: int = 1500, recall: float = 0.98, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and spans, ``array<struct<kind, s, e>>`` by start, then kind.

    Positions are code points, the end exclusive. The rules' spans stay as they are; the network
    adds spans of kind ``model`` that touch none of them. Null text is empty and has no span; null
    ids and repeated rows are scanned like any other; an empty table gives an empty result;
    other columns are ignored.
    """
    net = train(findings(docs, id_col, text_col, per_class), per_class, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            out = [[{"kind": KINDS[k], "s": s, "e": e} for s, k, e in spans] for _, spans in spans_in(b.column("text").to_pylist(), net)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "spans"])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,s:bigint,e:bigint>>").withColumnRenamed("id", id_col)


def spans_of(text: str, net: Network | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' spans and of the candidates that the network passes, in order."""
    return next(spans_in([text], net))[1]


def spans_in(texts: Iterable[str], net: Network | None) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Each text with its ``spans_of``; candidates of texts next to each other are scored together."""
    for part in groups(texts):
        bases = [base_spans(t) for t in part]
        more = [candidates(t, b) for t, b in zip(part, bases)] if net else [[] for _ in part]
        ok = iter(net.passes_in(part, more)) if any(more) else iter(())
        for t, base, spans in zip(part, bases, more):
            yield t, sorted(base + [(s, 3, e) for s, e in spans if next(ok)])


def redact(docs: DataFrame, mark: str = "[SECRET]", per_class: int = 1500, recall: float = 0.98, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one mark. Null stays null."""
    net = train(findings(docs, id_col, text_col, per_class), per_class, recall)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = (masked(t, spans, mark) for t, spans in spans_in((t for t in texts if t), net))
            out = [t and next(new) for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)
    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    if not spans:
        return text
    parts, end = [], 0
    for s, _, e in spans:
        if s >= end:
            parts += [text[end:s], mark]
        end = max(end, e)
    return "".join([*parts, text[end:]])

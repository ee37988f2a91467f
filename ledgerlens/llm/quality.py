"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives ``FEATURES``, numbers made from its whole bytes. Training cuts each feature into quantile bins and
boosts shallow trees in turn, one feature at a time; a tree is added to the feature's lookup table and forgotten.
Then the ``PAIRS`` pairs of features that explain most of what is left get tables over pairs of coarse bins in the
same way. A score is the logistic of a sum of table entries, added up for whole batches at once.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id; everything else
covers all rows. Rows without a text have the features of an empty text. Without labels, or with one label only,
every score is the smoothed share of label 1 (0.5 without any). Null labels are left out; repeated rows count and
score each by itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import pairwise
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

SAMPLE = 20_000
PAIRS = 6
BINS, COARSE = 32, 8

FEATURES = (
    "log_words", "word_bytes", "distinct_words", "repeats", "distinct_pairs", "upper", "lower", "digits", "marks",
    "bars", "shouts", "stops_per_word", "non_ascii", "repeated_lines", "lines_per_word", "longest_word",
)


def _all_but(keep: bytes) -> bytes:
    return bytes(c for c in range(256) if c not in keep)


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DROP = {
    "upper": _all_but(_UPPER), "lower": _all_but(_LOWER), "digits": _all_but(b"0123456789"),
    "marks": _all_but(b"#$%&*+<=>@\\^_`{}~"), "non_ascii": bytes(range(128)),
}


def features(text: bytes | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(text), len(words)
    share = {k: len(text.translate(None, drop)) / n for k, drop in _DROP.items()}
    lines = text.split(b"\n")
    return [
        math.log1p(m),
        (n - m + 1) / m,
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        len(set(pairwise(words))) / max(1, m - 1),
        share["upper"],
        share["lower"],
        share["digits"],
        share["marks"],
        text.count(b"|") / m,
        text.count(b"!") / m,
        text.count(b".") / m,
        share["non_ascii"],
        1 - len(set(lines)) / len(lines),
        len(lines) / m,
        math.log1p(max(map(len, words))),
    ]


def _sums(bins: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(bins, g, n), np.bincount(bins, h, n)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree of a few leaves over ordered bins."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (a, b), a + i + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut in four of a table of sums: its gain, and its values by cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for S in (G, H):
        a = S[:-1, :-1]
        b, c = S[:-1, -1:] - a, S[-1:, :-1] - a
        parts.append((a, b, c, S[-1, -1] - a - b - c))
    gain = sum(_gain(x, y) for x, y in zip(*parts, strict=True)) - _gain(G[-1, -1], H[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(gain[i, j]), out


def _binned(X: np.ndarray, edges: Sequence[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(e, X[:, f], side="right") for f, e in enumerate(edges)]


def fit(X: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15) -> dict:
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    model = {"base": math.log(prior / (1 - prior)), "edges": [], "tables": [], "coarse": [], "pairs": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = lambda n: [np.unique(np.quantile(x, np.arange(1, n) / n)) for x in X.T]
    model["edges"], model["coarse"] = cuts(BINS), cuts(COARSE)
    bins, coarse = _binned(X, model["edges"]), _binned(X, model["coarse"])
    model["tables"] = [np.zeros(len(e) + 1) for e in model["edges"]]
    raw = np.full(len(y), model["base"])

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            step = rate * _tree(*_sums(b, len(model["tables"][f]), *slopes()))
            model["tables"][f] += step
            raw += step[b]

    def cells(i, j):
        n, m = len(model["coarse"][i]) + 1, len(model["coarse"][j]) + 1
        g, h = _sums(coarse[i] * m + coarse[j], n * m, *slopes())
        return g.reshape(n, m), h.reshape(n, m)

    able = [f for f, e in enumerate(model["coarse"]) if len(e)]
    ranked = sorted(((_quadrants(*cells(i, j))[0], i, j) for i in able for j in able if i < j), reverse=True)
    model["pairs"] = [(i, j, np.zeros_like(cells(i, j)[0])) for _, i, j in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, table in model["pairs"]:
            step = rate * _quadrants(*cells(i, j))[1]
            table += step
            raw += step[coarse[i], coarse[j]]
    return model


def scores(model: dict, X: np.ndarray) -> np.ndarray:
    raw = np.full(len(X), model["base"])
    if model["tables"] and len(X):
        for table, b in zip(model["tables"], _binned(X, model["edges"]), strict=True):
            raw += table[b]
        coarse = _binned(X, model["coarse"])
        for i, j, table in model["pairs"]:
            raw += table[coarse[i], coarse[j]]
    return 1 / (1 + np.exp(-raw))


_X = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])


def _matrix(rows) -> np.ndarray:
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, training=None, sample: int = SAMPLE) -> dict:
    """A model from the labelled rows for which ``training`` (a condition on doc_id) holds."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(training) if training is not None else known
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows
    rows = map_texts(own, "text", lambda texts: [[features(t) for t in texts]], _X, ["doc_id", "y"])
    rows = rows.orderBy("doc_id", "y", "x").limit(sample).collect()  # more than ``sample`` only where ids repeat
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return fit(_matrix([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: dict, keep=("doc_id",), name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the score, called ``name``."""
    out = T.StructType([T.StructField(name, T.DoubleType())])
    return map_texts(docs, "text", lambda texts: [scores(model, _matrix([features(t) for t in texts]))], out, keep)

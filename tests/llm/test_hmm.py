"""The language model against plain loops: expectations, likelihoods, and scores end to end."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hmm

DOCS = "doc_id string, text string, learn boolean"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]


def rows():
    rng, made = random.Random(5), []
    for i in range(60):
        topic = "abc"[i % 3]
        made.append((f"d-{i}", " ".join(rng.choice([f"{topic}{rng.randrange(30)}", f"Z{rng.randrange(8)}"]) for _ in range(rng.randrange(1, 60))), i % 5 != 1))
    made += [("long", " ".join(f"a{rng.randrange(900)}" for _ in range(3000)), True), (None, "a1 a2", True), ("e", "", True), ("n", None, False)]
    return made + [("d-3", "a1 a1 é\x0bb", True)] * 3 + [("u", "never seen WORDS", False), ("null", "b1 b2", None)]


def naive(sequence, emit, model):
    """Forward and backward by plain loops: posteriors, expected moves and the log likelihood."""
    K, ahead, total = len(model["start"]), [], 0.0
    for t, c in enumerate(sequence):
        own = [(model["start"][k] if not t else sum(ahead[-1][j] * model["move"][j, k] for j in range(K))) * emit[c][k] for k in range(K)]
        total += math.log(sum(own))
        ahead.append([x / sum(own) for x in own])
    back, moves = [[1.0] * K], np.zeros((K, K))
    for t in range(len(sequence) - 2, -1, -1):
        pairs = np.array([[ahead[t][j] * model["move"][j, k] * emit[sequence[t + 1]][k] * back[0][k] for k in range(K)] for j in range(K)])
        moves += pairs / pairs.sum()
        back.insert(0, list(np.array([sum(model["move"][j, k] * emit[sequence[t + 1]][k] * back[0][k] for k in range(K)) for j in range(K)]) / pairs.sum()))
    gamma = [[a * b for a, b in zip(x, y, strict=True)] for x, y in zip(ahead, back, strict=True)]
    return [[g / sum(row) for g in row] for row in gamma], moves, total


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_expectations(block):
    """Whole texts, also where a block is done in several stretches; by enumeration of all paths for a short one."""
    rng = np.random.default_rng(3)
    model = hmm.start_model(rng.random(20) + 0.1, 3)
    model["start"] = np.array([0.5, 0.3, 0.2])
    sequences = [rng.integers(0, 20, n).astype(np.int32) for n in (30, 9, 7, 7, 2, 1)]
    sizes, codes = np.array([len(s) for s in sequences]), hmm.pack(sequences)
    sums = np.zeros((20, 3))
    moves, starts, likely = hmm.posteriors(model, model["emit"], codes, sizes, hmm._by_code(sums), block)
    want, want_moves, want_starts, total = np.zeros((20, 3)), np.zeros((3, 3)), np.zeros(3), []
    for s in sequences:
        gamma, own, log = naive(s, model["emit"], model)
        for c, g in zip(s, gamma, strict=True):
            want[c] += g
        want_moves += own
        want_starts += gamma[0]
        total.append(log)
    assert np.allclose(sums, want) and np.allclose(moves, want_moves) and np.allclose(starts, want_starts) and math.isclose(likely, sum(total))
    assert np.allclose(hmm.forward(model, model["emit"], codes, sizes), np.array(total) / math.log(10))
    s, paths = [4, 9, 4], list(itertools.product(range(3), repeat=3))
    p = [model["start"][a] * model["emit"][4, a] * model["move"][a, b] * model["emit"][9, b] * model["move"][b, c] * model["emit"][4, c] for a, b, c in paths]
    assert math.isclose(naive(s, model["emit"], model)[2], math.log(sum(p)))
    assert np.allclose(naive(s, model["emit"], model)[0][1], [sum(x for path, x in zip(paths, p, strict=True) if path[1] == k) / sum(p) for k in range(3)])


@pytest.mark.parametrize("block", [40, hmm.BLOCK])
def test_scores_end_to_end(spark, block):
    given, K, rounds = rows(), 3, 2
    table = spark.createDataFrame(given, DOCS).withColumn("n_tokens", F.lit("clash")).repartition(3)
    found = hmm.score(table, F.col("learn"), states=K, rounds=rounds, block=block).collect()

    learned = [split(t) for _, t, learn in given if learn]
    of = lambda w: zlib.crc32(w.encode()) % hmm.CLASSES
    weight = np.bincount([of(w) for s in learned for w in s], minlength=hmm.CLASSES).astype(float)
    model, base = hmm.start_model(weight, K), (weight + 1e-3) / (weight + 1e-3).sum()
    for _ in range(rounds):
        sums, moves, starts = np.zeros((hmm.CLASSES, K)), np.ones((K, K)), np.ones(K)
        for s in learned:
            gamma, own, _ = naive([of(w) for w in s], model["emit"], model)
            np.add.at(sums, [of(w) for w in s], gamma)
            moves, starts = moves + own, starts + gamma[0]
        emit = sums + hmm.PRIOR * base[:, None]
        model = {"emit": emit / emit.sum(0), "move": moves / moves.sum(1, keepdims=True), "start": starts / starts.sum()}
    by_word, counts = defaultdict(lambda: np.zeros(K)), Counter(w for s in learned for w in s)
    for s in learned:
        for w, g in zip(s, naive([of(w) for w in s], model["emit"], model)[0], strict=True):
            by_word[w] += g
    n, v = counts.total(), len(counts)
    share = sum(by_word.values()) / n
    size = n + 0.5 * (v + 1)
    emission = lambda w: (by_word.get(w, np.zeros(K)) / share + 0.5) / size
    assert np.allclose(sum(emission(w) for w in counts) + emission("no such word"), 1.0, atol=1e-9)
    want = []
    for i, t, _ in given:
        s = split(t)
        base_score = sum(math.log10((counts[w] + 0.5) / size) for w in s)
        want.append((i, len(s), sum(w in counts for w in s), n, round(base_score, 5), round(naive(range(len(s)), [emission(w) for w in s], model)[2] / math.log(10), 2)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score) for r in found]
    for a, b in zip(sorted(want, key=repr), sorted(got, key=repr), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=2e-3, abs_tol=0.02)


def test_nothing_to_learn(spark):
    table = spark.createDataFrame(rows(), DOCS)
    assert hmm.score(table.limit(0), F.lit(True), states=2, rounds=1).count() == 0
    untrained = hmm.score(table, F.lit(False), states=2, rounds=1).collect()
    assert len(untrained) == len(rows())
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and abs(r.score) < 1e-9 for r in untrained)


def test_many_empty_texts_beside_a_long_one(spark):
    long = spark.createDataFrame([("long", " ".join(f"w{i % 700}" for i in range(60_000)), True)], DOCS)
    table = spark.range(50_000).select(F.col("id").cast("string").alias("doc_id"), F.lit("").alias("text"), F.lit(True).alias("learn")).union(long)
    found = hmm.score(table.coalesce(1), F.col("learn"), states=2, rounds=1, block=1 << 14)
    assert found.agg(F.count("*"), F.sum("n_tokens")).first()[:] == (50_001, 50_000 + 60_001)


def test_training_goes_on_until_it_gains_little(monkeypatch):
    def rounds_for(logs):
        left = list(logs)

        def one(blocks, model):
            states = model["move"].shape[0]
            return np.full((4, states), 100 / 4 / states), np.ones((states, states)), np.ones(states), left.pop(0)

        monkeypatch.setattr(hmm, "baum_welch_round", one)
        hmm.converge(None, hmm.start_model(np.ones(4)), np.ones(4) / 4)
        return len(logs) - len(left)

    assert hmm.STATES >= 6
    assert rounds_for([-900.0 + 10 * i for i in range(12)] + [-790.0 + 0.1] * 9) == 13  # 100 tokens: a gain of 0.5 counts
    assert rounds_for([-900.0] * 20) == 2


def test_training_to_convergence(spark):
    """Without a number of rounds: a start from some blocks, then all of them; held-out texts gain on the base."""
    table = spark.createDataFrame(rows(), DOCS)
    found = hmm.score(table, F.col("learn"), states=3, block=200).collect()
    assert len(found) == len(rows())
    own = [r for r in found if r.doc_id and r.doc_id.startswith("d-") and int(r.doc_id[2:]) % 5 == 1]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)

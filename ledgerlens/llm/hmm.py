"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion.

Tokens: A-Z lower-cased words between ASCII white space, then one end token. Texts are packed into blocks of about
``BLOCK`` tokens (a longer text is a block of its own); training and other texts have separate blocks. A bundle of
blocks, about ``BUNDLE`` tokens, shares a list of distinct words, so that words meet their counts once a bundle.

Training has two steps. First, Baum-Welch rounds with tied emissions: words share ``CLASSES`` classes by their CRC-32,
at every size of the corpus, which bounds what is broadcast and gathered. Rounds over ``START_BUNDLES`` bundles (a
bounded sample, by hash of the bundle) give the start of the rounds over all training texts; each go on until one gains
less than ``TOLERANCE`` a token. Then one more round over all training texts counts each word by state, as a table that
grows with the vocabulary: E(w, s), whose sum over states is the word's count c(w). With p(s) the share of all tokens
in state s, a state emits a word with probability

    (E(w, s) / p(s) + 0.5) / (N + 0.5 (V + 1)),

which adds up to 1 over the V words and the unknown word (E = 0; all unknown words are tied), and whose mean over the
states is the base probability. Scores join that table to the words of the blocks.

Texts are never cut: the recursions run over whole texts, all texts of a block at once, and memory is bounded by
doing ``BLOCK`` tokens at a time (forward probabilities at the ends of such stretches are kept, the rest is computed
again on the way back).

Null and empty texts are the end token alone. Repeated rows count and score each by itself; a null doc_id is kept
and an id can be of any type. Without training texts base scores use N = V = 0. No rows give no rows. Columns other
than doc_id, text and those of the training condition are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, materialize

STATES = 6
#: Tied rounds go on until one gains less than TOLERANCE (natural log) a token, at least two; first over so many bundles
#: for a start, then over all training texts.
START_BUNDLES = 2
TOLERANCE = 0.005
CLASSES = 1 << 14
#: Expected counts of words are written in such parts of a token.
PART = 1 / 1024
#: Tokens of the overall distribution that are added to the tied emissions of a state.
PRIOR = 2000.0
BLOCK, BUNDLE = 1 << 20, 4 << 20
#: Bytes of a row group of the bundles, which bounds what a reader holds.
ROW_GROUP = 16 << 20


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class _Local(dict):
    """Words of a bundle, numbered as they come; the end token is number 0."""

    def __init__(self):
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code

    def encode(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts sorted by falling length: how many reach place t, and where place t starts in a packed block."""
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    return active, np.concatenate(([0], np.cumsum(active)))


def pack(sequences: list[np.ndarray]) -> np.ndarray:
    """All first tokens, then all second tokens, and so on; ``sequences`` are sorted by falling length."""
    sizes = np.array([len(s) for s in sequences])
    active, at = layout(sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.empty(len(place), np.int32)
    out[at[place] + np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate(sequences)
    return out


def bundles_of(texts: DataFrame, block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """Bundles of ``texts`` (doc_id, text, learn): for each block whether it is for training, ids, sizes and packed codes; and
    the bundle's words with their classes."""
    id_type = texts.schema["doc_id"].dataType
    many = lambda kind: T.ArrayType(kind)
    schema = T.StructType([
        T.StructField("learn", many(T.BooleanType())), T.StructField("ids", many(many(id_type))), T.StructField("sizes", many(T.BinaryType())),
        T.StructField("codes", many(T.BinaryType())), T.StructField("classes", T.BinaryType()), T.StructField("words", many(T.StringType())),
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    class Block:
        def __init__(self):
            self.sequences, self.ids, self.size = [], [], 0

        def done(self, learn: bool) -> tuple:
            sizes = np.array([len(s) for s in self.sequences], np.int32)
            order = np.argsort(-sizes, kind="stable")
            packed = pack([self.sequences[i] for i in order])
            return learn, pa.concat_arrays(self.ids).take(pa.array(order)), sizes[order].tobytes(), packed.tobytes()

    def row(local: _Local, done: list[tuple]) -> pa.RecordBatch:
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        learn, ids, sizes, codes = zip(*done, strict=True)
        starts = pa.array(np.cumsum([0, *(len(i) for i in ids)]), pa.int32())
        classes = np.fromiter((zlib.crc32(w) % CLASSES for w in local), np.uint16, len(local))
        words = pa.array(list(local), pa.binary()).cast(pa.string())
        columns = [
            one(pa.array(learn)), one(pa.ListArray.from_arrays(starts, pa.concat_arrays(ids))), one(pa.array(sizes, pa.binary())),
            one(pa.array(codes, pa.binary())), pa.array([classes.tobytes()], pa.binary()), one(words),
        ]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, done, size, open_blocks = _Local(), [], 0, {True: Block(), False: Block()}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for i, (text, learn) in enumerate(zip(as_bytes(part["text"]), part["learn"].to_pylist(), strict=True)):
                    own = open_blocks[learn]
                    own.sequences.append(local.encode(tokens(text)))
                    own.ids.append(part["doc_id"].slice(i, 1))
                    own.size += len(own.sequences[-1])
                    size += len(own.sequences[-1])
                    if own.size >= block:
                        done.append(own.done(learn))
                        open_blocks[learn] = Block()
                    if size >= bundle:
                        done += [b.done(k) for k, b in open_blocks.items() if b.size]
                        yield row(local, done)
                        local, done, size, open_blocks = _Local(), [], 0, {True: Block(), False: Block()}
        if size:
            yield row(local, done + [b.done(k) for k, b in open_blocks.items() if b.size])

    return texts.select("doc_id", "text", "learn").mapInArrow(run, schema)


def blocks_in(batch: pa.RecordBatch, row: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(learn, sizes, codes) of the blocks of a bundle."""
    raw = lambda name: [np.frombuffer(v.as_buffer(), np.int32) for v in batch[name][row].values]
    return list(zip(batch["learn"][row].as_py(), raw("sizes"), raw("codes"), strict=True))


def learned_in(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list]]:
    """(row, classes, [(sizes, codes), ...]) of the bundles of a batch, with their blocks for training."""
    for row in range(batch.num_rows):
        own = [(sizes, codes) for learn, sizes, codes in blocks_in(batch, row) if learn]
        yield row, np.frombuffer(batch["classes"][row].as_buffer(), np.uint16), own


def _stretches(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of places with about ``most`` tokens each."""
    places, out, start = len(at) - 1, [], 0
    while start < places:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        out.append((start, end))
        start = end
    return out


def _forward(model: dict, emitted: np.ndarray, at: list[int], span: tuple[int, int], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales of the places in ``span``; ``before`` are those of the place before."""
    alpha, scale = np.empty_like(emitted), np.empty((len(emitted), 1), emitted.dtype)
    move, ones = model["move"], np.ones((emitted.shape[1], 1), emitted.dtype)
    base = at[span[0]]
    for t in range(*span):
        i, j = at[t] - base, at[t + 1] - base
        own, total = alpha[i:j], scale[i:j]
        if before is None:
            np.multiply(model["start"], emitted[i:j], out=own)
        else:
            np.matmul(before[: j - i], move, out=own)
            own *= emitted[i:j]
        np.matmul(own, ones, out=total)
        own /= total
        before = own
    return alpha, scale


def posteriors(model: dict, emission: np.ndarray, codes: np.ndarray, sizes: np.ndarray, take: Callable, block: int = BLOCK):
    """Baum-Welch expectations of a packed block: expected moves, starts and the log likelihood.

    ``emission`` has a row of state probabilities for each code; ``take(codes, weights)`` gets the state posteriors.
    """
    active, starts_at = layout(sizes)
    at, last = starts_at.tolist(), len(sizes)
    spans = _stretches(starts_at, block)
    before, likely, entered = None, 0.0, []
    for span in spans:
        emitted = emission[codes[at[span[0]] : at[span[1]]]]
        alpha, scale = _forward(model, emitted, at, span, before)
        likely += float(np.log(scale).sum(dtype=float))
        entered.append(before)
        before = alpha[at[span[1] - 1] - at[span[0]] :].copy()
    K = emission.shape[1]
    moves, starts, later, back = np.zeros((K, K)), np.zeros(K), None, np.ascontiguousarray(model["move"].T)
    for span, before in zip(reversed(spans), reversed(entered), strict=True):
        base, end = at[span[0]], at[span[1]]
        if len(spans) > 1:
            emitted = emission[codes[base:end]]
            alpha, scale = _forward(model, emitted, at, span, before)
        emitted /= scale
        beta = np.ones_like(emitted)
        for t in range(span[1] - 1, span[0] - 1, -1):  # emitted becomes emission x backward, for the place before
            i, j = at[t] - base, at[t + 1] - base
            following = later if t + 1 == span[1] else emitted[j : at[t + 2] - base]
            if following is not None:
                np.matmul(following, back, out=beta[i : i + len(following)])
            emitted[i:j] *= beta[i:j]
        first = at[span[0] + 1] - base
        came = np.arange(first, end - base) - np.repeat(active[span[0] : span[1] - 1], active[span[0] + 1 : span[1]])
        moves += alpha[came].T @ emitted[first:]
        if before is not None:
            moves += before[:first].T @ emitted[:first]
        later = emitted[:first].copy()
        alpha *= beta
        if not span[0]:
            starts = alpha[:last].sum(0, dtype=float)
        take(codes[base:end], alpha)
    return moves * model["move"], starts, likely


def forward(model: dict, emission: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each whole text of a packed block."""
    active, at = layout(sizes)
    at = at.tolist()
    logs, now = np.zeros(len(sizes)), None
    for t in range(len(active)):
        own = emission[codes[at[t] : at[t + 1]]]
        now = own * model["start"] if now is None else (now[: len(own)] @ model["move"]) * own
        total = now.sum(1)
        logs[: len(own)] += np.log10(total)
        now /= total[:, None]
    return logs


#: Columns of the bundles that training reads.
TRAINING = ("learn", "sizes", "codes", "classes")


def _single(model: dict) -> dict:
    return {k: v.astype(np.float32) for k, v in model.items()}


def _by_code(sums: np.ndarray) -> Callable:
    def take(codes, weights):
        for k in range(sums.shape[1]):
            sums[:, k] += np.bincount(codes, weights[:, k], len(sums))

    return take


def class_counts(bundles: DataFrame) -> np.ndarray:
    """Training tokens of each class in all ``bundles``."""

    def run(batches):
        sums = np.zeros(CLASSES)
        for batch in batches:
            for _, classes, blocks in learned_in(batch):
                for _, codes in blocks:
                    sums += np.bincount(classes, np.bincount(codes, minlength=len(classes)), CLASSES)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["key", "n"])

    out = np.zeros(CLASSES)
    counted = bundles.select(*TRAINING).mapInArrow(run, "key long, n double").groupBy("key").agg(F.sum("n"))
    for key, n in counted.collect():  # a row a class
        out[key] = n
    return out


def start_model(weight: np.ndarray, states: int = STATES) -> dict:
    noise = np.random.default_rng(11).lognormal(0.0, 0.6, (len(weight), states))
    noise[zlib.crc32(b"") % len(weight)] = 1.0
    emit = noise * (weight + 1e-3)[:, None]
    stay = np.full((states, states), 0.06 / max(1, states - 1))
    np.fill_diagonal(stay, 0.94)
    return {"emit": emit / emit.sum(0), "move": stay / stay.sum(1, keepdims=True), "start": np.full(states, 1.0 / states)}


def baum_welch_round(bundles: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (class x state, moves, starts) and log likelihood of all training texts, summed across partitions."""
    shared = bundles.sparkSession.sparkContext.broadcast(_single(model))
    C, K = model["emit"].shape
    names = [f"s{k}" for k in range(K)]

    def run(batches):
        own = shared.value
        sums, rest = np.zeros((C, K)), np.zeros((K + 2, K))
        for batch in batches:
            for _, classes, blocks in learned_in(batch):
                for sizes, codes in blocks:
                    moves, starts, likely = posteriors(own, own["emit"], classes[codes], sizes, _by_code(sums))
                    rest += np.concatenate((moves, [starts], np.full((1, K), likely)))
        rows = np.flatnonzero(sums.any(1))
        values = np.concatenate((np.round(sums[rows] / PART) * PART, rest))
        keys = np.concatenate((rows, C + np.arange(K + 2)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(values[:, k]) for k in range(K))], names=["key", *names])

    parts = bundles.select(*TRAINING).mapInArrow(run, "key long, " + ", ".join(f"{n} double" for n in names))
    out = np.zeros((C + K + 2, K))
    for row in parts.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).collect():  # a row a class
        out[row[0]] = row[1:]
    return out[:C], out[C : C + K], out[C + K], float(out[-1, 0])


def converge(bundles: DataFrame, model: dict, base: np.ndarray, rounds: int | None = None) -> dict:
    """Tied Baum-Welch from ``model`` on until a round gains little, or for just ``rounds`` rounds where these are given."""
    done, before = 0, -math.inf
    while rounds is None or done < rounds:
        emitted, moves, starts, likely = baum_welch_round(bundles, model)
        emit = emitted + PRIOR * base[:, None]
        moves, starts = moves + 1.0, starts + 1.0
        model = {"emit": emit / emit.sum(0), "move": moves / moves.sum(1, keepdims=True), "start": starts / starts.sum()}
        done += 1
        if rounds is None and likely - before < TOLERANCE * max(1.0, float(emitted.sum())):
            break
        before = likely
    return model


def train(bundles: DataFrame, weight: np.ndarray, states: int = STATES, rounds: int | None = None) -> dict:
    """The tied model of the training texts, whose classes have ``weight`` tokens each."""
    model, base = start_model(weight, states), (weight + 1e-3) / (weight + 1e-3).sum()
    if rounds is None:
        some = [r[0] for r in bundles.select("bundle").orderBy(F.xxhash64("bundle")).limit(START_BUNDLES).collect()]
        model = converge(bundles.where(F.col("bundle").isin(some)), model, base)
    return converge(bundles, model, base, rounds)


def word_emissions(bundles: DataFrame, model: dict) -> DataFrame:
    """(word, n, s0, s1, ...) of every word of the training texts: its tokens, and its expected tokens in each state."""
    shared = bundles.sparkSession.sparkContext.broadcast(_single(model))
    K = model["move"].shape[0]
    names = [f"s{k}" for k in range(K)]

    def run(batches):
        own = shared.value
        for batch in batches:
            for row, classes, blocks in learned_in(batch):
                sums, n = np.zeros((len(classes), K)), np.zeros(len(classes), np.int64)
                for sizes, codes in blocks:
                    posteriors(own, own["emit"][classes], codes, sizes, _by_code(sums))
                    n += np.bincount(codes, minlength=len(classes))
                seen, sums = np.flatnonzero(n), np.round(sums / PART) * PART
                columns = [batch["words"][row].values.take(pa.array(seen)), n[seen], *(sums[seen, k] for k in range(K))]
                yield from pa.table(dict(zip(["word", "n", *names], columns, strict=True))).to_batches(1 << 16)

    parts = bundles.select(*TRAINING, "words").mapInArrow(run, "word string, n long, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])


def score(docs: DataFrame, training: Column, states: int = STATES, rounds: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; ``training`` marks the rows to learn from."""
    marked = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("learn"))
    made = bundles_of(marked, block, 4 * block).withColumn("bundle", F.monotonically_increasing_id())
    bundles = materialize(made, "bundles", **{"parquet.block.size": ROW_GROUP})
    tied = train(bundles, class_counts(bundles), states, rounds)
    words = materialize(word_emissions(bundles, tied), "emissions")

    names = [f"s{k}" for k in range(states)]
    sums = words.agg(F.count("*"), F.sum("n"), *[F.sum(n) for n in names]).first()
    distinct, total = sums[0], sums[1] or 0
    share = np.array([s or 0.0 for s in sums[2:]]) / max(1, total)
    size = total + 0.5 * (distinct + 1)
    model = docs.sparkSession.sparkContext.broadcast({k: tied[k] for k in ("move", "start")})
    out = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        bundle = own.to_batches()[0]
        blocks, ids = blocks_in(bundle, 0), bundle["ids"][0].values
        known_words = 1 + max(int(codes.max()) for _, _, codes in blocks)
        count, emission = np.zeros(known_words), np.full((known_words, len(names)), 0.5 / size)
        if known.num_rows:
            at = known["at"].to_numpy()
            count[at] = known["n"].to_numpy()
            seen = np.stack([known[n].to_numpy() for n in names], axis=1).astype(float)
            emission[at] += seen / np.where(share > 0, share, 1.0) / size
        base = np.log10((count + 0.5) / size)

        def scored(i: int) -> pa.Table:
            _, sizes, codes = blocks[i]
            active, starts_at = layout(sizes)
            text = np.arange(len(codes)) - np.repeat(starts_at[:-1], active)
            return pa.table({
                "doc_id": ids[i].values,
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": np.bincount(text, count[codes] > 0, len(sizes)).astype(np.int64),
                "train_tokens": np.full(len(sizes), total, np.int64),
                "base_score": np.bincount(text, base[codes], len(sizes)),
                "score": forward(model.value, emission, codes, sizes),
            })

        return pa.concat_tables([scored(i) for i in range(len(blocks))])

    used = bundles.select(F.col("bundle").alias("of"), F.posexplode("words").alias("at", "word")).join(words, "word")
    used = used.select("of", "at", "n", *[F.col(n).cast("float") for n in names])
    packed = bundles.select("bundle", "learn", "ids", "sizes", "codes")
    return packed.groupBy("bundle").cogroup(used.groupBy("of")).applyInArrow(run, out)

"""Near copies on word shingles: every pair of texts with a Jaccard of at least 0.8, for the pipeline.

Shingles: ``SHINGLE`` words as in ``simhash`` (fewer words: the whole sequence; none: the empty set), as a set of
XXH64. Texts with the same set are one class, known by XXH3-128 of the set. Two classes are linked if the exact Jaccard
of their sets is at least ``NEAR`` / ``NEAR_OF``.

Candidates are SimHash links of these shingles (within 3 bits) and an index that loses no pair: in any one order of
all shingles, sets of n and m shingles with such a Jaccard share one of the first n - ceil(0.8 n) + 1 of the one and the
first m - ceil(0.8 m) + 1 of the other, and at the first shared one enough must be left of both. The order puts
common shingles last; which ones it takes as common (counted over a sixteenth of the texts) changes the cost, not the
links. Candidates are verified in steps, so that many copies of one text don't give all their pairs: first a few
for each shingle of the index (each member with the first one and with the next one), then a few pairs of each two
components of a shingle (twice), and at last all that are still in different components. Before texts are compared, counts of shingles by bucket rule out pairs
that cannot share enough.

Null and empty texts are one class. Repeated rows are copies. Rows with the same doc_id and unlike texts all stay, and
those without a doc_id are judged by their text like any other. No rows give no rows. Columns beyond doc_id and text
can have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import as_bytes, map_texts, materialize
from .components import connected_components

SHINGLE = 5
#: Jaccard of a link, as a fraction.
NEAR, NEAR_OF = 4, 5
#: The order of the index knows at most so many shingles as common: those seen so often in one of so many rows.
COMMON, COMMON_SEEN, SAMPLED = 1 << 18, 2, 16
#: In the middle steps two components of a shingle are compared by so many pairs, then by four times as many.
OTHERS = 4
FLUSH = 1 << 22
#: Counts of shingles by so many buckets tell what a pair can share at most; the last steps know a small form of them.
BUCKETS, MARKS = 256, 64

OUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()), T.StructField("marks", T.BinaryType()),
])


def shingle_set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def near(shared, n, m):
    """Whether sets of n and m shingles that share so many have the Jaccard; numbers or arrays."""
    return NEAR_OF * shared >= NEAR * (n + m - shared)


def possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can have the Jaccard if the first that they share is at ``at`` and ``bt``."""
    return (NEAR + NEAR_OF) * np.minimum(n - at, m - bt) >= NEAR * (n + m)


def prefix_of(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the index holds of a set: its first n - ceil(0.8 n) + 1 in the order (times seen, hash)."""
    known, seen = common
    n = len(own)
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        own = own[np.lexsort((own, np.where(known[at] == own, seen[at], 0)))]
    return own[: n + NEAR * -n // NEAR_OF + 1] if n else own


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and how often they were seen, counted exactly over a sample of ``texts`` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.int64)], 0

        def made():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            for text in as_bytes(batch["text"]):
                held.append(shingle_set(simhash.shingle_hashes(text, SHINGLE)))
                size += len(held[-1])
                if size >= FLUSH:
                    yield made()
                    held, size = [held[0]], 0
        yield made()

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("text")
    counts = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_SEEN)
    found = sorted((r[0], r[1]) for r in counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect())
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def _groups(fn: Callable[[dict[str, np.ndarray], np.ndarray], tuple]) -> Callable:
    """Batches sorted by shingle -> ``fn`` of their columns and the starts of its groups; a cut group is held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            cols = {c: table[c].to_numpy() for c in table.column_names}
            key = cols["shingle"]
            names, arrays = fn(cols, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))))
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

        for batch in batches:
            key = batch["shingle"].to_numpy()
            if not len(key):
                continue
            table, cut = pa.Table.from_batches([batch]), int(np.searchsorted(key, key[-1]))
            if held and key[0] != held[-1]["shingle"][-1].as_py() and not cut:
                yield made(pa.concat_tables(held).combine_chunks())
                held = []
            elif cut:
                yield made(pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks())
                held = []
            held.append(table.slice(cut))
        if held:
            yield made(pa.concat_tables(held).combine_chunks())

    return run


def _shared(cols: dict[str, np.ndarray], starts: np.ndarray) -> tuple:
    """Rows of shingles that two classes or more have, with the first and the next class of the shingle (else its own)
    where these can still have the Jaccard with it."""
    ids, n, at = cols["id"], cols["n"], cols["at"]
    sizes = np.diff(np.concatenate((starts, [len(ids)])))
    own = np.arange(len(ids))
    first, after = np.repeat(starts, sizes), np.minimum(own + 1, np.repeat(starts + sizes, sizes) - 1)
    keep = np.repeat(sizes > 1, sizes)
    mates = [ids[np.where(possible(n, at, n[to], at[to]), to, own)] for to in (first, after)]
    names = ["shingle", "id", "n", "at", "first", "after"]
    return names, [*(cols[c][keep] for c in names[:4]), *(m[keep] for m in mates)]


def _few_of_each(x: np.ndarray, y: np.ndarray, root: np.ndarray, most: int, salt: int) -> np.ndarray:
    """Which of the pairs (x, y) stay if each two components keep so many, scattered among them."""
    low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
    scattered = np.random.default_rng(salt).permutation(len(x))
    order = np.lexsort((scattered, high, low))
    new = np.concatenate(([True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)))
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[rank < most]


def _across(most: int | None, block: int = 2048) -> Callable:
    """Pairs of a shingle whose classes are in different components and can still have the Jaccard: of each two components
    of a block only so many, or, with None, all."""

    def run(cols: dict[str, np.ndarray], starts: np.ndarray) -> tuple:
        ids, root, n, at = cols["id"], cols["root"], cols["n"], cols["at"]
        counts = read_marks(cols["marks"])
        ends = np.concatenate((starts[1:], [len(ids)]))
        left, right = [ids[:0]], [ids[:0]]
        for s, e in zip(starts, ends, strict=True):
            for i in range(s, e, block):
                a = slice(i, min(i + block, e))
                for j in range(i, e, block):
                    b = slice(j, min(j + block, e))
                    can = possible(n[a][:, None], at[a][:, None], n[b][None, :], at[b][None, :])
                    x, y = np.nonzero((root[a][:, None] != root[b][None, :]) & can)
                    x, y = x + i, y + j
                    once = x < y
                    x, y = x[once], y[once]
                    can = can_by_marks(counts, n, x, y)
                    x, y = x[can], y[can]
                    if most and len(x) > most:
                        few = _few_of_each(x, y, root, most, most + len(x))
                        x, y = x[few], y[few]
                    left.append(np.minimum(ids[x], ids[y]))
                    right.append(np.maximum(ids[x], ids[y]))
        pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
        return ["a", "b"], [pairs[0], pairs[1]]

    return run


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``texts`` (id, text) have the Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # pairs with the same a follow each other
        for batch in batches:
            keep = []
            for text, other in zip(as_bytes(batch["left"]), as_bytes(batch["right"]), strict=True):
                if own is None or text != last:
                    last, own = text, shingle_set(simhash.shingle_hashes(text, SHINGLE))
                more = shingle_set(simhash.shingle_hashes(other, SHINGLE))
                keep.append(near(len(np.intersect1d(own, more, assume_unique=True)), len(own), len(more)))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(t)) for c, t in (("a", "left"), ("b", "right")))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def signature(own: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of ``BUCKETS`` buckets (255: so many or more)."""
    return np.minimum(np.bincount(own & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def marks(own: np.ndarray) -> bytes:
    """The same for ``MARKS`` buckets, up to 15 in each."""
    counts = np.minimum(np.bincount((own >> 8) & (MARKS - 1), minlength=MARKS), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def read_marks(column: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(-1, MARKS // 2)
    return np.stack((raw & 15, raw >> 4), axis=2).reshape(-1, MARKS)


def can_by_marks(counts: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Which of the pairs (x, y) of rows can have the Jaccard by their marks."""
    parts = [slice(i, i + step) for i in range(0, len(x), step)]
    made = [near(most_shared(counts[x[p]], counts[y[p]], n[x[p]], n[y[p]]), n[x[p]], n[y[p]]) for p in parts]
    return np.concatenate(made) if made else np.zeros(0, bool)


def most_shared(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """No two sets with these signatures (a row a pair) and sizes share more shingles than this."""
    beyond = np.minimum(n - left.sum(1, dtype=np.int64), m - right.sum(1, dtype=np.int64))  # in buckets of 255 and more
    return np.minimum(left, right).sum(1, dtype=np.int64) + beyond


def plausible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those that cannot have the Jaccard by their signatures; no pair that has it is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)
        for batch in batches:
            n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
            can = near(most_shared(raw(batch["left"]), raw(batch["right"]), n, m), n, m)
            yield batch.select(["a", "b"]).filter(pa.array(can, pa.bool_()))

    left = signatures.select(F.col("id").alias("a"), F.col("n"), F.col("signature").alias("left"))
    right = signatures.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("signature").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n", "m", "left", "right").mapInArrow(run, "a long, b long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name, which no column of ``docs`` has."""
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row = f"_{row}"
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``texts`` (row, text): (row, key), the class of each row, and (key, root), the component of each class."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def fn(batch):
        out = tuple([] for _ in OUT)
        for text in batch:
            hashes = simhash.shingle_hashes(text, SHINGLE)
            own = shingle_set(hashes)
            made = xxhash.xxh3_128_hexdigest(own.tobytes()), simhash.fingerprint_of(hashes), len(own), prefix_of(own, common.value), signature(own), marks(own)
            for column, value in zip(out, made, strict=True):
                column.append(value)
        return out

    rows = materialize(map_texts(texts, "text", fn, OUT, ("row",)), "sets")
    classes = materialize(rows.groupBy("key").agg(F.min("row").alias("id")), "classes")
    owners = rows.join(classes.select(F.col("id").alias("row")), "row", "left_semi")
    index = owners.select(F.col("row").alias("id"), "n", F.posexplode("prefix").alias("at", "shingle"))
    index = index.select("shingle", "id", "n", F.col("at").cast("long").alias("at")).repartition("shingle").sortWithinPartitions("shingle", "n", "id")
    shared = materialize(index.mapInArrow(_groups(_shared), "shingle long, id long, n long, at long, first long, after long"), "shared")

    prints = materialize(owners.select(F.col("row").alias("id"), "fp").groupBy("fp").agg(F.min("id").alias("id")), "prints")
    ends = simhash.fingerprint_links(prints.select("fp"))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("id").alias(f"id_{c}"))
    linked = ends.join(of("a"), "a").join(of("b"), "b").select(F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    few = linked.union(shared.select("id", "first")).union(shared.select("id", "after"))
    few = few.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    signatures = owners.select(F.col("row").alias("id"), "n", "signature")
    few = materialize(plausible(few, signatures), "pairs")

    def confirmed(pairs: DataFrame) -> DataFrame:
        own = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        own = materialize(texts.join(own, "row", "left_semi").select(F.col("row").alias("id"), "text"), "texts")
        return materialize(verified(pairs, own), "links")

    marked = shared.select("shingle", "id", "n", "at").join(owners.select(F.col("row").alias("id"), "marks"), "id")
    marked = materialize(marked, "marked")
    seen, links = few, confirmed(few)
    roots = connected_components(links)
    for step in (_across(OTHERS), _across(4 * OTHERS), _across(None)):
        labelled = marked.join(roots.withColumnRenamed("node", "id"), "id", "left")
        labelled = labelled.select("shingle", "id", "n", "at", "marks", F.coalesce("root", "id").alias("root"))
        labelled = labelled.repartition("shingle").sortWithinPartitions("shingle", "n", "id")
        pairs = labelled.mapInArrow(_groups(step), "a long, b long").distinct().join(seen, ["a", "b"], "left_anti")
        pairs = materialize(plausible(pairs, signatures), "pairs")
        more = confirmed(pairs)
        seen, links = seen.union(pairs), links.union(more)
        if not more.isEmpty():
            roots = connected_components(links)
    return rows.select("row", "key"), classes.join(roots, classes.id == roots.node, "left").select("key", F.coalesce("root", "id").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``; component_id is the smallest doc_id that links lead to."""
    table, row = _numbered(docs.select("doc_id", "text"))
    rows, member = _classes(table.select(F.col(row).alias("row"), "text"))
    found = table.select("doc_id", F.col(row).alias("row")).join(rows, "row")
    first = found.groupBy("key").agg(F.min("doc_id").alias("first")).join(member, "key")
    smallest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(member.join(smallest, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies that with the smallest doc_id (null last), then the first row."""
    table, row = _numbered(docs)
    rows, member = _classes(table.select(F.col(row).alias("row"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("best")
    best = table.select("doc_id", F.col(row).alias("row")).join(rows, "row").select("key", order).groupBy("key").agg(F.min("best").alias("best"))
    stay = best.join(member, "key").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return table.join(stay, row, "left_semi").select(*[table[f"`{c}`"] for c in docs.columns])

"""SimHash near-duplicates, compared exactly in tiles.

Fingerprints: A-Z lower-cased, words between ASCII white space, shingles of ``SHINGLE`` words joined by one space
(fewer words: the whole sequence; none: fingerprint zero); a bit is 1 if it is set in over half of the shingles'
XXH64 (seed 42), repeats included.

Links: two fingerprints within ``RADIUS`` = 3 bits agree in one of four 16-bit bands, so rows that share a band are
compared, all against all, as numpy tiles (exclusive-or and bit counts). Tiles are ordered by population count;
tile pairs whose counts differ beyond the radius are skipped, and links are folded into a forest as they come, so a
tile in which all are alike takes no more memory. A band value with more than ``TILE`` fingerprints is
cut into tiles by population count and hash, and its tile pairs are dealt out as tasks of their own, so no task
holds more than two tiles. Equal fingerprints are one row before anything is compared, and a tile gives a
spanning forest of its links, not all pairs; connected components of these links are those of all links.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share their fingerprint.
A null doc_id gets the component of its fingerprint, but never names one (null if all its members are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize
from .components import connected_components

SHINGLE = 3
RADIUS = 3
TILE = 16_384
#: A tile's links are folded into a forest whenever there are so many.
LINKS = 1 << 20

OUT = T.StructType([T.StructField("fp", T.LongType())])


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    words = text.lower().split() if text else []
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: list[int]) -> int:
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` with fp, the 64 bits as a signed long."""
    return map_texts(docs, "text", lambda texts: [[fingerprint(t) for t in texts]], OUT, keep)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges node -> smallest node of its component, for the nodes that are not the smallest."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            child = np.flatnonzero(root != np.arange(n))
            return child, root[child]
        root = new


def tile_links(fps: np.ndarray, side: np.ndarray | None, radius: int = RADIUS, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps`` (uint64); with ``side``, of those between sides 0 and 1."""
    pops = np.bitwise_count(fps)
    order = np.argsort(pops, kind="stable")
    fps, pops = fps[order], pops[order].astype(np.int64)
    side = side[order] if side is not None else None
    left, right, held = [], [], 0
    for i in range(0, len(fps), step):
        a, top = fps[i : i + step], pops[min(i + step, len(fps)) - 1]
        for j in range(i, len(fps), step):
            if pops[j] - top > radius:
                break
            b = fps[j : j + step]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            x, y = x + i, y + j
            own = x < y if side is None else (x < y) & (side[x] != side[y])
            left.append(x[own])
            right.append(y[own])
            held += len(left[-1])
            if held > LINKS:
                child, parent = _forest(len(fps), np.concatenate(left), np.concatenate(right))
                left, right, held = [child], [parent], 0
    if not left:
        return fps[:0], fps[:0]
    child, parent = _forest(len(fps), np.concatenate(left), np.concatenate(right))
    return fps[child], fps[parent]


def group_links(key: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int = RADIUS):
    """Links of every run of equal keys. Small groups are compared together, row against row at each distance."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    left, right = [], []
    paired = np.zeros(len(key), bool)
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        paired[s : s + n] = True
        own = side[s : s + n]
        a, b = tile_links(fps[s : s + n], own if own.max() > 0 else None, radius)
        left.append(a)
        right.append(b)
    rest = np.flatnonzero(~paired)
    remain = np.repeat(starts + sizes, sizes)[rest] - rest - 1  # rows that follow in the same group
    distance = 1
    while len(rest := rest[remain >= distance]):
        remain = remain[remain >= distance]
        near = np.bitwise_count(fps[rest] ^ fps[rest + distance]) <= radius
        near &= (side[rest] != side[rest + distance]) | (side[rest] < 0)
        left.append(fps[rest[near]])
        right.append(fps[rest[near] + distance])
        distance += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, fp) -> links; a group that a batch cuts is held until it ends."""
    held: list[pa.Table] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        cols = [table[c].to_numpy() for c in ("key", "fp", "side")]
        a, b = group_links(cols[0], cols[1].view(np.uint64), cols[2])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = batch["key"].to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        table = pa.Table.from_batches([batch])
        if cut == 0 and held and held[-1]["key"][-1].as_py() == key[0]:
            held.append(table)
            continue
        if cut:
            yield links(pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks())
        elif held:
            yield links(pa.concat_tables(held).combine_chunks())
        held = [table.slice(cut)]
    if held:
        yield links(pa.concat_tables(held).combine_chunks())


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct.fp`` within ``radius`` <= 3 bits."""
    bands = F.array(*[F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) + F.lit(i << 16) for i in range(4)])
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(bands).alias("band"))
    counts = rows.groupBy("band", "pop").count()
    large = (
        counts.groupBy("band")
        .agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("pop", "count"))).alias("by_pop"))
        .where(F.col("total") > tile)
    )
    dealt = rows.join(large, "band", "left")
    small = F.array(F.struct(F.col("band").cast("string").alias("group"), F.lit(-1).alias("side")))
    tiles = lambda p: F.ceil(F.element_at("by_pop", p) / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles(F.col("pop"))).cast("int")
    name = lambda p, s: F.format_string("%02d.%06d", p, s)
    others = F.flatten(
        F.transform(
            F.filter(F.map_keys("by_pop"), lambda p: F.abs(p - F.col("pop")) <= radius),
            lambda p: F.transform(F.sequence(F.lit(0), tiles(p) - 1), lambda s: F.struct(p.alias("p"), s.alias("s"))),
        )
    )
    mine = name(F.col("pop"), F.col("own"))

    def pair(o):
        other = name(o["p"], o["s"])
        return F.struct(
            F.concat_ws(":", F.col("band").cast("string"), F.least(mine, other), F.greatest(mine, other)).alias("group"),
            F.when(mine == other, -1).when(mine < other, 0).otherwise(1).alias("side"),
        )

    dealt = dealt.withColumn("own", F.when(F.col("total").isNotNull(), own))
    dealt = dealt.withColumn("to", F.when(F.col("total").isNull(), small).otherwise(F.transform(others, pair)))
    dealt = dealt.select("fp", F.explode("to").alias("to")).select(
        F.xxhash64("to.group").alias("key"), "fp", F.col("to.side").alias("side")
    )
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id, the smallest doc_id reachable over links."""
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = connected_components(materialize(fingerprint_links(groups), "links"))
    member = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(member.join(smallest, "root").select("fp", "component_id"), "fp")

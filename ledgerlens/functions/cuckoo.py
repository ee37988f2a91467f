"""A sketch of a key set for requests: 16-bit fingerprints in buckets of four, SipHash-2-4.

The driver builds a sketch (of a key table, tasks build one for each hash bucket); columns are tested by Arrow batch, all keys of a batch at once. A sketch has no false
negatives, and about one false positive in ten thousand, so results are checked again: with an exact semi join, or by the
keys themselves where a filter has a ``KeySet``. A filter with a bare sketch, as a client sends it, lets those few pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sketch's form.
SLOTS, FINGERPRINT_BITS, MAX_KICKS, LOAD, ALGORITHM = 4, 16, 500, 0.95, "siphash"
#: Keys of a bucket of BucketSketches.
KEYS_EACH = 50_000
_U = np.uint64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def siphash(messages: np.ndarray, seed: int) -> np.ndarray:
    """SipHash-2-4 of each row of bytes, with the keys seed and seed rotated by 32 bits."""
    n, size = messages.shape
    padded = np.zeros((n, size // 8 * 8 + 8), np.uint8)
    padded[:, :size] = messages
    padded[:, -1] = size & 0xFF
    blocks = padded.view("<u8")
    k0, k1 = _U(seed), _U(((seed << 32) | (seed >> 32)) & (2**64 - 1))
    # The initial state of SipHash.
    v = [np.full(n, _U(c) ^ k) for c, k in ((0x736F6D6570736575, k0), (0x646F72616E646F6D, k1), (0x6C7967656E657261, k0), (0x7465646279746573, k1))]

    def rounds(count: int) -> None:
        for _ in range(count):
            v[0] += v[1]
            v[2] += v[3]
            v[1], v[3] = _rotate(v[1], 13) ^ v[0], _rotate(v[3], 16) ^ v[2]
            v[0] = _rotate(v[0], 32)
            v[2] += v[1]
            v[0] += v[3]
            v[1], v[3] = _rotate(v[1], 17) ^ v[2], _rotate(v[3], 21) ^ v[0]
            v[2] = _rotate(v[2], 32)

    for b in blocks.T:
        v[3] = v[3] ^ b
        rounds(2)
        v[0] = v[0] ^ b
    v[2] = v[2] ^ _U(0xFF)
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def hash_keys(keys: Iterable[bytes], seed: int) -> np.ndarray:
    """Hashes of byte strings of any lengths; each is preceded by its length as eight bytes."""
    keys = list(keys)
    out, sizes = np.zeros(len(keys), np.uint64), np.array([len(k) for k in keys], dtype=np.int64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        body = np.frombuffer(b"".join(keys[i] for i in own), np.uint8).reshape(len(own), size)
        head = np.frombuffer(int(size).to_bytes(8, "little"), np.uint8)
        out[own] = siphash(np.concatenate((np.broadcast_to(head, (len(own), 8)), body), axis=1), seed)
    return out


class TableFull(ValueError):
    pass


@dataclass
class Cuckoo:
    """The sketch itself: ``table`` has a row for each bucket, 0 for a free place."""

    seed: int
    table: np.ndarray
    _jump: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def sized(cls, capacity: int, seed: int = 0) -> Cuckoo:
        buckets = 1
        while buckets < -(-capacity // (LOAD * SLOTS)):
            buckets *= 2
        return cls(seed, np.zeros((buckets, SLOTS), "<u2"))

    @classmethod
    def of(cls, keys: Iterable[bytes], capacity: int | None = None, seed: int = 0) -> Cuckoo:
        keys = list(keys)
        made = cls.sized(capacity or len(keys), seed)
        for key in keys:
            made.insert(key)
        return made

    def _jumps(self) -> np.ndarray:
        """By fingerprint, what leads from one of its buckets to the other."""
        if self._jump is None:
            every = np.arange(1 << FINGERPRINT_BITS, dtype="<u2").view(np.uint8).reshape(-1, 2)
            self._jump = (siphash(every, self.seed) & _U(len(self.table) - 1)).astype(np.int64)
        return self._jump

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = ((hashes >> _U(32)) & _U(0xFFFF)).astype("<u2")
        prints = np.where(prints == 0, np.uint16(1), prints)
        first = (hashes & _U(len(self.table) - 1)).astype(np.int64)
        return prints, first, first ^ self._jumps()[prints]

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return bool(len(free))

    def insert(self, key: bytes) -> None:
        mark, first, second = (int(x[0]) for x in self._places(hash_keys([key], self.seed)))
        if self._put(first, mark) or self._put(second, mark):
            return
        bucket, jumps = first, self._jumps()
        for kick in range(MAX_KICKS):  # the newcomer takes a place, whoever was there moves to its other bucket
            place = (kick + mark) % SLOTS
            mark, self.table[bucket, place] = int(self.table[bucket, place]), mark
            bucket ^= int(jumps[mark])
            if self._put(bucket, mark):
                return
        raise TableFull(f"no place after {MAX_KICKS} moves")

    def contains(self, keys: Iterable[bytes]) -> np.ndarray:
        prints, first, second = self._places(hash_keys(keys, self.seed))
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(1)

    def remove(self, key: bytes) -> bool:
        """Forget one copy of a key; of a key that was never inserted it may hit another one."""
        mark, *buckets = (int(x[0]) for x in self._places(hash_keys([key], self.seed)))
        for bucket in buckets:
            found = np.flatnonzero(self.table[bucket] == mark)
            if len(found):
                self.table[bucket, found[0]] = 0
                return True
        return False

    def to_wire(self) -> dict:
        return {"data": self.table.tobytes(), "bucket_count": len(self.table), "entries_per_bucket": SLOTS,
                "fingerprint_bits": FINGERPRINT_BITS, "hash_seed": self.seed, "hash_algorithm": ALGORITHM}

    @classmethod
    def from_wire(cls, wire: dict) -> Cuckoo:
        """Tolerant: only data and seed count, an odd tail is left out, no data is one empty bucket."""
        data = bytes(wire.get("data") or b"")
        whole = len(data) // (2 * SLOTS) * 2 * SLOTS
        table = np.frombuffer(data[:whole], "<u2").reshape(-1, SLOTS).copy() if whole else np.zeros((1, SLOTS), "<u2")
        return cls(int(wire.get("hash_seed", 0)), table)

    def matches(self, column: Column, exact: frozenset[bytes] | None = None) -> Column:
        """BINARY column -> whether the sketch may hold it and, if they are given, it is one of the exact keys; null never."""
        wire = self.to_wire()

        @F.pandas_udf("boolean")
        def test(keys: pd.Series) -> pd.Series:
            known = keys.notna()
            out = pd.Series(False, index=keys.index)
            if known.any():
                out[known] = Cuckoo.from_wire(wire).contains(bytes(k) for k in keys[known])
            if exact is not None:
                out[out] = [bytes(k) in exact for k in keys[out]]
            return out

        return F.coalesce(test(column), F.lit(False))

    def matches_any(self, column: Column, exact: frozenset[bytes] | None = None) -> Column:
        """ARRAY<BINARY> column -> whether ``matches`` holds for one of its keys; null never."""
        wire = self.to_wire()

        @F.pandas_udf("boolean")
        def test(lists: pd.Series) -> pd.Series:
            flat = lists.explode().dropna()
            hits = flat[Cuckoo.from_wire(wire).contains(bytes(k) for k in flat)] if len(flat) else flat
            if exact is not None:
                hits = hits[[bytes(k) in exact for k in hits]]
            return pd.Series(lists.index.isin(hits.index), index=lists.index)

        return F.coalesce(test(column), F.lit(False))


@dataclass
class KeySet:
    """Exact keys with their sketch: exact tests, safe removal, and a mark of unsent changes."""

    capacity: int
    seed: int = 0
    keys: set[bytes] = field(default_factory=set)
    dirty: bool = False

    def __post_init__(self) -> None:
        self.sketch = Cuckoo.sized(self.capacity, self.seed)
        for key in self.keys:
            self.sketch.insert(key)

    def __contains__(self, key: bytes) -> bool:
        return key in self.keys

    def add(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        self.sketch.insert(key)
        self.keys.add(key)
        self.dirty = True
        return True

    def discard(self, key: bytes) -> bool:
        if key not in self.keys:
            return False
        self.keys.remove(key)
        self.sketch.remove(key)
        self.dirty = True
        return True

    def sent(self) -> dict:
        self.dirty = False
        return self.sketch.to_wire()

    def matches(self, column: Column) -> Column:
        """BINARY column -> whether it is a key: tested with the sketch, what passes is looked up; null never."""
        return self.sketch.matches(column, frozenset(self.keys))

    def matches_any(self, column: Column) -> Column:
        """ARRAY<BINARY> column -> whether ``matches`` holds for one of its keys; null never."""
        return self.sketch.matches_any(column, frozenset(self.keys))


@dataclass
class BucketSketches:
    """Sketches of a key table of any size: one for each hash bucket of about ``KEYS_EACH`` keys, built by the tasks."""

    wires: list[dict]

    @classmethod
    def of(cls, keys: DataFrame, column: str, seed: int = 0) -> BucketSketches:
        """``column`` is BINARY; only the sketches (about three bytes a key) come to the driver."""
        own = keys.select(F.col(column).alias("key")).where("key is not null").distinct()
        buckets = max(1, -(-own.count() // KEYS_EACH))

        def build(group: pd.DataFrame) -> pd.DataFrame:
            given, size = [bytes(k) for k in group["key"]], len(group)
            while True:
                try:
                    made = Cuckoo.of(given, size, seed)
                    break
                except TableFull:
                    size *= 2
            return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "data": [made.table.tobytes()]})

        dealt = own.withColumn("bucket", bucket_of(F.col("key"), buckets))
        wires: list[dict] = [{"hash_seed": seed}] * buckets
        for row in dealt.groupBy("bucket").applyInPandas(build, "bucket int, data binary").collect():
            wires[row.bucket] = {"data": bytes(row.data), "hash_seed": seed}
        return cls(wires)

    def matches(self, column: Column) -> Column:
        """BINARY column -> whether the sketch of its bucket may hold it; null never."""
        wires = self.wires

        @F.pandas_udf("boolean")
        def test(keys: pd.Series, buckets: pd.Series) -> pd.Series:
            out = pd.Series(False, index=keys.index)
            for bucket, own in keys[keys.notna()].groupby(buckets):
                out[own.index] = Cuckoo.from_wire(wires[int(bucket)]).contains(bytes(k) for k in own)
            return out

        return F.coalesce(test(column, bucket_of(column, len(wires))), F.lit(False))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def sketch_then_exact(rows: DataFrame, column: str, sketch: Cuckoo | BucketSketches, exact: DataFrame, exact_column: str) -> DataFrame:
    """Rows whose key the sketch may hold, checked again with a semi join against the exact keys."""
    likely = rows.where(sketch.matches(F.col(column)))
    keys = exact.select(F.col(exact_column).alias("_key")).distinct()
    return likely.join(keys, likely[column] == F.col("_key"), "left_semi")

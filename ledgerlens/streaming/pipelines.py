"""The engine on streams: matching, duplicate suppression, joins with watermarks, and stateful assembly of slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators import accounts
from ledgerlens.plans.request import AccountFilter

#: After so many milliseconds without an update the state of a slot or a key is dropped.
KEEP_MS = 3_600_000
#: Calls of a key that hasn't called for so long find a full bucket.
IDLE_MS = 300_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def match_accounts(stream: DataFrame, filters: Mapping[str, AccountFilter]) -> DataFrame:
    """Stateless: the same plan as in batch."""
    return accounts.match(stream, filters)


def first_of_each(stream: DataFrame, time: str = "created_at", delay: str = "10 minutes", keys=("slot", "key")) -> DataFrame:
    """The first update of each slot and key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def with_block_time(statuses: DataFrame, meta: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream-stream join by slot; both sides are held until the watermark passes."""
    left = statuses.withWatermark("created_at", delay)
    right = meta.select("slot", "block_time", F.col("created_at").alias("meta_at")).withWatermark("meta_at", delay)
    near = F.col("meta_at").between(F.col("created_at") - F.expr(f"INTERVAL {delay}"), F.col("created_at") + F.expr(f"INTERVAL {delay}"))
    return left.join(right, (left.slot == right.slot) & near).drop(right.slot)


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """Rows by ``key`` through a processor whose state lapses in processing time.

    Spark then goes on with empty micro-batches; a query with ``availableNow`` ends only if
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.
    """
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


class SlotSealer(StatefulProcessor):
    """Counts a slot's transactions and entries until its meta is there and both counts are reached; seals once.

    Data after the seal is counted as late. State is five values a slot, so slots may have any number of rows; it lapses
    ``keep_ms`` after the slot's last row.
    """

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slot", "n_tx long, n_entries long, want_tx long, want_entries long, sealed boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n_tx, n_entries, want_tx, want_entries, sealed = self.state.get() if self.state.exists() else (0, 0, None, None, False)
        late = 0
        for part in rows:
            data, meta = part[part.kind != "block_meta"], part[part.kind == "block_meta"]
            late += len(data) if sealed else 0
            n_tx += 0 if sealed else int((data.kind == "transaction").sum())
            n_entries += 0 if sealed else int((data.kind == "entry").sum())
            if len(meta) and want_tx is None:
                want_tx, want_entries = int(meta.want_tx.iloc[0]), int(meta.want_entries.iloc[0])
        done = not sealed and want_tx is not None and n_tx + n_entries > 0 and n_tx >= want_tx and n_entries >= want_entries
        self.state.update((n_tx, n_entries, want_tx, want_entries, sealed or done))
        if done or late:
            yield pd.DataFrame({"slot": [key[0]], "sealed": [done], "n_tx": [n_tx], "n_entries": [n_entries], "late": [late]})

    def close(self) -> None:
        pass


def seal_slots(stream: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """``stream`` (slot, kind, want_tx, want_entries) -> a row when a slot is sealed, and for late data."""
    out = "slot long, sealed boolean, n_tx long, n_entries long, late long"
    return _stateful(stream, "slot", SlotSealer(keep_ms), out)


class Quarantine(StatefulProcessor):
    """The reconnecting client: payload of a sealed slot is held until a block meta of the slot comes again.

    Held rows are a list state of their own. A row of kind ``reconnect`` seals the slot without a hash if it isn't sealed
    yet; one of kind ``created_bank`` passes and starts the slot anew: its seal and what it holds go. State lapses
    ``keep_ms`` after the slot was last sealed, or rows were held.
    """

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sealed = handle.getValueState("sealed", "is_sealed boolean, blockhash string", self.keep_ms)
        self.held = handle.getListState("held", "seq long, kind string", self.keep_ms)

    def _let_go(self) -> list[tuple]:
        rows = list(self.held.get()) if self.held.exists() else []
        self.held.clear()
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        sealed, own = was = self.sealed.get() if self.sealed.exists() else (False, None)
        out, waiting = [], []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.kind == "created_bank":
                sealed, own = False, None
                out += [(key[0], *x, "discard") for x in [*self._let_go(), *waiting]]
                waiting = []
                out.append((key[0], r.seq, r.kind, "pass"))
            elif r.kind == "reconnect":
                sealed = True
            elif r.kind == "block_meta":
                same = own is not None and own == r.blockhash
                if sealed:
                    out += [(key[0], *x, "discard" if same else "flush") for x in [*self._let_go(), *waiting]]
                    waiting = []
                out.append((key[0], r.seq, r.kind, "discard" if same else "pass"))
                sealed, own = True, r.blockhash
            elif r.kind != "slot" and sealed:
                waiting.append((r.seq, r.kind))
            else:
                out.append((key[0], r.seq, r.kind, "pass"))
        if (sealed, own) != tuple(was):
            self.sealed.update((sealed, own))
        if waiting:
            self.held.appendList(waiting)
        yield pd.DataFrame(out, columns=["slot", "seq", "kind", "verdict"])

    def close(self) -> None:
        pass


def quarantine(stream: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """``stream`` (slot, seq, kind, blockhash) -> verdicts, as they fall; what is still held has none yet.

    A lost connection is one row of kind ``reconnect`` for each slot in flight.
    """
    out = "slot long, seq long, kind string, verdict string"
    return _stateful(stream, "slot", Quarantine(keep_ms), out)


class Bucket(StatefulProcessor):
    """A token bucket a key, in whole numbers as in the batch form; its state lapses ``keep_ms`` after the last call.

    That must not be less than the window, in which an empty bucket fills.
    """

    def __init__(self, max_hits: int, window_seconds: int, keep_ms: int):
        self.max_hits, self.window, self.keep_ms = max_hits, window_seconds * 1_000_000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "level long, last long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        level, last = self.state.get() if self.state.exists() else (self.max_hits * self.window, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_us", "seq"]).itertuples():
            last = r.ts_us if last is None else last
            level = min(self.max_hits * self.window, level + max(0, r.ts_us - last) * self.max_hits)
            last = max(last, r.ts_us)
            allowed = level >= self.window and self.max_hits > 0
            level -= self.window if allowed else 0
            out.append((key[0], r.seq, allowed))
        self.state.update((int(level), int(last)))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed"])

    def close(self) -> None:
        pass


def token_bucket(stream: DataFrame, max_hits: int, window_seconds: int) -> DataFrame:
    """``stream`` (key of any type, seq, ts_us) -> decisions."""
    keep_ms = max(IDLE_MS, window_seconds * 1000)
    out = f"key {stream.schema['key'].dataType.simpleString()}, seq long, allowed boolean"
    return _stateful(stream, "key", Bucket(max_hits, window_seconds, keep_ms), out)


def write(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> DataStreamWriter:
    """A file sink that continues from its checkpoint; ``availableNow`` works off what is there."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)


def write_by_subscriber(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """One row a subscriber's filter name and update, handed over batch by batch."""
    flat = stream.withColumn("filter", F.explode("filters"))
    return flat.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)

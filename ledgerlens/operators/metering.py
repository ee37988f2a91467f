"""Usage metering, limits and statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes after which usage is reported; calls and seconds of the server's own rate limit.
REPORT_BYTES, FALLBACK_CALLS, FALLBACK_SECONDS = 32 * 1024, 1000, 10
BILLING_BATCH_BYTES = 4096


def kind_stats(rows: DataFrame, kind: Column, size: Column) -> DataFrame:
    """Count and bytes by kind, with a total (kind null)."""
    return rows.select(kind.alias("kind"), size.cast("long").alias("size")).rollup("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def usage(rows: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    """Requests and bytes by subscriber, method or the like."""
    return rows.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(size.cast("long")).alias("bytes"))


def billing_lines(totals: DataFrame, code: str) -> DataFrame:
    """JSON lines of usage: code, subscription_id, method, quantity."""
    return totals.select(F.to_json(F.struct(F.lit(code).alias("code"), "subscription_id", "method", "quantity")).alias("value"))


def size_histogram(rows: DataFrame, size: Column, bounds: Sequence[int]) -> DataFrame:
    """(le, n): rows whose size is at most each bound; the last bound is open (null)."""
    le = F.element_at(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= size), 1)
    le = F.when(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= size)) > 0, le)
    return rows.groupBy(le.cast("long").alias("le")).agg(F.count("*").alias("n"))


def effective_limits(calls: DataFrame, plans: DataFrame, fallback: tuple[int, int] = (FALLBACK_CALLS, FALLBACK_SECONDS)) -> DataFrame:
    """``calls`` with max_hits and window_seconds: of the plan's method, else of the plan (method null), else the server's.

    A negative limit is none (max_hits null).
    """
    own = plans.where("method is not null").select("plan", "method", F.struct("max_hits", "window_seconds").alias("_own"))
    general = plans.where("method is null").select("plan", F.struct("max_hits", "window_seconds").alias("_general"))
    joined = calls.join(own, ["plan", "method"], "left").join(general, "plan", "left")
    limit = F.coalesce("_own", "_general", F.struct(F.lit(fallback[0]).cast("long").alias("max_hits"), F.lit(fallback[1]).cast("long").alias("window_seconds")))
    out = joined.withColumn("_limit", limit).drop("_own", "_general")
    return out.withColumns({"max_hits": F.when(F.col("_limit.max_hits") >= 0, F.col("_limit.max_hits")), "window_seconds": F.col("_limit.window_seconds")}).drop("_limit")


def _in_order(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order)


def token_bucket(calls: DataFrame, max_hits: int, window_seconds: int, key: str = "key", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """``calls`` (key, seq, ts in microseconds) with allowed and retry_us, the wait until the next one would be.

    Buckets start full, fill evenly to ``max_hits`` a window and give one for each allowed call. Each key is folded in
    order of time over sorted batches with one number of state, so a key may have any number of calls. Levels are
    counted in 1 / window microseconds, which keeps them whole. No hits at all always denies (retry null).
    """
    window = window_seconds * 1_000_000
    full = max_hits * window

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, level, last = object(), 0, 0
        for batch in batches:
            allowed, retry = [], []
            for k, t in zip(batch[key], batch[ts], strict=True):
                if k != at:
                    at, level, last = k, full, t
                level = min(full, level + max(0, t - last) * max_hits)
                last = max(last, t)
                allowed.append(level >= window and max_hits > 0)
                retry.append(None if not max_hits else 0 if allowed[-1] else -(-(window - level) // max_hits))
                level -= window if allowed[-1] else 0
            yield pd.DataFrame({key: batch[key], seq: batch[seq], ts: batch[ts], "allowed": allowed, "retry_us": pd.array(retry, dtype="Int64")})

    rows = _in_order(calls.select(key, seq, ts), key, [ts, seq])
    kind = calls.schema[key].dataType.simpleString()
    return rows.mapInPandas(fold, f"{key} {kind}, {seq} long, {ts} long, allowed boolean, retry_us long")


def limited_calls(calls: DataFrame, key: str = "key", seq: str = "seq", ts: str = "ts_us") -> DataFrame:
    """``calls`` (key, method, seq, ts in microseconds) with their ``effective_limits`` -> (key, method, seq, allowed).

    Each subscriber, method and limit has a bucket of its own. Calls without a limit (max_hits null) are allowed and not
    sorted; a limit of 0 always denies. Levels are whole numbers, as in ``token_bucket``.
    """
    bucket = [key, "method", "max_hits", "window_seconds"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, level, last = None, 0, 0
        for batch in batches:
            allowed = []
            for *b, t in zip(*[batch[c] for c in bucket], batch[ts], strict=True):
                window, most = b[3] * 1_000_000, b[2]
                if b != at:
                    at, level, last = b, most * window, t
                level = min(most * window, level + max(0, t - last) * most)
                last = max(last, t)
                allowed.append(most > 0 and level >= window)
                level -= window if allowed[-1] else 0
            yield pd.DataFrame({key: batch[key], "method": batch["method"], seq: batch[seq], "allowed": allowed})

    rows = calls.select(*bucket, seq, ts)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    sorted_rows = rows.where("max_hits is not null").fillna("", "method").repartition(*bucket).sortWithinPartitions(*bucket, ts, seq)
    decided = sorted_rows.mapInPandas(fold, f"{key} {kinds[key]}, method string, {seq} {kinds[seq]}, allowed boolean")
    return decided.unionByName(rows.where("max_hits is null").fillna("", "method").select(key, "method", seq, F.lit(True).alias("allowed")))


def admitted(changes: DataFrame, cap: int, key: str = "key", seq: str = "seq", subscription: str = "subscription") -> DataFrame:
    """``changes`` (key, seq, subscription, step 1 or -1) -> (key, seq, open, allowed): the cap that refuses.

    An opening is refused while ``cap`` subscriptions of the key are open; one that is open already keeps its place.
    Closing what isn't open (or was refused) changes nothing. A key is folded in order of seq; its state is at most
    ``cap`` names.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, names = object(), set()
        for batch in batches:
            n_open, allowed = [], []
            for k, name, step in zip(batch[key], batch[subscription], batch["step"], strict=True):
                if k != at:
                    at, names = k, set()
                fine = step < 0 or name in names or len(names) < cap
                if step < 0:
                    names.discard(name)
                elif fine:
                    names.add(name)
                n_open.append(len(names))
                allowed.append(fine)
            yield pd.DataFrame({key: batch[key], seq: batch[seq], "open": n_open, "allowed": allowed})

    rows = _in_order(changes.select(key, seq, subscription, "step"), key, [seq])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(fold, f"{key} {kinds[key]}, {seq} {kinds[seq]}, open long, allowed boolean")


def billing_batches(lines: DataFrame, limit: int = BILLING_BATCH_BYTES) -> DataFrame:
    """Lines (value) joined by line feeds to bodies; one is closed by the line that brings it to ``limit`` bytes, the last of
    each partition when its lines end. No order and no shuffle is needed."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            bodies = []
            for line in batch["value"]:
                held.append(line)
                size += len(line.encode()) + 1
                if size >= limit:
                    bodies.append(("\n".join(held) + "\n", len(held), size))
                    held, size = [], 0
            yield pd.DataFrame(bodies, columns=["body", "n_lines", "bytes"])
        if held:
            yield pd.DataFrame([("\n".join(held) + "\n", len(held), size)], columns=["body", "n_lines", "bytes"])

    return lines.where("value is not null").select("value").mapInPandas(fold, "body string, n_lines long, bytes long")


def bandwidth_reports(rows: DataFrame, threshold: int = REPORT_BYTES, key: str = "key", seq: str = "seq", size: str = "size") -> DataFrame:
    """(key, seq, reported): bytes so far are reported, and counted anew, at each row that brings them to the threshold;
    what is left at a key's last row is reported there."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, last, started = None, 0, 0, False
        for batch in batches:
            out = []
            for k, s, n in zip(batch[key], batch[seq], batch[size], strict=True):
                if started and k != at and total:
                    out.append((at, last, total))
                if not started or k != at:
                    at, total, started = k, 0, True
                total, last = total + n, s
                if total >= threshold:
                    out.append((at, s, total))
                    total = 0
            yield pd.DataFrame(out, columns=[key, seq, "reported"])
        if started and total:
            yield pd.DataFrame([(at, last, total)], columns=[key, seq, "reported"])

    kind = rows.schema[key].dataType.simpleString()
    return _in_order(rows.select(key, seq, size), key, [seq]).mapInPandas(fold, f"{key} {kind}, {seq} long, reported long")


def most_open(intervals: DataFrame, key: str = "key") -> DataFrame:
    """(key, most_open): the largest number of connections (start, end) of a key that are open at once.

    An end frees its place before a start at the same time takes one.
    """
    steps = intervals.select(key, F.col("start").alias("at"), F.lit(1).alias("step")).union(intervals.select(key, F.col("end").alias("at"), F.lit(-1).alias("step")))
    steps = steps.where("at is not null").groupBy(key, "at", "step").agg(F.sum("step").alias("change"))
    running = F.sum("change").over(Window.partitionBy(key).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", running).groupBy(key).agg(F.max("open").alias("most_open"))


def subscriptions(changes: DataFrame, cap: int, key: str = "key", seq: str = "seq") -> DataFrame:
    """``changes`` (key, seq, step 1 or -1) with open, the subscriptions of the key after each, and over its cap or not.

    This is the form that only reports: nothing is refused, so a running sum tells.
    """
    so_far = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("open", F.sum("step").over(so_far)).withColumn("over", F.col("open") > cap)


def resolve(calls: DataFrame, tokens: DataFrame, token: str = "token") -> DataFrame:
    """``calls`` with the subscription_id of their token, and allowed: whether ``tokens`` (each once) has it."""
    known = tokens.select(F.col(token).alias("_token"), "subscription_id")
    joined = calls.join(known, F.col(token) == F.col("_token"), "left")
    return joined.withColumn("allowed", F.col("_token").isNotNull()).drop("_token")


def over_cap(intervals: DataFrame, cap: int, key: str = "key") -> DataFrame:
    return most_open(intervals, key).withColumn("over", F.col("most_open") > cap)

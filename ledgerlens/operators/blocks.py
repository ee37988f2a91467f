"""Slots and blocks in batch form: status filters, last versions, completeness, assembly, commitment, forks.

Slots are partitions; nothing gathers a block into one row: its parts stay child tables keyed by slot.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.accounts import named
from ledgerlens.operators.transactions import has_any
from ledgerlens.plans.request import BlockFilter, SlotFilter
from ledgerlens.schema import COMMITMENTS, LIFECYCLE
from ledgerlens.sources.shared import with_checkpoints

#: Finalized slots that are kept beyond the replay buffer's capacity.
KEPT_FINALIZED = 10


def rank(status: Column) -> Column:
    """Position of a commitment level; null for other statuses."""
    return F.when(status.isin(*COMMITMENTS), F.array_position(F.array(*[F.lit(c) for c in COMMITMENTS]), status).cast("int") - 1)


def slot_predicate(f: SlotFilter, commitment: str | None) -> Column:
    """Without ``interslot_updates`` only the commitment levels; with ``filter_by_commitment`` only the subscription's."""
    status = F.col("status")
    own = F.lit(True) if f.interslot_updates else status.isin(*COMMITMENTS)
    if f.filter_by_commitment:
        own = own & (F.lit(False) if commitment is None else status == commitment)
    return F.coalesce(own, F.lit(False))


def match_slots(slots: DataFrame, filters: Mapping[str, SlotFilter], commitment: str | None) -> DataFrame:
    if not filters:
        return slots.withColumn("filters", F.array().cast("array<string>")).where(F.lit(False))
    return slots.withColumn("filters", named({n: slot_predicate(f, commitment) for n, f in filters.items()})).where(F.size("filters") > 0)


def match_all(rows: DataFrame, names: list[str]) -> DataFrame:
    """Entries and block metas: every row, with all filter names; none without filters."""
    listed = F.array(*[F.lit(n) for n in sorted(names)]) if names else F.array().cast("array<string>")
    return rows.withColumn("filters", listed).where(F.lit(bool(names)))


def last_versions(accounts: DataFrame) -> DataFrame:
    """Accounts with the highest write version of their key in their slot; equal highest ones all stay.

    Highest versions are combined before they are shuffled, and rows meet them by version as well, so the versions of
    a very busy key are spread over the tasks. Null keys are a key of their own; rows without a version go.
    """
    top = accounts.groupBy(F.col("slot").alias("_slot"), F.col("pubkey").alias("_pubkey")).agg(F.max("write_version").alias("_top"))
    same = F.col("slot").eqNullSafe(F.col("_slot")) & F.col("pubkey").eqNullSafe(F.col("_pubkey")) & (F.col("write_version") == F.col("_top"))
    return accounts.join(top, same, "left_semi")


def completeness(meta: DataFrame, transactions: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """meta with n_transactions (and n_entries), sealable and mismatch; slots that have no data are left out."""
    counts = transactions.groupBy("slot").agg(F.count("*").alias("n_transactions"))
    out = meta.join(counts, "slot", "left").withColumn("n_transactions", F.coalesce("n_transactions", F.lit(0)))
    done, data = F.col("n_transactions") >= F.col("executed_transaction_count"), F.col("n_transactions") > 0
    if entries is not None:
        out = out.join(entries.groupBy("slot").agg(F.count("*").alias("n_entries")), "slot", "left")
        out = out.withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
        done, data = done & (F.col("n_entries") >= F.col("entries_count")), data | (F.col("n_entries") > 0)
    mismatch = F.col("n_transactions") != F.col("executed_transaction_count")
    return out.where(data).withColumns({"sealable": done, "mismatch": mismatch})


def block_counts(meta: DataFrame, transactions: DataFrame, accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """A row a block: how many transactions, last account versions and entries it holds."""
    parts = {"n_transactions": transactions, "updated_account_count": last_versions(accounts), "n_entries": entries}
    counted = [p.groupBy("slot").agg(F.count("*").alias(n)) for n, p in parts.items()]
    joined = reduce(lambda a, b: a.join(b, "slot", "left"), counted, meta)
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in parts})


def block_children(f: BlockFilter, kind: str, rows: DataFrame) -> DataFrame:
    """The children that a block filter shows; entries are never filtered by key."""
    if not getattr(f, f"include_{kind}"):
        return rows.where(F.lit(False))
    if kind == "entries" or not (f.account_include or f.cuckoo_account_include):
        return rows
    if kind == "accounts":
        own = F.col("pubkey").isin(list(f.account_include)) if f.account_include else F.lit(False)
        return rows.where(own | f.cuckoo_account_include.matches(F.col("pubkey").cast("binary")) if f.cuckoo_account_include else own)
    own = has_any(F.col("keys"), f.account_include) if f.account_include else F.lit(False)
    if f.cuckoo_account_include:
        own = own | f.cuckoo_account_include.matches_any(F.transform("keys", lambda k: k.cast("binary")))
    return rows.where(own)


def match_blocks(meta: DataFrame, transactions: DataFrame, accounts: DataFrame, entries: DataFrame, filters: Mapping[str, BlockFilter]) -> DataFrame:
    """One row a block and filter, with the numbers of shown children; a filter hides children, never the block."""
    whole = last_versions(accounts)
    counts = whole.groupBy("slot").agg(F.count("*").alias("updated_account_count"))
    base = meta.join(counts, "slot", "left").withColumn("updated_account_count", F.coalesce("updated_account_count", F.lit(0)))
    out = []
    for name, f in sorted(filters.items()):
        shown = base
        for kind, rows in (("transactions", transactions), ("accounts", whole), ("entries", entries)):
            n = block_children(f, kind, rows).groupBy("slot").agg(F.count("*").alias(f"n_{kind}"))
            shown = shown.join(n, "slot", "left").withColumn(f"n_{kind}", F.coalesce(f"n_{kind}", F.lit(0)))
        out.append(shown.withColumn("filters", F.array(F.lit(name))))
    return reduce(DataFrame.unionByName, out) if out else base.withColumn("filters", F.array().cast("array<string>")).where(F.lit(False))


def progression(statuses: DataFrame) -> DataFrame:
    """(slot, levels seen in order, highest level), repeats not counted; other statuses don't count."""
    seen = statuses.withColumn("rank", rank(F.col("status"))).where("rank is not null").groupBy("slot")
    found = seen.agg(F.array_sort(F.collect_set("rank")).alias("ranks"), F.max("rank").alias("top"))
    name = F.array(*[F.lit(c) for c in COMMITMENTS])
    return found.select("slot", F.transform("ranks", lambda r: F.get(name, r)).alias("levels"), F.get(name, F.col("top")).alias("commitment"))


def gap_fill(statuses: DataFrame) -> DataFrame:
    """(slot, step, status): every level up to the highest one seen, in order."""
    top = statuses.withColumn("rank", rank(F.col("status"))).where("rank is not null").groupBy("slot").agg(F.max("rank").alias("top"))
    steps = top.select("slot", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("step"))
    return steps.withColumn("status", F.get(F.array(*[F.lit(c) for c in COMMITMENTS]), F.col("step")))


def at_each_level(sealed: DataFrame, statuses: DataFrame) -> DataFrame:
    """Sealed blocks, once for each commitment level that their slot has reached (levels below the highest included)."""
    return sealed.join(gap_fill(statuses), "slot")


def lifecycle(statuses: DataFrame) -> DataFrame:
    """Statuses as the state machine takes them: a commitment status with an error is a dead slot."""
    dead = F.col("dead_error").isNotNull() & F.col("status").isin(*COMMITMENTS)
    return statuses.withColumn("event", F.when(dead, "dead").otherwise(F.col("status")))


def route(statuses: DataFrame, sealed: DataFrame) -> DataFrame:
    """Statuses by channel: those of a slot's life at once to all, commitment levels to all once the block is sealed."""
    channels = F.explode(F.array(*[F.lit(c) for c in COMMITMENTS])).alias("channel")
    known = sealed.select("slot").distinct()
    early = statuses.where(F.col("status").isin(*LIFECYCLE))
    held = statuses.where(F.col("status").isin(*COMMITMENTS)).join(known, "slot", "left_semi")
    return early.unionByName(held).select("*", channels)


def prune(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the slots of forks, dead slots and reset banks."""
    return rows.join(gone.select("slot").distinct(), "slot", "left_anti")


def tracked(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Only data of slots that are known."""
    return rows.join(slots.select("slot").distinct(), "slot", "left_semi")


def untracked(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, dropped): how many rows of each unknown slot ``tracked`` leaves out."""
    return rows.join(slots.select("slot").distinct(), "slot", "left_anti").groupBy("slot").agg(F.count("*").alias("dropped"))


def late(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """``rows`` (slot, seq) with ``late``: after the seq at which their slot was frozen (slot, frozen_seq)."""
    joined = rows.join(frozen.select("slot", "frozen_seq"), "slot", "left")
    return joined.withColumn("late", F.coalesce(F.col("seq") > F.col("frozen_seq"), F.lit(False))).drop("frozen_seq")


def retained(progress: DataFrame, capacity: int) -> DataFrame:
    """What a replay buffer keeps of its slots: the oldest go while there are more than ``capacity`` slots and more than
    ``KEPT_FINALIZED`` finalized ones."""

    def last_dropped(slots: DataFrame, kept: int) -> int | None:
        top = slots.orderBy(F.desc("slot")).limit(kept + 1).agg(F.min("slot"), F.count("*")).first()
        return top[0] if top[1] == kept + 1 else None

    by_size = last_dropped(progress.select("slot"), capacity)
    by_level = last_dropped(progress.where(F.col("commitment") == COMMITMENTS[-1]).select("slot"), KEPT_FINALIZED)
    if by_size is None or by_level is None:
        return progress
    return progress.where(F.col("slot") > min(by_size, by_level))


def finalized_with_ancestors(meta: DataFrame, finalized: DataFrame) -> DataFrame:
    """Slots that are finalized or from which a finalized slot descends along parent_slot.

    Each round doubles the length of the jumps to an ancestor, so a chain of n slots takes log2 n rounds.
    """
    with_checkpoints(meta.sparkSession)
    known = finalized.select("slot").distinct()
    jump = meta.select("slot", F.col("parent_slot").alias("up")).where("up is not null and up <> slot")
    jump = jump.join(meta.select(F.col("slot").alias("up")), "up", "left_semi").select("slot", "up").checkpoint()
    while not jump.isEmpty():
        above = jump.join(known, "slot", "left_semi").select(F.col("up").alias("slot"))
        known = known.union(above).distinct().checkpoint()
        further = jump.withColumnsRenamed({"slot": "mid", "up": "far"})
        jump = jump.join(further, jump.up == further.mid).select("slot", F.col("far").alias("up")).where("slot <> up").checkpoint()
    return known

"""Replay from a slot, point lookups, and duplicate suppression after a reconnect, in batch form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.blocks import rank
from ledgerlens.plans.request import RESERVED_NAME, EmptyFilter, Request, RequestError
from ledgerlens.schema import COMMITMENTS

# The order of delivery within a slot; how many blockhashes stay valid, and how many more are kept.
PHASES = ("content", "block", "block_meta", "status")
MAX_RECENT_BLOCKHASHES, MORE_BLOCKHASHES, KEPT_METAS = 300, 32, 3
CHECKPOINT_BACK = 2
KEPT_SLOTS = 250


def first_available_slot(history: DataFrame) -> DataFrame:
    return history.agg(F.min("slot").alias("first_available"))


def replay(history: DataFrame, progress: DataFrame, from_slot: int, commitment: str, check: bool = True) -> DataFrame:
    """History rows (slot, phase, seq, ...) of the slots from ``from_slot`` that reached ``commitment``, in order.

    A slot before the oldest one is an error that names the oldest; nothing to replay is an empty result.
    """
    if check:
        oldest = first_available_slot(history).first()[0]
        if oldest is not None and from_slot < oldest:
            raise RequestError(f"slot {from_slot} is gone: the history starts at slot {oldest}")
    wanted = rank(F.col("commitment")) >= COMMITMENTS.index(commitment)
    reached = progress.where(wanted & (F.col("slot") >= from_slot)).select("slot")
    return history.where(F.col("slot") >= from_slot).join(reached, "slot", "left_semi").orderBy("slot", "phase", "seq")


def latest_slot(statuses: DataFrame, commitment: str) -> DataFrame:
    """The slot of the status received last (by seq), which need not be the highest."""
    return statuses.where(F.col("status") == commitment).agg(F.max_by("slot", F.struct("seq", "slot")).alias("slot"))


def lookup(statuses: DataFrame, meta: DataFrame, commitment: str) -> DataFrame:
    """Slot, height and hash for a commitment, with the last height at which the hash is valid; empty if unknown."""
    found = latest_slot(statuses, commitment).join(meta, "slot")
    valid = (F.col("block_height") + MAX_RECENT_BLOCKHASHES).alias("last_valid_block_height")
    return found.select("slot", "blockhash", "block_height", valid)


def blockhash_validity(statuses: DataFrame, meta: DataFrame) -> DataFrame:
    """(blockhash, a flag for each commitment) of the known blocks."""
    seen = statuses.join(meta.select("slot", "blockhash"), "slot").groupBy("blockhash")
    return seen.agg(*[F.coalesce(F.bool_or(F.col("status") == c), F.lit(False)).alias(c) for c in COMMITMENTS])


def is_blockhash_valid(validity: DataFrame, blockhash: str, commitment: str, least: int = MAX_RECENT_BLOCKHASHES + MORE_BLOCKHASHES) -> DataFrame:
    """One row: valid; null while fewer than ``least`` hashes are known, false for an unknown one."""
    own = F.coalesce(F.bool_or((F.col("blockhash") == blockhash) & F.col(commitment)), F.lit(False))
    return validity.agg(F.when(F.count("*") >= least, own).alias("valid"))


def kept_lookup_state(meta: DataFrame, finalized_slot: int) -> DataFrame:
    """Metas that lookups keep once a slot is finalized."""
    return meta.where(F.col("slot") >= finalized_slot - KEPT_METAS)


def kept_hashes(hashes: DataFrame, finalized_slot: int) -> DataFrame:
    """Hashes (with their slot) that lookups keep once a slot is finalized."""
    return hashes.where(F.col("slot") >= finalized_slot - MAX_RECENT_BLOCKHASHES - MORE_BLOCKHASHES)


def dedup_key() -> Column:
    """What makes an update the same as another of its slot, by kind (columns of a union of kinds)."""
    text = lambda *names: F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    parts = {
        "slot": text("status"), "account": text("pubkey", "txn_signature"), "transaction": text("idx"), "transaction_status": text("idx"),
        "entry": text("idx"), "block_meta": text("blockhash"), "block": F.lit(""), "deshred": text("signature"),
    }
    return reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.concat(F.lit(f"{kv[0]}|"), kv[1])), parts.items(), F)


def first_of_each(updates: DataFrame, key: str = "key") -> DataFrame:
    """The first update (by seq) of each slot and key; updates without a key (pings) all pass."""
    first = updates.where(F.col(key).isNotNull()).groupBy("slot", key).agg(F.min("seq").alias("seq"))
    keyed = updates.join(first, ["slot", key, "seq"], "left_semi")
    return keyed.unionByName(updates.where(F.col(key).isNull()).select(keyed.columns))


def _created_bank() -> Column:
    return (F.col("kind") == "slot") & (F.col("status") == "created_bank")


def with_epochs(updates: DataFrame) -> DataFrame:
    """``updates`` with epoch: how often their slot's bank was created so far. Each creation after a rollback starts anew."""
    so_far = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return updates.withColumn("epoch", F.count_if(_created_bank()).over(so_far))


def first_after_rollbacks(updates: DataFrame, key: str = "key") -> DataFrame:
    """(slot, epoch, key, seq): the first update of each key of a slot since its bank was last created."""
    keyed = with_epochs(updates).where(F.col(key).isNotNull())
    return keyed.groupBy("slot", "epoch", key).agg(F.min("seq").alias("seq"))


def remembered_slots(updates: DataFrame, keep: int = KEPT_SLOTS) -> DataFrame:
    """(slot, first_seen) of the ``keep`` slots that a client still knows: those first seen last, since their last bank.

    A slot that was forgotten and came again counts from its first update.
    """
    seen = updates.groupBy("slot").agg(F.coalesce(F.max(F.when(_created_bank(), F.col("seq"))), F.min("seq")).alias("first_seen"))
    return seen.orderBy(F.desc("first_seen")).limit(keep)


def first_of_remembered(updates: DataFrame, keep: int = KEPT_SLOTS, key: str = "key") -> DataFrame:
    """``first_after_rollbacks``, of the slots that a client still knows and since their last bank: its memory at the end."""
    known = remembered_slots(updates, keep).select("slot", "first_seen")
    firsts = first_after_rollbacks(updates, key)
    return firsts.join(known, "slot").where(F.col("seq") >= F.col("first_seen")).drop("first_seen")


def quarantine(updates: DataFrame, reconnects: Sequence[int] = ()) -> DataFrame:
    """Updates (seq, slot, kind, blockhash) with a verdict of the reconnecting client.

    A slot's first block meta seals it. Payload after that is held until the next block meta of the slot: with the
    same hash it is discarded, with another it is flushed before that meta; without one it stays held. Statuses pass.
    ``reconnects``: after each of these seqs the slots seen before and not sealed yet are sealed without a hash, so their
    payload is held too, and is flushed by any block meta.
    """
    in_order = Window.partitionBy("slot").orderBy("seq")
    meta = F.col("kind") == "block_meta"
    before = F.last(F.when(meta, F.col("blockhash")), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("slot").orderBy(F.desc("seq"))  # a growing frame: linear in the rows of a slot
    after = F.last(F.when(meta, F.col("blockhash")), True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    seen = updates.withColumns({"_before": before, "_after": after})
    same = F.coalesce(F.when(meta, F.col("blockhash")).otherwise(F.col("_after")) == F.col("_before"), F.lit(False))
    sealed = F.col("_before").isNotNull()
    if reconnects:
        seen = seen.withColumn("_first", F.min("seq").over(Window.partitionBy("slot")))
        sealed = sealed | F.exists(F.array(*[F.lit(int(r)) for r in reconnects]), lambda r: (F.col("_first") < r) & (r < F.col("seq")))
    verdict = (
        F.when((F.col("kind") == "slot") | ~sealed, "pass")
        .when(meta & same, "discard").when(meta, "pass")
        .when(F.col("_after").isNull(), "held").when(same, "discard").otherwise("flush")
    )
    return seen.withColumn("verdict", verdict).drop("_before", "_after", "_first")


def resume_slot(updates: DataFrame, first_available: int | None = None) -> DataFrame:
    """Where a client resumes: some slots before its last block meta; null (from the newest) where the server, whose oldest
    slot is ``first_available``, has that no more."""
    meta = updates.where(F.col("kind") == "block_meta")
    found = meta.agg((F.max_by("slot", "seq") - CHECKPOINT_BACK).alias("from_slot"))
    if first_available is None:
        return found
    return found.select(F.when(F.col("from_slot") >= first_available, F.col("from_slot")).alias("from_slot"))


def after_reconnect(updates: DataFrame, lost: int, policy: str = "recover", first_available: int | None = None) -> DataFrame:
    """What a client is sent that lost its connection after seq ``lost``.

    ``skip``: only what is new. ``recover``: first all since its checkpoint once more (``replayed`` true); nothing of it
    where the server has the checkpoint's slot no more, or no block meta had come.
    """
    if policy not in ("skip", "recover"):
        raise ValueError(f"unknown policy {policy!r}: skip or recover")
    sent = updates.withColumn("replayed", F.col("seq") <= lost)
    if policy == "skip":
        return sent.where(~F.col("replayed"))
    start = resume_slot(updates.where(F.col("seq") <= lost), first_available).first()[0]
    return sent.where(~F.col("replayed") | (F.col("slot") >= F.lit(start).cast("long")))


def with_internal(request: Request) -> Request:
    """The request with the client's own block meta filter, by which it keeps its checkpoint; not needed where it has one."""
    return request if request.blocks_meta else replace(request, blocks_meta={RESERVED_NAME: EmptyFilter()})




def strip_internal(updates: DataFrame) -> DataFrame:
    """Without the client's own filter name; updates that only it matched go."""
    own = F.array_remove("filters", RESERVED_NAME)
    return updates.withColumn("filters", own).where(F.size("filters") > 0)


def with_block_time(statuses: DataFrame, meta: DataFrame) -> DataFrame:
    """Transaction statuses with the time of their block."""
    return statuses.join(meta.select("slot", "block_time"), "slot")

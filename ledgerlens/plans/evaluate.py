"""A whole request over the message tables: one plan for each kind of message that the request names."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import accounts, blocks, transactions
from ledgerlens.plans.request import Limits, Request, check
from ledgerlens.schema import COMMITMENTS

# What tells the updates of a slot apart, by kind.
KEYS = {"accounts": "pubkey", "slots": "status", "transactions": "signature", "transactions_status": "signature",
        "entries": "idx", "blocks": "blockhash", "blocks_meta": "blockhash", "deshred_transactions": "signature"}


def at_level(rows: DataFrame, slots: DataFrame, level: str) -> DataFrame:
    """Rows of the slots that reached a commitment level; everything is processed."""
    if level == COMMITMENTS[0]:
        return rows
    reached = slots.where(blocks.rank(F.col("status")) >= COMMITMENTS.index(level)).select("slot").distinct()
    return rows.join(reached, "slot", "left_semi")


def evaluate(request: Request, tables: Mapping[str, DataFrame], limits: Limits | None = None) -> dict[str, DataFrame]:
    """The updates of a checked request by kind, each with the names of the filters that match.

    ``tables``: accounts, slots, transactions (see ``transactions.from_raw``), entries, block_meta and deshred, as far as
    the request needs them. A transaction is tested by the filters for transactions and by those for statuses, and can
    give an update of both kinds. Messages of slots below the request's commitment level don't count; statuses of slots
    and transactions before execution have no level. Data slices apply to accounts, after the filters.
    """
    check(request, limits)
    level = request.level
    rows = lambda name: at_level(tables[name], tables["slots"], level) if level != COMMITMENTS[0] else tables[name]
    out = {}
    if request.accounts:
        found = accounts.match(rows("accounts"), request.accounts)
        out["accounts"] = accounts.slice_data(found, request.data_slices) if request.data_slices else found
    if request.slots:
        out["slots"] = blocks.match_slots(tables["slots"], request.slots, level)
    if request.transactions:
        out["transactions"] = transactions.match(rows("transactions"), request.transactions)
    if request.transactions_status:
        out["transactions_status"] = transactions.status(transactions.match(rows("transactions"), request.transactions_status))
    if request.entries:
        out["entries"] = blocks.match_all(rows("entries"), list(request.entries))
    if request.blocks_meta:
        out["blocks_meta"] = blocks.match_all(rows("block_meta"), list(request.blocks_meta))
    if request.blocks:
        parts = [rows(name) for name in ("block_meta", "transactions", "accounts", "entries")]
        out["blocks"] = blocks.match_blocks(*parts, request.blocks)
    if request.deshred_transactions:
        out["deshred_transactions"] = transactions.match_deshred(tables["deshred"], request.deshred_transactions)
    return out


def updates(request: Request, tables: Mapping[str, DataFrame], limits: Limits | None = None) -> DataFrame:
    """All updates of a request as one table: kind, slot, key (as text) and filters."""
    found = evaluate(request, tables, limits)
    if not found:
        raise ValueError("the request names no filters")
    parts = [
        df.select(F.lit(kind).alias("kind"), "slot", F.col(KEYS[kind]).cast("string").alias("key"), F.array_join("filters", ",").alias("filters"))
        for kind, df in found.items()
    ]
    return reduce(DataFrame.unionByName, parts)

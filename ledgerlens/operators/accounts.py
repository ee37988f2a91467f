"""Account filters as predicates, in one pass for all named filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.bytestrings import data_size, data_slices, memcmp, token_account_state
from ledgerlens.plans.request import AccountFilter, DataSize, Lamports, Memcmp, StateFilter

#: Up to so many filters are an array of conditions; more of them join their keys.
DIRECT_FILTERS = 64


def _state(s: StateFilter) -> Column:
    if isinstance(s, DataSize):
        return data_size(F.col("data"), s.size)
    if isinstance(s, Memcmp):
        return memcmp(F.col("data"), s.offset, s.data)
    if isinstance(s, Lamports):
        have, want = F.col("lamports"), F.lit(s.value if s.value < 1 << 63 else Decimal(s.value))
        return {"eq": have == want, "ne": have != want, "lt": have < want, "gt": have > want}[s.compare]
    return token_account_state(F.col("data"))


def predicate(f: AccountFilter) -> Column:
    """Fields are AND-ed; keys of a list, and the sketch beside ``account``, are OR-ed; an empty filter matches all."""
    parts = [_state(s) for s in f.state]
    if f.account or f.cuckoo:
        keys = F.col("pubkey").isin(list(f.account)) if f.account else F.lit(False)
        parts.append(keys | f.cuckoo.matches(F.col("pubkey").cast("binary")) if f.cuckoo else keys)
    if f.owner:
        parts.append(F.col("owner").isin(list(f.owner)))
    if f.nonempty_txn_signature is not None:
        parts.append(F.col("txn_signature").isNotNull() == f.nonempty_txn_signature)
    return F.coalesce(reduce(and_, parts), F.lit(False)) if parts else F.lit(True)


def named(conditions: Mapping[str, Column]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(conditions[n], F.lit(n)) for n in sorted(conditions)]))


def match_direct(accounts: DataFrame, filters: Mapping[str, AccountFilter]) -> DataFrame:
    """One projection: an array of conditions within generated code."""
    return accounts.withColumn("filters", named({n: predicate(f) for n, f in filters.items()})).where(F.size("filters") > 0)


def match_by_keys(accounts: DataFrame, filters: Mapping[str, AccountFilter]) -> DataFrame:
    """Keys of all filters are joined, one row a key, so the cost doesn't grow with the filters; then the other conditions.

    A filter without keys on one side is among the candidates of every row there.
    """
    spark = accounts.sparkSession
    out, sides = accounts, {}
    for side, column in (("account", "pubkey"), ("owner", "owner")):
        pairs = [(key, n) for n, f in filters.items() for key in set(getattr(f, side))]
        free = sorted(n for n, f in filters.items() if not getattr(f, side))
        known = F.array(*[F.lit(n) for n in free]) if free else F.array().cast("array<string>")
        if pairs:
            keys = spark.createDataFrame(pairs, f"_key {accounts.schema[column].dataType.simpleString()}, _name string")
            keys = keys.groupBy("_key").agg(F.collect_list("_name").alias(f"_{side}"))
            out = out.join(keys, F.col(column) == F.col("_key"), "left").drop("_key")
            known = F.concat(known, F.coalesce(f"_{side}", F.array().cast("array<string>")))
        sides[side] = known
    rest = {n: replace(f, account=(), owner=()) for n, f in filters.items()}
    plain = [n for n, f in rest.items() if f == AccountFilter()]
    checked = {n: predicate(f) for n, f in rest.items() if n not in plain}
    able = F.array(*[F.lit(n) for n in plain]) if plain else F.array().cast("array<string>")
    able = F.concat(able, named(checked)) if checked else able
    hits = F.array_sort(F.array_intersect(F.array_intersect(sides["account"], sides["owner"]), able))
    return out.withColumn("filters", hits).where(F.size("filters") > 0).drop("_account", "_owner")


def match(accounts: DataFrame, filters: Mapping[str, AccountFilter]) -> DataFrame:
    """``accounts`` with ``filters``, the names of the filters that match; rows that none matches go.

    No filters, no output. Both plans give the same rows; sketches are only in the direct one.
    """
    if not filters:
        return accounts.withColumn("filters", F.array().cast("array<string>")).where(F.lit(False))
    direct = len(filters) <= DIRECT_FILTERS or any(f.cuckoo for f in filters.values())
    return (match_direct if direct else match_by_keys)(accounts, filters)


def match_in_force(accounts: DataFrame, requests: Sequence[tuple[int, Mapping[str, AccountFilter]]], order: str = "write_version") -> DataFrame:
    """Each row against the filters in force at its place in ``order``: the newest of (from, filters) that isn't later.

    Rows before the first request match nothing. A request takes the place of the one before it as a whole.
    """
    asked = sorted(requests, key=lambda r: r[0])
    out = match(accounts, {})
    for i, (start, filters) in enumerate(asked):
        own = F.col(order) >= start
        own = own & (F.col(order) < asked[i + 1][0]) if i + 1 < len(asked) else own
        if filters:
            out = out.unionByName(match(accounts.where(own), filters))
    return out


def slice_data(accounts: DataFrame, slices: Sequence[tuple[int, int]]) -> DataFrame:
    """The request's data slices, after its filters."""
    return accounts.withColumn("data", data_slices(F.col("data"), slices))


def drop_owners(accounts: DataFrame, rejected: Sequence) -> DataFrame:
    """The drop list at the source; an unknown owner stays."""
    return accounts.where(~F.coalesce(F.col("owner").isin(list(rejected)), F.lit(False))) if rejected else accounts

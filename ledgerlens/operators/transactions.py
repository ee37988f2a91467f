"""Transaction, transaction status and deshred filters, and their columns from raw transaction messages.

Keys are an array column; ``err`` tells failed transactions; token owners come from the balances before and after. A
filter with a token account mode is tested on the keys together with the owners of that mode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from ledgerlens.functions.base58 import decode_keys
from ledgerlens.operators.accounts import named
from ledgerlens.plans.request import DeshredFilter, TransactionFilter


def account_keys(*parts: Column) -> Column:
    """Static and loaded keys as one set."""
    empty = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<binary>")))
    return F.array_distinct(F.concat(*[empty(p) for p in parts]))


def _literal(keys: Sequence) -> Column:
    return F.array(*[F.lit(k) for k in sorted(set(keys))])


def has_any(keys: Column, wanted: Sequence) -> Column:
    return F.coalesce(F.arrays_overlap(F.array_compact(keys), _literal(wanted)), F.lit(False))


def has_all(keys: Column, wanted: Sequence) -> Column:
    return F.coalesce(F.size(F.array_except(_literal(wanted), keys)) == 0, F.lit(False))


def _key_parts(f: TransactionFilter | DeshredFilter, keys: Column) -> list[Column]:
    parts = []
    sketch = getattr(f, "cuckoo_account_include", None)
    if f.account_required:
        parts.append(has_all(keys, f.account_required))
    if f.account_include or sketch:
        found = has_any(keys, f.account_include) if f.account_include else F.lit(False)
        parts.append(found | sketch.matches_any(F.transform(keys, lambda k: k.cast("binary"))) if sketch else found)
    if f.account_exclude:
        parts.append(~has_any(keys, f.account_exclude))
    return parts


_OWNERS = StructType([StructField(name, ArrayType(BinaryType())) for name in ("owners_all", "owners_changed")])


def _flat(at: pa.Array, owners: pa.Array, amounts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    rows = np.repeat(np.arange(len(owners)), pc.fill_null(pc.list_value_length(owners), 0))
    return rows, at.flatten(), owners.flatten(), pc.fill_null(amounts.flatten(), "")


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each different value, -1 for null, and the values."""
    coded = values.dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64), coded.dictionary


def _lists(n: int, rows: np.ndarray, owners: np.ndarray, keys: pa.Array) -> pa.Array:
    """The different owners of each of n rows, in order."""
    first = ~pd.Series(rows * len(keys) + owners).duplicated().to_numpy()
    rows, owners = rows[first], owners[first]
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(owners[np.argsort(rows, kind="stable")])))


def _token_owners(pre_at: pa.Array, pre_owner: pa.Array, pre_amount: pa.Array, post_at: pa.Array, post_owner: pa.Array, post_amount: pa.Array) -> pa.Array:
    """Owners of all balances of a row, and of the changed ones: balances after that are new or differ from the last one
    before of their index, and balances before that went. Owners that aren't keys count for nothing; a null index is like no other."""
    sides = _flat(pre_at, pre_owner, pre_amount), _flat(post_at, post_owner, post_amount)
    rows, (at, _), (owners, texts), (amounts, _) = np.concatenate([s[0] for s in sides]), *(_codes(pa.concat_arrays([s[i] for s in sides])) for i in (1, 2, 3))
    keys = decode_keys(texts)
    able = np.append(keys.is_valid().to_numpy(zero_copy_only=False), False)[owners]
    spots = np.where(at < 0, -1 - np.arange(len(at)), rows * (at.max(initial=0) + 1) + at)
    after = np.arange(len(rows)) >= len(sides[0][0])
    pre, post = np.flatnonzero(able & ~after), np.flatnonzero(able & after)
    last = pre[~pd.Series(spots[pre]).duplicated(keep="last").to_numpy()]
    found = pd.Index(spots[last]).get_indexer(spots[post])
    same = found >= 0
    same[same] = amounts[last[found[same]]] == amounts[post[same]]
    changed = np.concatenate((post[~same], last[~np.isin(spots[last], spots[post])]))
    n, every = len(pre_at), np.concatenate((pre, post))
    made = [_lists(n, rows[own], owners[own], keys) for own in (every, changed)]
    return pa.StructArray.from_arrays(made, ["owners_all", "owners_changed"])


#: Called so, it is run once a row; conditions on the owners would otherwise run it again.
token_owners = F.arrow_udf(_token_owners, _OWNERS).asNondeterministic()


def from_raw(raw: DataFrame) -> DataFrame:
    """Columns for filters from messages of ``schema.TRANSACTIONS``; a message's balances stay within its row.

    ``signature`` is the first one (null without any), ``failed`` whether there is an error, ``keys`` the static and
    loaded keys. Owners that aren't base58 of 32 bytes are left out, as if their balance weren't there.
    """
    meta = lambda name: F.col(f"meta.{name}")
    balances = [meta(f"{side}_token_balances.{name}") for side in ("pre", "post") for name in ("account_index", "owner", "amount")]
    found = raw.withColumn("_owners", token_owners(*balances))
    return found.select(
        "slot", "idx", F.get("signatures", F.lit(0)).alias("signature"), "is_vote", meta("err").alias("err"), meta("err").isNotNull().alias("failed"),
        account_keys(F.col("static_keys"), meta("loaded_writable"), meta("loaded_readonly")).alias("keys"),
        "_owners.owners_all", "_owners.owners_changed",
    )


def key_sets(transactions: DataFrame) -> dict[str | None, Column]:
    """The key set of each token account mode for which there are owners: the keys and the owners."""
    owners = {"ALL": "owners_all", "BALANCE_CHANGED": "owners_changed"}
    return {None: F.col("keys")} | {mode: F.array_union("keys", name) for mode, name in owners.items() if name in transactions.columns}


def predicate(f: TransactionFilter, keys: Mapping[str | None, Column] | None = None) -> Column:
    """``keys``: the key set by token account mode; None is the transaction's own. An empty filter matches all."""
    keys = keys or {None: F.col("keys")}
    parts = []
    if f.vote is not None:
        parts.append(F.col("is_vote") == f.vote)
    if f.failed is not None:
        parts.append(F.col("failed") == f.failed)
    if f.signature is not None:
        parts.append(F.col("signature") == F.lit(f.signature))
    if f.token_accounts not in keys:
        raise ValueError(f"no owners for the token account mode {f.token_accounts}")
    parts += _key_parts(f, keys[f.token_accounts])
    return F.coalesce(reduce(and_, parts), F.lit(False)) if parts else F.lit(True)


def match(
    transactions: DataFrame, filters: Mapping[str, TransactionFilter], keys: Mapping[str | None, Column] | None = None
) -> DataFrame:
    """``transactions`` (signature, is_vote, failed, keys...) with the names of the filters that match.

    ``keys`` are those of ``key_sets`` unless given.
    """
    keys = keys or key_sets(transactions)
    if not filters:
        return transactions.withColumn("filters", F.array().cast("array<string>")).where(F.lit(False))
    return transactions.withColumn("filters", named({n: predicate(f, keys) for n, f in filters.items()})).where(F.size("filters") > 0)


def match_deshred(transactions: DataFrame, filters: Mapping[str, DeshredFilter]) -> DataFrame:
    """Before execution there is neither failure nor balances: vote flag and keys only."""
    conditions = {}
    for name, f in filters.items():
        parts = [F.col("is_vote") == f.vote] if f.vote is not None else []
        parts += _key_parts(f, F.col("keys"))
        conditions[name] = F.coalesce(reduce(and_, parts), F.lit(False)) if parts else F.lit(True)
    if not conditions:
        return transactions.withColumn("filters", F.array().cast("array<string>")).where(F.lit(False))
    return transactions.withColumn("filters", named(conditions)).where(F.size("filters") > 0)


def status(transactions: DataFrame) -> DataFrame:
    """The status update of a transaction: which one, and whether it failed."""
    own = [c for c in ("filters", "slot", "signature", "is_vote", "idx", "err", "failed") if c in transactions.columns]
    return transactions.select(*own)


def _valid(balances: DataFrame) -> DataFrame:
    """Balances with a readable owner; of several for an index, the last position counts."""
    good = balances.where(F.col("owner").isNotNull() & (F.col("owner") != ""))
    order = F.col("pos") if "pos" in balances.columns else F.lit(0)
    last = F.max_by(F.struct("owner", F.coalesce("amount", F.lit("")).alias("amount")), order)
    return good.groupBy("signature", "account_index").agg(last.alias("b")).select("signature", "account_index", "b.*")


def owners_all(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(signature, owner): every owner of a balance before or after."""
    both = pre.select("signature", "owner").union(post.select("signature", "owner"))
    return both.where(F.col("owner").isNotNull() & (F.col("owner") != "")).distinct()


def owners_changed(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(signature, owner) of balances whose amount text changed, that appeared, or that went (then the owner before)."""
    a, b = _valid(pre).alias("a"), _valid(post).alias("b")
    joined = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.account_index") == F.col("b.account_index")), "full")
    changed = F.col("a.signature").isNull() | F.col("b.signature").isNull() | (F.col("a.amount") != F.col("b.amount"))
    owner = F.when(F.col("b.signature").isNull(), F.col("a.owner")).otherwise(F.col("b.owner"))
    return joined.where(changed).select(F.coalesce("a.signature", "b.signature").alias("signature"), owner.alias("owner")).distinct()


def with_owners(transactions: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """``transactions`` with an array of the token owners found for them; one transaction has a bounded number."""
    sets = owners.groupBy("signature").agg(F.array_sort(F.collect_set("owner")).alias(name))
    joined = transactions.join(sets, "signature", "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))

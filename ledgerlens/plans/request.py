"""Requests: sets of named filters by kind, their limits and their checks. All of this is driver-side and small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions import base58
from ledgerlens.functions.cuckoo import ALGORITHM, FINGERPRINT_BITS, SLOTS, Cuckoo, KeySet
from ledgerlens.schema import COMMITMENTS

# Limits of a request's parts.
MAX_STATE_FILTERS, MAX_MEMCMP_BYTES, MAX_BASE58_TEXT, MAX_BASE64_TEXT, MAX_NAME_BYTES = 4, 128, 175, 172, 128
RESERVED_NAME = "__autoreconnect"
TOKEN_ACCOUNT_MODES = ("ALL", "BALANCE_CHANGED")


class RequestError(ValueError):
    pass


@dataclass(frozen=True)
class DataSize:
    size: int


@dataclass(frozen=True)
class Memcmp:
    offset: int
    data: bytes

    @classmethod
    def of_text(cls, offset: int, text: str, encoding: str) -> Memcmp:
        """``encoding``: base58 or base64."""
        import base64

        most = {"base58": MAX_BASE58_TEXT, "base64": MAX_BASE64_TEXT}.get(encoding)
        if most is None or len(text) > most:
            raise RequestError("memcmp data cannot be read")
        try:
            return cls(offset, base58.decode(text) if encoding == "base58" else base64.b64decode(text, validate=True))
        except ValueError as e:
            raise RequestError("memcmp data cannot be read") from e


@dataclass(frozen=True)
class TokenAccountState:
    wanted: bool = True


@dataclass(frozen=True)
class Lamports:
    compare: str  # eq, ne, lt or gt
    value: int


StateFilter = DataSize | Memcmp | TokenAccountState | Lamports


@dataclass(frozen=True)
class AccountFilter:
    account: Sequence[Any] = ()
    owner: Sequence[Any] = ()
    state: Sequence[StateFilter] = ()
    nonempty_txn_signature: bool | None = None
    cuckoo: Cuckoo | KeySet | None = None


@dataclass(frozen=True)
class TransactionFilter:
    vote: bool | None = None
    failed: bool | None = None
    signature: Any = None
    account_include: Sequence[Any] = ()
    account_exclude: Sequence[Any] = ()
    account_required: Sequence[Any] = ()
    token_accounts: str | None = None
    cuckoo_account_include: Cuckoo | KeySet | None = None


@dataclass(frozen=True)
class DeshredFilter:
    vote: bool | None = None
    account_include: Sequence[Any] = ()
    account_exclude: Sequence[Any] = ()
    account_required: Sequence[Any] = ()


@dataclass(frozen=True)
class SlotFilter:
    filter_by_commitment: bool = False
    interslot_updates: bool = False


@dataclass(frozen=True)
class BlockFilter:
    account_include: Sequence[Any] = ()
    include_transactions: bool = True
    include_accounts: bool = False
    include_entries: bool = False
    cuckoo_account_include: Cuckoo | KeySet | None = None


@dataclass(frozen=True)
class EmptyFilter:
    """Entries and block metas: every row matches."""


@dataclass(frozen=True)
class Request:
    accounts: Mapping[str, AccountFilter] = field(default_factory=dict)
    slots: Mapping[str, SlotFilter] = field(default_factory=dict)
    transactions: Mapping[str, TransactionFilter] = field(default_factory=dict)
    transactions_status: Mapping[str, TransactionFilter] = field(default_factory=dict)
    entries: Mapping[str, EmptyFilter] = field(default_factory=dict)
    blocks: Mapping[str, BlockFilter] = field(default_factory=dict)
    blocks_meta: Mapping[str, EmptyFilter] = field(default_factory=dict)
    deshred_transactions: Mapping[str, DeshredFilter] = field(default_factory=dict)
    commitment: str | int | None = None
    data_slices: Sequence[tuple[int, int]] = ()
    from_slot: int | None = None
    ping: int | None = None

    def kinds(self) -> dict[str, Mapping]:
        return {f.name: v for f in fields(self) if isinstance(v := getattr(self, f.name), Mapping)}

    @property
    def level(self) -> str:
        """Absent is processed; numbers count the levels."""
        c = 0 if self.commitment is None else self.commitment
        if c in COMMITMENTS:
            return c
        if isinstance(c, int) and 0 <= c < len(COMMITMENTS):
            return COMMITMENTS[c]
        raise RequestError(f"{self.commitment!r} is not a commitment level")

    @property
    def replaces_filters(self) -> bool:
        """A ping is answered; it doesn't replace the filters in force."""
        return self.ping is None


@dataclass(frozen=True)
class KindLimits:
    max: int | None = None
    any: bool = True
    pubkey_max: int | None = None
    account_reject: frozenset = frozenset()
    owner_max: int | None = None
    owner_reject: frozenset = frozenset()
    include_transactions: bool = True
    include_accounts: bool = True
    include_entries: bool = True
    data_slice_max: int | None = None


@dataclass(frozen=True)
class Limits:
    """By kind; a kind that isn't named is unlimited. ``entries_as_accounts`` takes the permission for accounts for
    entries as well, as some servers do."""

    by_kind: Mapping[str, KindLimits] = field(default_factory=dict)
    name_bytes: int = MAX_NAME_BYTES
    entries_as_accounts: bool = False

    def of(self, kind: str) -> KindLimits:
        return self.by_kind.get(kind, KindLimits())


def read_int(value: int | str) -> int:
    """A number of a configuration: an integer, or digits with underscores."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise RequestError(f"not a number: {value!r}")
    return value if isinstance(value, int) else int(value.replace("_", ""))


def _at_most(what: str, n: int, most: int | None) -> None:
    if most is not None and n > most:
        raise RequestError(f"{n} {what}: more than the limit of {most}")


def _check_keys(keys: Sequence, most: int | None, reject: frozenset, what: str) -> None:
    _at_most(what, len(set(keys)), most)
    for key in set(keys) & set(reject):
        raise RequestError(f"the key {key!r} is on the list of keys that may not be asked for")


def check_state(state: Sequence[StateFilter]) -> None:
    _at_most("filters", len(state), MAX_STATE_FILTERS)
    if sum(isinstance(s, DataSize) for s in state) > 1:
        raise RequestError("a filter can ask for one data size only")
    for s in state:
        if isinstance(s, Memcmp) and len(s.data) > MAX_MEMCMP_BYTES:
            raise RequestError(f"memcmp takes at most {MAX_MEMCMP_BYTES} bytes")
        if isinstance(s, TokenAccountState) and not s.wanted:
            raise RequestError("the token account state can be asked for, but not excluded")
        if isinstance(s, Lamports) and s.compare not in ("eq", "ne", "lt", "gt"):
            raise RequestError("lamports are compared by eq, ne, lt or gt")
        if not isinstance(s, StateFilter):
            raise RequestError("an empty state filter")


def check_slices(slices: Sequence[tuple[int, int]], most: int | None = None) -> None:
    _at_most("data slices", len(slices), most)
    end = 0
    for i, (offset, length) in enumerate(slices):
        if i and offset < slices[i - 1][0]:
            raise RequestError("slices have to be sorted by offset")
        if i and offset < end:
            raise RequestError("slices may not share bytes")
        end = max(end, offset + length)


def check_sketch(wire: Mapping) -> None:
    """A sketch as a client gives it."""
    n = wire.get("bucket_count", 0)
    if wire.get("hash_algorithm") != ALGORITHM:
        raise RequestError("cuckoo: unknown hash algorithm")
    if wire.get("entries_per_bucket") != SLOTS or wire.get("fingerprint_bits") != FINGERPRINT_BITS:
        raise RequestError("cuckoo: entries per bucket or fingerprint bits are not supported")
    if n < 1 or n & (n - 1) or len(wire.get("data", b"")) != n * SLOTS * FINGERPRINT_BITS // 8:
        raise RequestError("cuckoo: bucket count is not a power of two or doesn't fit the data")


def is_open(kind: str, f: Any) -> bool:
    """Whether a filter asks for a full stream."""
    if kind == "accounts":
        return not (f.account or f.owner or f.cuckoo)
    if kind in ("transactions", "transactions_status"):
        return f.vote is None and f.failed is None and f.token_accounts is None and not (
            f.account_include or f.cuckoo_account_include or f.account_exclude or f.account_required)
    if kind == "deshred_transactions":
        return f.vote is None and not (f.account_include or f.account_exclude or f.account_required)
    return not f.account_include if kind == "blocks" else True


def check(request: Request, limits: Limits | None = None) -> Request:
    """The request, or RequestError for the first thing that is not allowed."""
    limits = limits or Limits()
    request.level  # noqa: B018
    check_slices(request.data_slices, limits.of("accounts").data_slice_max)
    for kind, filters in request.kinds().items():
        own = limits.of(kind)
        _at_most("filters", len(filters), own.max)
        for name, f in filters.items():
            if len(name.encode()) > limits.name_bytes:
                raise RequestError(f"the name of a filter has {len(name.encode())} bytes, {limits.name_bytes} are allowed")
            if name == RESERVED_NAME:
                raise RequestError(f"clients keep the name {name} for themselves")
            if not own.any and is_open(kind, f):
                raise RequestError(f"{kind}: a filter without any condition is not permitted here")
            if kind == "accounts":
                _check_keys(f.account, own.pubkey_max, own.account_reject, "pubkeys")
                _check_keys(f.owner, own.owner_max, own.owner_reject, "owners")
                check_state(f.state)
            elif hasattr(f, "account_include"):
                _check_keys(f.account_include, own.pubkey_max, own.account_reject, "pubkeys")
                for keys in (getattr(f, "account_exclude", ()), getattr(f, "account_required", ())):
                    _check_keys(keys, own.pubkey_max, frozenset(), "pubkeys")
            if getattr(f, "token_accounts", None) not in (None, *TOKEN_ACCOUNT_MODES):
                raise RequestError(f"token_accounts is one of {TOKEN_ACCOUNT_MODES}")
            if kind == "blocks":
                entries = own.include_accounts if limits.entries_as_accounts else own.include_entries
                able = {"transactions": own.include_transactions, "accounts": own.include_accounts, "entries": entries}
                for part, allowed in able.items():
                    if getattr(f, f"include_{part}") and not allowed:
                        raise RequestError(f"{part} of blocks are not available here")
    return request


def complexity(spark: SparkSession, request: Request) -> DataFrame:
    """One row a filter: kind, name, and how many keys and state filters it has."""
    rows = []
    for kind, filters in request.kinds().items():
        for name, f in filters.items():
            keys = sum(len(set(getattr(f, k, ()))) for k in ("account", "owner", "account_include", "account_exclude", "account_required"))
            rows.append((kind, name, keys, len(getattr(f, "state", ()))))
    return spark.createDataFrame(rows, "kind string, name string, n_keys long, n_state long")

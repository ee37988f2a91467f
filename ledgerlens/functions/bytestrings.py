"""Predicates and projections on BINARY columns. A null column never matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def memcmp(data: Column, offset: int, wanted: bytes) -> Column:
    """The bytes from ``offset`` are ``wanted``; false where data ends before that."""
    part = F.substring(data, offset + 1, len(wanted)) == F.lit(wanted)
    return F.coalesce((F.octet_length(data) >= offset + len(wanted)) & part, F.lit(False))


def data_size(data: Column, size: int) -> Column:
    return F.coalesce(F.octet_length(data) == size, F.lit(False))


def token_account_state(data: Column) -> Column:
    """A token account: 165 bytes whose state, byte 108, is initialised (1) or frozen (2); longer accounts with
    extensions have the account type 2 in byte 165 and aren't of the size of a multisig (355)."""
    byte = lambda i: F.substring(data, i + 1, 1)
    size = F.octet_length(data)
    live = byte(108).isin(b"\x01", b"\x02")
    long_form = (size > 165) & (size != 355) & (byte(165) == F.lit(b"\x02"))
    return F.coalesce(live & ((size == 165) | long_form), F.lit(False))


def data_slices(data: Column, slices: Sequence[tuple[int, int]]) -> Column:
    """The (offset, length) slices one after the other; a slice that isn't wholly inside gives nothing. None: all data."""
    if not slices:
        return data
    empty = F.lit(b"")
    parts = [F.when(F.octet_length(data) >= o + n, F.substring(data, o + 1, n)).otherwise(empty) for o, n in slices]
    return F.when(data.isNotNull(), F.concat(*parts))

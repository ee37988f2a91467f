"""Base58 text: decoded on the driver for requests, by Arrow batch for columns, keys of 32 bytes all at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import BinaryType, StringType

# Fixed value: the alphabet of base58.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_VALUE = {c: i for i, c in enumerate(ALPHABET)}
# Bytes of a key, least and most characters of its text.
KEY, SHORTEST, LONGEST = 32, 32, 44
#: Keys are words of 16 bits, texts are digits in groups of five, so that sums of their products are exact in doubles.
WORD, GROUP, GROUPS = 1 << 16, 5, 9
DIGITS = GROUP * GROUPS


def _places(number: int, base: int, n: int) -> list[int]:
    return [number // base ** (n - 1 - i) % base for i in range(n)]


_FROM_WORDS = np.array([_places(WORD ** (KEY // 2 - 1 - i), 58**GROUP, GROUPS) for i in range(KEY // 2)], float)
#: One word more than a key has, for texts of numbers that are too large.
_FROM_GROUPS = np.array([_places(58 ** (GROUP * (GROUPS - 1 - i)), WORD, KEY // 2 + 1) for i in range(GROUPS)], float)
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_NONE = 255
_DIGIT = np.full(256, _NONE, np.uint8)
_DIGIT[_LETTERS] = np.arange(58)


def decode(text: str) -> bytes:
    number = 0
    for c in text:
        if c not in _VALUE:
            raise ValueError(f"not base58: {c!r}")
        number = number * 58 + _VALUE[c]
    zeros = len(text) - len(text.lstrip("1"))
    return b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")


def encode(data: bytes) -> str:
    number, out = int.from_bytes(data, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        out = ALPHABET[digit] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def decode_key(text: str, size: int = 32) -> bytes:
    data = decode(text)
    if len(data) != size:
        raise ValueError(f"{size} bytes are wanted, {text!r} has {len(data)}")
    return data


def _carried(sums: np.ndarray, base: int) -> np.ndarray:
    """Rows of places, the highest first, each brought below the base."""
    places = np.ascontiguousarray(sums.T).astype(np.int64)
    for i in range(len(places) - 1, 0, -1):
        places[i - 1] += places[i] // base
        places[i] %= base
    return places


def _leading_zeros(rows: np.ndarray) -> np.ndarray:
    filled = rows != 0
    return np.where(filled.any(1), filled.argmax(1), rows.shape[1])


def encode_keys(keys: np.ndarray) -> pa.Array:
    """Texts of keys, one a row of 32 bytes."""
    groups = _carried(keys.view(">u2").astype(float) @ _FROM_WORDS, 58**GROUP)
    digits = np.empty((len(keys), DIGITS), np.uint8)
    for i in range(DIGITS - 1, -1, -1):
        group = groups[i // GROUP]
        digits[:, i] = group % 58
        group //= 58
    starts = _leading_zeros(digits) - _leading_zeros(keys)
    ends = np.concatenate(([0], np.cumsum(DIGITS - starts))).astype(np.int32)
    letters = _LETTERS[digits][np.arange(DIGITS) >= starts[:, None]]
    return pa.Array.from_buffers(pa.string(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(letters)])


def decode_keys(texts: pa.Array) -> pa.Array:
    """Keys of texts; null for null or text that isn't one of a key, as ``decode_key`` has it."""
    sizes = pc.binary_length(texts)
    able = pc.fill_null(pc.and_(pc.greater_equal(sizes, SHORTEST), pc.less_equal(sizes, LONGEST)), False).to_numpy(zero_copy_only=False)
    own = texts.filter(pa.array(able)).cast(pa.string())
    out = pa.nulls(len(texts), pa.binary())
    if not len(own):
        return out
    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    at = ends[1:, None] - DIGITS + np.arange(DIGITS)
    before = at < ends[:-1, None]
    digits = _DIGIT[np.frombuffer(own.buffers()[2], np.uint8)[np.where(before, 0, at)]]
    digits[before] = 0
    groups = digits.reshape(-1, GROUPS, GROUP).astype(float) @ 58.0 ** np.arange(GROUP - 1, -1, -1)
    words = _carried(groups @ _FROM_GROUPS, WORD)
    keys = np.ascontiguousarray(words[1:].T.astype(">u2")).view(np.uint8)
    ones = _leading_zeros(digits) - (DIGITS - np.diff(ends))
    good = (digits != _NONE).all(1) & (words[0] == 0) & (ones == _leading_zeros(keys))
    able[able] = good
    found = pa.Array.from_buffers(pa.binary(KEY), int(good.sum()), [None, pa.py_buffer(keys[good])])
    return pc.replace_with_mask(out, pa.array(able), found.cast(pa.binary()))


@arrow_udf(StringType())
def base58(column: pa.Array) -> pa.Array:
    """BINARY -> base58 text; null stays null."""
    is_key = pc.fill_null(pc.equal(pc.binary_length(column), KEY), False)
    keys = column.filter(is_key)
    made = encode_keys(np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, KEY))
    out = pc.replace_with_mask(pa.nulls(len(column), pa.string()), is_key, made)
    if len(keys) + column.null_count < len(column):
        others = pc.and_(column.is_valid(), pc.invert(is_key))
        out = pc.replace_with_mask(out, others, pa.array([encode(b) for b in column.filter(others).to_pylist()], pa.string()))
    return out


@pandas_udf(BinaryType())
def unbase58(column: pd.Series) -> pd.Series:
    """Base58 text -> BINARY; null for null or text that isn't base58."""

    def one(text):
        try:
            return None if text is None else decode(text)
        except ValueError:
            return None

    return column.map(one)

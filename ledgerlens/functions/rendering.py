"""Updates as text: bytes in the usual encodings, and one JSON line an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.base58 import base58

ENCODINGS = ("base58", "base64", "hex")


def encode(data: Column, encoding: str) -> Column:
    """BINARY -> text; null stays null. Only base58 leaves the JVM."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}, expected one of {ENCODINGS}")
    return {"base58": base58, "base64": F.base64, "hex": lambda c: F.lower(F.hex(c))}[encoding](data)


def json_lines(updates: DataFrame, kind: str) -> DataFrame:
    """(value): a JSON object an update, its kind first; binary columns are base64, nulls are left out."""
    return updates.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *updates.columns)).alias("value"))

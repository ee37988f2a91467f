"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark texts.

Normal form: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters, one space between
words. Every window of ``window`` consecutive item words is a pattern; an item with fewer words, but not none,
is one pattern as a whole. Each text is scanned once; the places found are mapped back to code point offsets of
the original text. Documents are never shuffled.

The benchmark goes into one automaton as long as its patterns have at most ``block_chars`` characters, which
bounds what is broadcast. A larger one is cut into blocks of that size, scanned one after the other; results are the
same for any size of block, spans are made from the hit words of all blocks.

Null or empty texts have no words and no hits. Null item texts, or items without words, give no pattern. Item ids are
taken as text, whatever their type; items without an id are one item, whose id is null (last). Repeated documents
give repeated rows; repeated item rows count once. Columns of the results have ``prefix`` before their names, so that
no name of ``keep`` need clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, map_texts, materialize

WINDOW = 10
BLOCK_CHARS = 8_000_000

_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        ),
    ]
)


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def item_patterns(text: bytes | None, window: int = WINDOW) -> set[bytes]:
    """Windows of an item, with a space before and after every word."""
    words = normal_words(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def build_automaton(patterns: dict[bytes, list[str | None]]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        automaton.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, items))
    automaton.make_automaton()
    return automaton


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as [start, end) code points of the original text."""
    bounds = np.array([m.span() for m in _WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
    return [{"start": int(chars[bounds[a, 0]]), "end": int(chars[bounds[b - 1, 1]])} for a, b in edges]


def scan_text(text: bytes | None, automaton: ahocorasick.Automaton | None) -> tuple[int, list[int], list[int], list]:
    words = normal_words(text)
    if not words or automaton is None:
        return len(words), [], [], []
    normal = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(normal.decode("latin-1")))
    if not found:
        return len(words), [], [], []
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, last - np.array([n for _, (n, _) in found]), 1)
    np.add.at(edge, last, -1)
    hit = np.cumsum(edge)[:-1] > 0
    return (
        len(words),
        np.flatnonzero(hit).tolist(),
        sorted({i for _, (_, own) in found for i in own}, key=lambda i: (i is None, i or "")),
        original_spans(text, hit),
    )


def _scan_block(docs: DataFrame, patterns: dict[bytes, list[str | None]], keep: Sequence[str], prefix: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    built: dict = {}

    def fn(texts):
        if not built:
            built["automaton"] = build_automaton(shared.value)
        rows = [scan_text(t, built["automaton"]) for t in texts]
        return list(zip(*rows, strict=True)) if rows else [[] for _ in FOUND]

    out = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in FOUND])
    return map_texts(docs, "text", fn, out, keep)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    prefix: str = "",
) -> DataFrame:
    """Columns ``keep`` of ``docs``, with n_words, hit_words (word numbers), item_ids (ascending) and spans.

    ``prefix`` goes before these names.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text") * window)).first()[0] or 0
    n_blocks = int(size // block_chars) + 1
    found = None
    for block in range(n_blocks):
        patterns: dict[bytes, list[str | None]] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect():
            for p in item_patterns(row["text"].encode(), window):
                patterns.setdefault(p, []).append(row["item_id"])
        if n_blocks == 1:
            return _scan_block(docs, patterns, keep, prefix)
        if found is None:
            none = [(F.lit(None) if t.name == "n_words" else F.array()).cast(t.dataType).alias(f"{prefix}_{t.name}") for t in FOUND]
            found = docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys([*keep, "text"])], *none)
        carried = found.columns
        seen = _scan_block(found, patterns, carried, f"{prefix}_new_")
        merged = {f"{prefix}_{c}": F.array_sort(F.array_union(f"{prefix}_{c}", f"{prefix}_new_{c}")) for c in ("hit_words", "item_ids")}
        found = materialize(seen.withColumns(merged | {f"{prefix}_n_words": F.col(f"{prefix}_new_n_words")}).select(carried), "scan")
    done = [F.col(f"{prefix}_{t.name}").alias(prefix + t.name) for t in FOUND if t.name != "spans"]
    return _with_spans(found.select("*", *done), prefix).select(*keep, *[prefix + t.name for t in FOUND])


def _with_spans(found: DataFrame, prefix: str) -> DataFrame:
    """``found`` (text, hit_words) with the spans of all hit words."""
    field = T.StructField(prefix + "spans", FOUND["spans"].dataType)
    schema = T.StructType([*found.schema.fields, field])
    kind = to_arrow_type(field.dataType)

    def spans(text: bytes | None, own: list[int]) -> list[dict]:
        if not own:
            return []
        hit = np.zeros(own[-1] + 1, bool)
        hit[own] = True
        return original_spans(text, hit)

    def run(batches):
        for batch in batches:
            made = [spans(t, h) for t, h in zip(as_bytes(batch["text"]), batch[prefix + "hit_words"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=schema.names)

    return found.mapInArrow(run, schema)

"""License scans, with DataFrame operations only.

Texts and templates are lower-cased; words are runs of letters, digits and non-ASCII characters; a shingle is five
words (a text of fewer words: all of them). A template of m distinct shingles is sought in text windows of w shingles, w
the smallest power of two of at least 2 m, that start every w / 2 shingles, so one of them holds any whole copy. As
w < 4 m, a window that holds the share c of a template has a Jaccard similarity to it of at least c / (5 - c).
It retrieves the template if one of ``BANDS`` = 64 MinHash bands of one row is equal: at c = 0.8 (similarity 0.19) with
a probability of at least 1 - 0.81^64 = 0.999998. A match is then verified exactly: at least 0.8 of the template's
distinct shingles are in the window. Windows with fewer shingles of templates than 0.8 of their smallest template
cannot match and are not hashed.

Everything happens within the row, so nothing is shuffled. Templates are rows (license, text), by default
``license_texts.TEMPLATES``; their hashes are part of the plan, looked up in a hash set, so the cost of a text without
license passages doesn't grow with their number. The set must fit in a plan: some hundred license texts, not a corpus.

Null and empty texts have no matches. Templates without words are left out. Repeated rows give repeated results. Other
columns of the input, whatever their names, are read only if ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .license_texts import NOTICES, TEMPLATES

__all__ = ["BANDS", "CONTAINMENT", "NOTICES", "SHINGLE", "TEMPLATES", "read_templates", "scan", "window_size"]

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8


def shingle_hashes(text: Column) -> Column:
    """Hashes of the shingles of a text, in order."""
    words = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(
            F.size(h) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)])),
        )
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def min_hashes(shingles: Column) -> Column:
    """One minimum for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))


def window_size(n: int) -> int:
    w = 2
    while w < 2 * n:
        w *= 2
    return w


def read_templates(spark: SparkSession, templates: DataFrame | Sequence[tuple[str, str]]) -> list[dict]:
    """Licenses with distinct shingles and their band values, as the text side computes them."""
    if isinstance(templates, DataFrame):
        templates = [(r.license, r.text) for r in templates.select("license", "text").collect()]
    own = spark.createDataFrame(sorted({(name, text or "") for name, text in templates}), "license string, text string").coalesce(1)
    own = own.select("license", F.array_distinct(shingle_hashes(F.col("text"))).alias("shingles"))
    own = own.select("license", "shingles", min_hashes(F.col("shingles")).alias("bands"))
    return [{"id": i, **r.asDict()} for i, r in enumerate(r for r in own.collect() if r.shingles)]


def _longs(values) -> str:
    """SQL of bigint literals; the smallest bigint can't be written as one."""
    return ", ".join(f"{v}L" if v > -(1 << 63) else "shiftleft(1L, 63)" for v in values)


def _matches_of_size(hashes: Column, marked: Column, hits: Column, w: int, templates: list[dict]) -> Column:
    """Verified windows of ``w`` shingles: array<struct<template, start, size>>.

    ``hits`` are the places of shingles that any template has; ``marked`` has these shingles, null in other places.
    """
    rows = ", ".join(f"struct({t['id']} AS id, array({_longs(t['shingles'])}) AS shingles, array({_longs(t['bands'])}) AS bands)" for t in templates)
    listed = F.expr(f"array({rows})")
    step = w // 2
    least = CONTAINMENT * min(len(t["shingles"]) for t in templates)

    def meets(bands, part):
        return lambda t: (
            F.arrays_overlap(t["bands"], bands)  # the band's number is part of its hash
            & (F.size(F.array_intersect(t["shingles"], part)) >= F.lit(CONTAINMENT) * F.size(t["shingles"]))
        )

    def in_window(start):
        as_match = lambda part: lambda t: F.struct(t["id"].alias("template"), start.alias("start"), F.size(part).alias("size"))
        verified = lambda part: lambda bands: F.transform(F.filter(listed, meets(bands, part)), as_match(part))
        return let(F.slice(hashes, start + 1, w), lambda part: let(min_hashes(F.array_distinct(part)), verified(part)))

    own = lambda i: F.array(*[F.greatest(F.floor(i / step) - back, F.lit(0)).cast("int") * step for back in (0, 1)])
    enough = lambda start: F.size(F.array_distinct(F.array_compact(F.slice(marked, start + 1, w)))) >= least
    starts = F.filter(F.array_distinct(F.flatten(F.transform(hits, own))), enough)
    return F.flatten(F.transform(starts, in_window))


def _find(known: list[dict]) -> Column:
    """Verified windows in the column ``_hashes``: array<struct<template, start, size>>."""
    hashes = F.col("_hashes")
    all_known = sorted({h for t in known for h in t["shingles"]})
    sizes = sorted({window_size(len(t["shingles"])) for t in known})
    by_size = {w: [t for t in known if window_size(len(t["shingles"])) == w] for w in sizes}
    none = F.array().cast("array<struct<template:int,start:int,size:int>>")
    marks = F.expr(f"transform(_hashes, h -> CASE WHEN h IN ({_longs(all_known)}) THEN h END)")
    places = lambda marked: F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: F.get(marked, i).isNotNull())
    search = lambda marked: lambda hits: F.concat(*[_matches_of_size(hashes, marked, hits, w, own) for w, own in by_size.items()])
    return let(marks, lambda marked: let(places(marked), lambda hits: F.when(F.size(hits) > 0, search(marked)(hits)).otherwise(none)))


def scan(docs: DataFrame, templates: DataFrame | Sequence[tuple[str, str]] = TEMPLATES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with licenses (names, ascending) and matches (license, start and size in shingles).

    ``templates`` are pairs, or a table with the columns license and text.
    """
    known = read_templates(docs.sparkSession, templates)
    kept = [docs[f"`{c}`"].alias(f"_keep_{i}") for i, c in enumerate(keep)]
    # generators of one row a row: what they make is computed once, however often it is used after
    hashed = docs.select(*kept, F.inline(F.array(F.struct(shingle_hashes(F.coalesce(docs["text"], F.lit(""))).alias("_hashes")))))
    matches = _find(known) if known else F.array().cast("array<struct<template:int,start:int,size:int>>")
    names = F.array(*[F.lit(t["license"]) for t in known]) if known else F.array().cast("array<string>")
    named = F.transform(matches, lambda m: F.struct(F.get(names, m["template"]).alias("license"), m["start"].alias("start"), m["size"].alias("size")))
    licenses = lambda m: F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"])))
    found = let(named, lambda m: F.struct(m.alias("matches"), licenses(m).alias("licenses")))
    return hashed.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], F.inline(F.array(found)))

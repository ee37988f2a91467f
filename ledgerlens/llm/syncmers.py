"""Document fingerprints from closed syncmers, with DataFrame operations only.

A text is its words between ASCII white space; letters of scripts that are written without spaces between words
(``UNSPACED``) are words of their own. A k-mer is ``K`` = 3 consecutive words, its inner substrings are
single words, ordered by hash. A k-mer is an anchor (a closed syncmer) if its minimal word is its first or its
last: that depends on the k-mer alone, so equal passages give equal anchors wherever they stand. A text of
fewer words is one anchor as a whole; null and empty texts have none.

The fingerprint is the smallest distinct anchor hashes (32 bits each, as hex): ``SKETCH`` of them, or an ``EVERY``-th of
all where that is more, so it grows with the text; a text of fewer anchors has them all. Likeness estimates the Jaccard
similarity of two texts' anchors from the smallest hashes of their union, as many as both sides know; two texts without
anchors are alike (1), one without is unlike any other (0).

Null texts are empty. Ids may be of any type that has an order. Rows with a null doc_id come first; rows that share an id
follow each other by a hash of their text, equal rows one after the other. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, ordered_index

K = 3
SKETCH, EVERY = 64, 4
# Scripts that are written without spaces between words, as Unicode names them.
UNSPACED = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


def word_hashes(text: Column) -> Column:
    space = r"[\x20\x09-\x0D]+"
    letters = F.split(text, rf"{space}|(?<=[{UNSPACED}])|(?=[{UNSPACED}])")
    words = F.array_remove(F.when(F.rlike(text, F.lit(f"[{UNSPACED}]")), letters).otherwise(F.split(text, space)), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _kmer_hash(h: Column, i: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), 32)


def _is_anchor(h: Column, i: Column) -> Column:
    inner = [F.get(h, i + j) for j in range(1, K - 1)]
    return F.least(F.get(h, i), F.get(h, i + K - 1)) <= (F.least(*inner) if len(inner) > 1 else inner[0])


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: word positions and hashes of the anchors, for positional matching."""
    return let(
        word_hashes(F.coalesce(text, F.lit(""))),
        lambda h: F.when(
            F.size(h) >= K,
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: _is_anchor(h, i)),
                lambda i: F.struct(i.alias("pos"), _kmer_hash(h, i).alias("hash")),
            ),
        )
        .when(F.size(h) > 0, F.array(F.struct(F.lit(0).alias("pos"), F.shiftrightunsigned(F.xxhash64(h), 32).alias("hash"))))
        .otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>")),
    )


def sketch(text: Column) -> Column:
    """The smallest distinct anchor hashes, ascending; fewer than ``SKETCH`` are all that the text has."""
    hashes = let(
        word_hashes(F.coalesce(text, F.lit(""))),
        lambda h: F.when(
            F.size(h) >= K,
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: _is_anchor(h, i)), lambda i: _kmer_hash(h, i)
            ),
        )
        .when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 32)))
        .otherwise(F.array().cast("array<bigint>")),
    )
    return let(F.sort_array(F.array_distinct(hashes)), lambda h: F.slice(h, 1, F.greatest(F.lit(SKETCH), F.floor(F.size(h) / EVERY).cast("int"))))


def as_string(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    known = lambda x: F.when(F.size(x) < SKETCH, F.lit((1 << 31) - 1)).otherwise(F.size(x))
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, F.least(known(a), known(b)))
    return let(
        union,
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1))),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, text, sketch) with their number of ``copies``, n_chars, and the head and sketch of what is next.

    The order is sought on ids and hashes alone. Texts are then dealt by hash of the row, so no range of ids and no hot
    id meets in one task; of a next text only the head is sent that the edit takes. The row before the first is the last.
    """
    key = {"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64(F.lit(1), "doc_id", "text")}
    sized = docs.withColumns(key).select("_a", "_b", "doc_id", F.char_length("text").cast("long").alias("n_chars"))
    groups = sized.groupBy("_a", "_b").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    placed = ordered_index(groups, [F.asc_nulls_first("doc_id"), "_a", "_b"], "_n")
    n = placed.count()
    after = placed.select(F.pmod(F.col("_n") - 1, F.lit(max(n, 1))).alias("_n"), F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"))
    links = materialize(placed.join(after, "_n").drop("_n"), "following")

    first = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("_a"))
    texts = docs.withColumns(key).select("_a", "_b", "text", sketch(F.col("text")).alias("sketch"))
    texts = texts.withColumn("_first", first).where("_first = 1").drop("_first")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    heads = texts.select(F.col("_a").alias("_next_a"), F.col("_b").alias("_next_b"), "text", "sketch").join(links, ["_next_a", "_next_b"])
    heads = heads.select("_a", "_b", "doc_id", "n_chars", "copies", F.struct(F.substring("text", F.lit(1), half).alias("head"), "sketch").alias("next"))
    return texts.join(heads, ["_a", "_b"]).drop("_a", "_b")


def _repeat(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as ``times`` says, in two steps, so no array grows with it."""
    step = 4096
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / step))))
    left = F.least(F.lit(step).cast("long"), F.col(times) - F.col("_part") * step)
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("_part", "_copy", times)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document."""
    own = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    itself = F.struct(F.substring("text", F.lit(1), half).alias("head"), F.col("sketch"))
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("next"))  # of equal rows, all but one are followed by an equal row
    others = F.struct((F.col("copies") - 1).alias("times"), itself.alias("next"))
    both = own.withColumn("_case", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.col("_case.next.head"))
    both = both.withColumn("edited", edited).select(
        "doc_id", "n_chars", "sketch", F.col("_case.next.sketch").alias("next"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("edited")).alias("changed"), F.col("_case.times").alias("times"),
    )
    both = both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("changed")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next")).alias("near_next"),
        "times",
    )
    return _repeat(both, "times")

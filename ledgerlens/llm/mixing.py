"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Size of a document: its words between ASCII white space. Sources in code point order, null last, get the weights
5, 2, 1 in turn and share all words; a target stops at ``MAX_EPOCHS`` = 3 times its source, and the excess is
shared out again by weight until no target is above. A source gives whole epochs first (every document, as often
as its target holds the source). The words that then remain go to documents in ascending order of their
exponential key -ln(u) / w, where u comes from a hash of the id and w is the document's quality weight; the
document at the edge of the budget gives only the words still missing.

The order within a source is found in two steps, so that no task sorts a source: words are summed by key bucket,
a running sum over a source's at most ``BUCKETS`` buckets gives the words before each bucket, and documents are
sorted within their bucket only.

Document weights are a column (``weight``), for instance a classifier's score; without one they are
``quality_weight`` of the text. Null weights and those below ``LEAST_WEIGHT`` count as that.

Document weights are a column (``weight``), for instance a classifier's score; without one they are
``quality_weight`` of the text. Null weights and those below ``LEAST_WEIGHT`` count as that.

Null and empty texts have size 0 and give nothing. Null sources are a source of their own. A document without an id
takes its text for it, so that such documents don't share a bucket unless they are copies. Documents with the same id
have the same key; ties are broken by size, and rows equal in all of these are interchangeable.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ordered_index

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-1"
LEAST_WEIGHT = 0.01


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text) -> Column:
    """1 for plain prose, down to 0.5 the more of a text is mark-up symbols."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_count(text, F.lit(r"[!*#$%&|]"))
    return F.lit(1.0) - F.lit(0.5) * marks / F.greatest(F.length(text), F.lit(1))


def exponential_key(doc_id, weight, seed: str = SEED) -> Column:
    """-ln(u) / w; u in (0, 1] from the first 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with weight and target. The level of the shares is found from sums over sources."""
    ranked = ordered_index(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", w), "sources")
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / (all_weights or 1)
    while True:
        full = F.lit(max_epochs) * F.col("source_size") <= F.lit(level) * F.col("weight")
        held, open_weights = ranked.agg(
            F.sum(F.when(full, F.lit(max_epochs) * F.col("source_size")).otherwise(0)),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)),
        ).first()
        following = (total - held) / open_weights if open_weights else level
        if following <= level:
            break
        level = following
    target = F.least((F.lit(max_epochs) * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weight: Column | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, key and taken of every row of ``docs``."""
    own = quality_weight(F.col("text")) if weight is None else F.greatest(F.coalesce(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    key = exponential_key(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))), own, seed)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = sized.withColumn("bucket", F.floor(F.lit(BUCKETS) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int"))
    sized = materialize(sized, "sized")

    words = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by_source = words.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(by_source, weights, max_epochs)
    want = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.coalesce(F.floor(want / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", want - F.col("epochs") * F.col("source_size"))

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = words.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    plan = plan.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    plan = plan.withColumnsRenamed({"source": "s", "bucket": "b"})

    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", "key", taken.alias("taken"))

"""What the operators share: tables in the shared folder, and mapping over whole texts by Arrow batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlens.sources.shared import with_checkpoints


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        with_checkpoints(spark)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/ledgerlens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage is cut, and a lost executor loses nothing.

    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding."""
    return column.cast(pa.binary()).to_pylist()


def map_texts(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[bytes | None]], Sequence[Sequence]],
    out: StructType,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``fn`` over the texts of each Arrow batch; it returns one list per field of ``out``.

    The columns ``keep`` go through as they are, before those of ``out``.
    """
    keep = list(keep)
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*keep, text_col])])
    schema = StructType([source.schema[c] for c in keep] + list(out.fields))
    arrow = to_arrow_schema(schema)
    new_types = [arrow.field(len(keep) + i).type for i in range(len(out.fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(as_bytes(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(v, type=t) for v, t in zip(made, new_types, strict=True)],
                names=[f.name for f in arrow],
            )

    return source.mapInArrow(run, schema)


def let(value, body: Callable):
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    from pyspark.sql import functions as F

    return F.transform(F.array(value), body)[0]


def ordered_index(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``df`` with its row numbers (from 0) in ``order``, counted by partition: no task sees all rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(offsets, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")

"""Message tables: from files, and as views of the star schema that tests use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import KINDS


def read_kind(spark: SparkSession, path: str, kind: str, form: str = "parquet") -> DataFrame:
    """A message table with its fixed schema: parquet, orc, or JSON lines with binary columns in base64."""
    schema = KINDS[kind]
    if form != "json":
        return spark.read.schema(schema).format(form).load(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_stream(spark: SparkSession, path: str, kind: str, form: str = "parquet", files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(KINDS[kind]).option("maxFilesPerTrigger", files_a_trigger).format(form).load(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; binary columns become base64."""
    rows.write.json(path)


def backfill(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The start-up rows of a snapshot, then what follows."""
    return snapshot.where("is_startup").unionByName(tail.where("not is_startup"), allowMissingColumns=True)


class Views:
    """The star schema as message tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def account_updates(self) -> DataFrame:
        hour = F.expr("cast(timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('HOUR', ts)) as bigint)")
        return self.table("events").select(
            hour.alias("slot"), F.col("user_id").alias("pubkey"), F.col("event_type").alias("owner"),
            F.round(F.col("value") * 100).cast("long").alias("lamports"), F.encode("props", "UTF-8").alias("data"),
            F.col("event_id").alias("write_version"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("txn_signature"),
        )

    @staticmethod
    def _day(name: str):
        return F.datediff(F.col(name).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")

    def transactions(self) -> DataFrame:
        return self.table("orders").select(
            self._day("o_orderdate").alias("slot"), F.col("o_orderkey").alias("signature"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_vote"), (F.col("o_orderstatus") == "F").alias("failed"),
        )

    def transaction_keys(self) -> DataFrame:
        """(signature, keys): the keys of an order's lines, one bounded array each."""
        keys = F.array(F.concat(F.lit("P"), F.col("l_partkey")), F.concat(F.lit("S"), F.col("l_suppkey")))
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("signature"), F.explode(keys).alias("key"))
        return lines.groupBy("signature").agg(F.array_sort(F.collect_set("key")).alias("keys"))

    def transactions_with_keys(self) -> DataFrame:
        joined = self.transactions().join(self.transaction_keys(), "signature", "left")
        return joined.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))

    def _tokens(self, lines: DataFrame | None = None) -> DataFrame:
        """Balances of an order's lines, before and after; there is none after for a flag of R.

        The highest flag is taken by its place among those that matter, as numbers are aggregated without sorting.
        """
        flag = F.col("l_returnflag")
        place = F.when(flag > "R", 4).when(flag == "R", 3).when(flag > "A", 2).when(flag == "A", 1).when(flag < "A", 0)
        lines = self.table("lineitem") if lines is None else lines
        found = lines.groupBy(F.col("l_orderkey").alias("signature"), F.col("l_linenumber").alias("account_index"))
        found = found.agg(F.max("l_suppkey").alias("supplier"), F.max("l_quantity").cast("long").alias("before"), F.max(place).alias("place"))
        after = F.col("before") + F.when(F.col("place") == 1, 1).otherwise(0)
        return found.select(
            "signature", "account_index", F.concat(F.lit("S"), "supplier").alias("owner"), F.col("before").cast("string").alias("before"),
            after.cast("string").alias("after"), (F.col("place") != 3).alias("stays"),
        )

    def token_pre(self) -> DataFrame:
        return self._tokens().select("signature", "account_index", "owner", F.col("before").alias("amount"))

    def token_post(self) -> DataFrame:
        return self._tokens().where("stays").select("signature", "account_index", "owner", F.col("after").alias("amount"))

    @staticmethod
    def _key(name):
        """A key of 32 bytes for a name."""
        return F.unhex(F.sha2(name, 256))

    def raw_transactions(self) -> DataFrame:
        """Orders as transaction messages: parts are keys, suppliers own balances before and after."""
        from ledgerlens.functions.base58 import base58

        def balances(amount: str) -> Column:
            return F.struct(F.col("account_index").cast("long").alias("account_index"), "owner", F.col(amount).alias("amount"))

        def listed(one: Column, name: str) -> Column:
            every = F.sort_array(F.collect_list(one))
            return F.when(F.size(every) > 0, every).alias(name)

        lines = self.table("lineitem").repartition("l_orderkey")  # shuffled as they are, before keys and texts make them longer
        parts = lines.select(F.col("l_orderkey").alias("signature"), F.concat(F.lit("P"), F.col("l_partkey")).alias("part")).distinct()
        keys = parts.groupBy("signature").agg(F.collect_list(self._key(F.col("part"))).alias("static_keys"))
        owners = self._tokens(lines).withColumn("owner", base58(self._key(F.col("owner"))))
        pre, post = listed(balances("before"), "pre_token_balances"), listed(F.when(F.col("stays"), balances("after")), "post_token_balances")
        out = self.transactions()
        for more in (keys, owners.groupBy("signature").agg(pre, post)):
            out = out.join(more, "signature", "left")
        none = F.lit(None).cast("array<binary>")
        meta = F.struct(
            F.when(F.col("failed"), F.encode(F.lit("error"), "UTF-8")).alias("err"), "pre_token_balances", "post_token_balances",
            none.alias("loaded_writable"), none.alias("loaded_readonly"),
        )
        first = F.encode(F.col("signature").cast("string"), "UTF-8")
        return out.select("slot", F.col("signature").alias("idx"), "is_vote", F.array(first, F.encode(F.lit("second"), "UTF-8")).alias("signatures"),
                          "static_keys", meta.alias("meta"))

    def block_meta(self) -> DataFrame:
        """Heights are counted through the slots' own order; there are at most as many slots as days."""
        from pyspark.sql import Window

        slots = self.table("orders").groupBy(self._day("o_orderdate").alias("slot")).agg(F.count("*").alias("executed_transaction_count"))
        return slots.select(
            "slot", (F.col("slot") - 1).alias("parent_slot"), F.md5(F.col("slot").cast("string")).alias("blockhash"),
            (F.col("slot") * 86400).alias("block_time"), F.row_number().over(Window.orderBy("slot")).cast("long").alias("block_height"),
            "executed_transaction_count",
        )

    def entries(self) -> DataFrame:
        by = self.table("lineitem").groupBy(self._day("l_shipdate").alias("slot"), F.col("l_linenumber").cast("long").alias("idx"))
        return by.agg(F.count("*").alias("num_hashes"))

    def slot_statuses(self) -> DataFrame:
        """(slot, status), each once."""
        return self.status_events().select("slot", "status").distinct()

    def status_events(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "processed").when(F.col("o_orderstatus") == "P", "confirmed").otherwise("finalized")
        return self.table("orders").select(self._day("o_orderdate").alias("slot"), status.alias("status"), F.col("o_orderkey").alias("seq"))

    def updates(self) -> DataFrame:
        """A client's stream with repeats: errors are block metas, sign-ups statuses, everything else accounts."""
        kind = F.when(F.col("event_type") == "error", "block_meta").when(F.col("event_type") == "signup", "slot").otherwise("account")
        day = F.expr("cast(timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('DAY', ts)) as bigint)")
        status = F.element_at(F.array(F.lit("processed"), F.lit("confirmed"), F.lit("finalized")), (F.col("event_id") % 3 + 1).cast("int"))
        return self.table("events").select(
            F.col("event_id").alias("seq"), day.alias("slot"), kind.alias("kind"), F.col("user_id").alias("pubkey"),
            F.md5((F.col("user_id") % 2).cast("string")).alias("blockhash"), status.alias("status"), F.lit(None).cast("long").alias("txn_signature"),
            F.col("event_id").alias("idx"), F.col("event_id").alias("signature"),
        )

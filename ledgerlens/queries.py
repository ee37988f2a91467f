"""Named queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import rendering
from ledgerlens.functions.cuckoo import BucketSketches, KeySet, sketch_then_exact
from ledgerlens.operators import accounts, blocks, metering, replay, transactions
from ledgerlens.plans.evaluate import updates
from ledgerlens.plans.request import (
    AccountFilter, BlockFilter, DataSize, DeshredFilter, EmptyFilter, Lamports, Memcmp, Request, SlotFilter, TokenAccountState, TransactionFilter, complexity,
)
from ledgerlens.sources.tables import Views, backfill

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    "acc": "SELECT CAST(date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS BIGINT) AS slot, user_id AS pubkey, event_type AS owner, CAST(round(value*100) AS BIGINT) AS lamports, props AS data, event_id AS write_version, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS txn_signature FROM events",
    "keys_of": "SELECT l_orderkey AS signature, list(DISTINCT key) AS keys FROM (SELECT l_orderkey, concat('P', CAST(l_partkey AS VARCHAR)) AS key FROM lineitem UNION ALL SELECT l_orderkey, concat('S', CAST(l_suppkey AS VARCHAR)) FROM lineitem) q GROUP BY 1",
    "tx": "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS slot, o_orderkey AS signature, o_orderpriority = '1-URGENT' AS is_vote, o_orderstatus = 'F' AS failed FROM orders",
    "txk": "SELECT tx.*, coalesce(keys, CAST([] AS VARCHAR[])) AS keys FROM tx LEFT JOIN keys_of USING (signature)",
    "pre": "SELECT l_orderkey AS signature, l_linenumber AS account_index, concat('S', CAST(max(l_suppkey) AS VARCHAR)) AS owner, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "post": "SELECT l_orderkey AS signature, l_linenumber AS account_index, concat('S', CAST(max(l_suppkey) AS VARCHAR)) AS owner, CAST(CAST(max(l_quantity) AS BIGINT) + CASE WHEN max(l_returnflag)='A' THEN 1 ELSE 0 END AS VARCHAR) AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING max(l_returnflag) <> 'R'",
    "meta": "SELECT slot, slot - 1 AS parent_slot, md5(CAST(slot AS VARCHAR)) AS blockhash, slot * 86400 AS block_time, CAST(row_number() OVER (ORDER BY slot) AS BIGINT) AS block_height, n AS executed_transaction_count FROM (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS slot, count(*) AS n FROM orders GROUP BY 1) q",
    "entry": "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS slot, CAST(l_linenumber AS BIGINT) AS idx, count(*) AS num_hashes FROM lineitem GROUP BY 1, 2",
    "ev_status": "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS slot, CASE o_orderstatus WHEN 'O' THEN 'processed' WHEN 'P' THEN 'confirmed' ELSE 'finalized' END AS status, o_orderkey AS seq FROM orders",
    "st": "SELECT DISTINCT slot, status, CASE status WHEN 'processed' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END AS rank FROM ev_status",
    "changed": "SELECT DISTINCT coalesce(p.signature, q.signature) AS signature, CASE WHEN q.signature IS NULL THEN p.owner ELSE q.owner END AS owner FROM pre p FULL OUTER JOIN post q ON p.signature = q.signature AND p.account_index = q.account_index WHERE q.signature IS NULL OR p.signature IS NULL OR coalesce(p.amount, '') <> coalesce(q.amount, '')",
    "upd": "SELECT event_id AS seq, CAST(date_diff('day', TIMESTAMP '1970-01-01', date_trunc('day', ts)) AS BIGINT) AS slot, CASE event_type WHEN 'error' THEN 'block_meta' WHEN 'signup' THEN 'slot' ELSE 'account' END AS kind, user_id AS pubkey, md5(CAST(user_id % 2 AS VARCHAR)) AS blockhash, ['processed','confirmed','finalized'][event_id % 3 + 1] AS status FROM events",
}


def query(sql: str | None = None):
    def register(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = _with_views(sql)
        return fn

    return register


def _with_views(sql: str) -> str:
    import re

    def uses(text: str) -> set[str]:
        return {v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN) {v}\b", text)}

    needed, todo = set(), uses(sql)
    while todo:
        v = todo.pop()
        needed.add(v)
        todo |= uses(VIEWS[v]) - needed
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed)
    recursive = sql.removeprefix("RECURSIVE ")
    if not head:
        return sql if recursive == sql else f"WITH RECURSIVE {recursive[5:]}"
    return f"WITH {'RECURSIVE ' if recursive != sql else ''}{head}{', ' + recursive[5:] if recursive.startswith('WITH ') else ' ' + recursive}"


ACC = ("slot", "pubkey", "owner", "lamports", "write_version")
_ACC = ", ".join(ACC)


def _accounts(name: str, f: AccountFilter, where: str) -> None:
    """A query with one account filter."""

    def run(spark, sf_dir):
        return accounts.match(Views(spark, sf_dir).account_updates(), {name: f}).select(*ACC, F.array_join("filters", ",").alias("filters"))

    QUERIES[name] = run
    ORACLE_SQL[name] = _with_views(f"SELECT {_ACC}, '{name}' AS filters FROM acc WHERE {where}")


_MEMCMP = "(octet_length(encode(data)) >= 4 AND substr(data, 2, 3) = '\"k\"')"
for _n, _f, _w in (
    ("account_wildcard", AccountFilter(), "true"),
    ("account_by_pubkey", AccountFilter(account=(1, 5, 7, 7, 900000)), "pubkey IN (1, 5, 7, 900000)"),
    ("account_by_owner", AccountFilter(owner=("error", "view")), "owner IN ('error', 'view')"),
    ("account_owner_and_pubkey", AccountFilter(account=(1, 2, 3, 4), owner=("click",)), "pubkey IN (1, 2, 3, 4) AND owner = 'click'"),
    ("account_txn_signature_present", AccountFilter(nonempty_txn_signature=True), "txn_signature IS NOT NULL"),
    ("account_txn_signature_absent", AccountFilter(nonempty_txn_signature=False), "txn_signature IS NULL"),
    ("account_datasize", AccountFilter(state=(DataSize(9),)), "octet_length(encode(data)) = 9"),
    ("account_memcmp", AccountFilter(state=(Memcmp(1, b'"k"'), Memcmp(6, b"4"))), f"{_MEMCMP} AND octet_length(encode(data)) >= 7 AND substr(data, 7, 1) = '4'"),
    ("account_memcmp_past_end", AccountFilter(state=(Memcmp(8, b"}}}"),)), "false"),
    ("account_token_state", AccountFilter(state=(TokenAccountState(),)), "false"),
    ("account_lamports_eq", AccountFilter(state=(Lamports("eq", 500),)), "lamports = 500"),
    ("account_lamports_ne", AccountFilter(state=(Lamports("ne", 500),)), "lamports <> 500"),
    ("account_lamports_lt", AccountFilter(state=(Lamports("lt", 1000),)), "lamports < 1000"),
    ("account_lamports_gt", AccountFilter(state=(Lamports("gt", 1000), Lamports("lt", 2000))), "lamports > 1000 AND lamports < 2000"),
    ("account_combined", AccountFilter(owner=("error",), state=(Lamports("gt", 1000), Memcmp(1, b'"k"'), DataSize(9)), nonempty_txn_signature=True),
     f"owner = 'error' AND lamports > 1000 AND {_MEMCMP} AND octet_length(encode(data)) = 9 AND txn_signature IS NOT NULL"),
):
    _accounts(_n, _f, _w)

FEW = {
    "big": AccountFilter(state=(Lamports("gt", 5000),)),
    "errors": AccountFilter(owner=("error",), state=(Lamports("gt", 1000), Memcmp(1, b'"k"'))),
    "some": AccountFilter(account=tuple(range(0, 100, 7))),
    "unsigned_clicks": AccountFilter(owner=("click",), nonempty_txn_signature=False),
}
_FEW_SQL = """WITH latest AS (SELECT *, max(write_version) OVER (PARTITION BY slot, pubkey) AS top FROM acc), hits AS (
  SELECT *, list_filter([CASE WHEN lamports > 5000 THEN 'big' END,
    CASE WHEN owner = 'error' AND lamports > 1000 AND octet_length(encode(data)) >= 4 AND substr(data, 2, 3) = '"k"' THEN 'errors' END,
    CASE WHEN pubkey < 100 AND pubkey % 7 = 0 THEN 'some' END,
    CASE WHEN owner = 'click' AND txn_signature IS NULL THEN 'unsigned_clicks' END], lambda x: x IS NOT NULL) AS f FROM latest WHERE write_version = top)
SELECT slot, pubkey, write_version, array_to_string(f, ',') AS filters FROM hits WHERE len(f) > 0"""


@query(_FEW_SQL)
def account_multi_match(v: Views) -> DataFrame:
    """The flagship: all named filters in one scan over last versions."""
    found = accounts.match(blocks.last_versions(v.account_updates()), FEW)
    return found.select("slot", "pubkey", "write_version", F.array_join("filters", ",").alias("filters"))


MANY = {f"k{i:03d}": AccountFilter(account=tuple(range(i, i + 3))) for i in range(120)} | {"clicks": AccountFilter(owner=("click",), account=tuple(range(50))), "rich": AccountFilter(owner=("view",), state=(Lamports("gt", 9000),))}


@query("""WITH f AS (SELECT concat('k', lpad(CAST(i AS VARCHAR), 3, '0')) AS name, i FROM range(120) t(i)), hits AS (
  SELECT pubkey, write_version, name FROM acc JOIN f ON pubkey BETWEEN i AND i + 2
  UNION ALL SELECT pubkey, write_version, 'clicks' FROM acc WHERE owner = 'click' AND pubkey < 50
  UNION ALL SELECT pubkey, write_version, 'rich' FROM acc WHERE owner = 'view' AND lamports > 9000)
SELECT pubkey, write_version, string_agg(name, ',' ORDER BY name) AS filters FROM hits GROUP BY 1, 2""")
def account_many_filters(v: Views) -> DataFrame:
    """More filters than a projection should hold: keys are joined."""
    return accounts.match(v.account_updates(), MANY).select("pubkey", "write_version", F.array_join("filters", ",").alias("filters"))


@query("SELECT write_version, CASE WHEN octet_length(encode(data)) >= 9 THEN concat(substr(data, 1, 3), substr(data, 7, 3)) WHEN octet_length(encode(data)) >= 3 THEN substr(data, 1, 3) ELSE '' END AS data FROM acc")
def account_data_slice(v: Views) -> DataFrame:
    sliced = accounts.slice_data(v.account_updates(), [(0, 3), (6, 3), (100, 4)])
    return sliced.select("write_version", F.decode("data", "UTF-8").alias("data"))


@query("""SELECT write_version, CASE WHEN write_version < 500 THEN 'few' ELSE 'clicks' END AS filters FROM acc
WHERE write_version >= 10 AND write_version < 500 AND pubkey IN (1, 2, 3) OR write_version >= 500 AND write_version < 2000 AND owner = 'click'""")
def filter_replacement(v: Views) -> DataFrame:
    """Requests that replace each other; the last one asks for nothing."""
    asked = [(500, {"clicks": AccountFilter(owner=("click",))}), (10, {"few": AccountFilter(account=(1, 2, 3))}), (2000, {})]
    return accounts.match_in_force(v.account_updates(), asked).select("write_version", F.array_join("filters", ",").alias("filters"))


@query("SELECT write_version, base64(encode(data)) AS b64, lower(hex(encode(data))) AS hx FROM acc")
def account_data_encoded(v: Views) -> DataFrame:
    return v.account_updates().select("write_version", rendering.encode(F.col("data"), "base64").alias("b64"), rendering.encode(F.col("data"), "hex").alias("hx"))


@query("""SELECT concat('{"kind":"slot","slot":', CAST(slot AS VARCHAR), ',"status":"', status, '"}') AS value FROM st""")
def updates_as_json(v: Views) -> DataFrame:
    return rendering.json_lines(v.slot_statuses(), "slot")


@query("SELECT slot, pubkey, owner, write_version FROM acc WHERE owner NOT IN ('view', 'signup')")
def account_drop_list(v: Views) -> DataFrame:
    return accounts.drop_owners(v.account_updates(), ["view", "signup"]).select("slot", "pubkey", "owner", "write_version")


@query("SELECT slot, pubkey, write_version, write_version < 2000 AS is_startup FROM acc")
def account_backfill_then_tail(v: Views) -> DataFrame:
    rows = v.account_updates().withColumn("is_startup", F.col("write_version") < 2000)
    return backfill(rows, rows).select("slot", "pubkey", "write_version", "is_startup")


@query("SELECT slot, pubkey, write_version FROM acc WHERE pubkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def sketch_then_exact_keys(v: Views) -> DataFrame:
    """Sketches of all wanted keys, then the exact check."""
    wanted = v.table("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"))
    rows = v.account_updates().withColumn("_bytes", F.encode(F.col("pubkey").cast("string"), "UTF-8"))
    exact = wanted.select(F.encode(F.col("key").cast("string"), "UTF-8").alias("key"))
    found = sketch_then_exact(rows, "_bytes", BucketSketches.of(exact, "key", seed=7), exact, "key")
    return found.select("slot", "pubkey", "write_version")


_TXCOLS = ("slot", "signature", "is_vote", "failed")


def _transactions(name: str, f: TransactionFilter, where: str, source: str = "txk") -> None:
    def run(spark, sf_dir):
        v = Views(spark, sf_dir)
        rows = v.transactions_with_keys() if source == "txk" else v.transactions().withColumn("keys", F.array().cast("array<string>"))
        return transactions.match(rows, {name: f}).select(*_TXCOLS)

    QUERIES[name] = run
    ORACLE_SQL[name] = _with_views(f"SELECT slot, signature, is_vote, failed FROM {source} WHERE {where}")


for _n, _t, _w, _s in (
    ("tx_vote", TransactionFilter(vote=True), "is_vote", "tx"),
    ("tx_failed", TransactionFilter(failed=False, vote=False), "NOT failed AND NOT is_vote", "tx"),
    ("tx_signature", TransactionFilter(signature=7), "signature = 7", "tx"),
    ("tx_include", TransactionFilter(account_include=("P1", "P2", "S3")), "list_has_any(keys, ['P1', 'P2', 'S3'])", "txk"),
    ("tx_exclude", TransactionFilter(account_exclude=tuple(f"S{i}" for i in range(40))), "NOT list_has_any(keys, list_transform(range(40), lambda i: concat('S', CAST(i AS VARCHAR))))", "txk"),
    ("tx_required", TransactionFilter(account_required=("S1", "S2")), "list_has_all(keys, ['S1', 'S2'])", "txk"),
    ("tx_include_exclude_required", TransactionFilter(vote=False, account_include=("S5", "S6", "S7"), account_exclude=("S8", "S9"), account_required=("S5",)),
     "NOT is_vote AND list_has_any(keys, ['S5', 'S6', 'S7']) AND NOT list_has_any(keys, ['S8', 'S9']) AND list_has_all(keys, ['S5'])", "txk"),
):
    _transactions(_n, _t, _w, _s)


def _owner_match(v: Views, owners: DataFrame, mode: str) -> DataFrame:
    rows = transactions.with_owners(v.transactions(), owners, "owners")
    f = TransactionFilter(account_include=("S1", "S2", "S3"), account_exclude=("S4",), token_accounts=mode)
    return transactions.match(rows, {"f": f}, {mode: F.col("owners")}).select("signature", F.array_join("owners", ",").alias("owners"))


@query("WITH o AS (SELECT signature, owner FROM pre UNION SELECT signature, owner FROM post), g AS (SELECT signature, list(owner ORDER BY owner) AS owners FROM o GROUP BY 1) SELECT signature, array_to_string(owners, ',') AS owners FROM g WHERE list_has_any(owners, ['S1', 'S2', 'S3']) AND NOT list_has_any(owners, ['S4'])")
def tx_token_owner_all(v: Views) -> DataFrame:
    return _owner_match(v, transactions.owners_all(v.token_pre(), v.token_post()), "ALL")


@query("WITH g AS (SELECT signature, list(owner ORDER BY owner) AS owners FROM changed GROUP BY 1) SELECT signature, array_to_string(owners, ',') AS owners FROM g WHERE list_has_any(owners, ['S1', 'S2', 'S3']) AND NOT list_has_any(owners, ['S4'])")
def tx_token_owner_match_changed(v: Views) -> DataFrame:
    return _owner_match(v, transactions.owners_changed(v.token_pre(), v.token_post()), "BALANCE_CHANGED")


def _key_of(name: str) -> bytes:
    """The key of a name, as ``Views.raw_transactions`` has it."""
    return hashlib.sha256(name.encode()).digest()


_RAW = """WITH k AS (SELECT signature, list_filter(keys, lambda x: x[1] = 'P') AS parts FROM keys_of), a AS (SELECT signature, list(DISTINCT owner) AS owners FROM (SELECT signature, owner FROM pre UNION ALL SELECT signature, owner FROM post) q GROUP BY 1),
  c AS (SELECT signature, list(DISTINCT owner) AS owners FROM changed GROUP BY 1), r AS (SELECT tx.*, coalesce(parts, CAST([] AS VARCHAR[])) AS parts, coalesce(a.owners, CAST([] AS VARCHAR[])) AS owners_all, coalesce(c.owners, CAST([] AS VARCHAR[])) AS owners_changed
  FROM tx LEFT JOIN k USING (signature) LEFT JOIN a USING (signature) LEFT JOIN c USING (signature)) """


@query(_RAW + "SELECT signature, slot, failed, is_vote, len(parts) AS n_keys, len(owners_all) AS n_owners, len(owners_changed) AS n_changed FROM r")
def tx_from_raw(v: Views) -> DataFrame:
    found = transactions.from_raw(v.raw_transactions())
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("keys", "n_keys"), ("owners_all", "n_owners"), ("owners_changed", "n_changed"))]
    return found.select(F.decode("signature", "UTF-8").cast("long").alias("signature"), "slot", "failed", "is_vote", *sizes)


@query(_RAW + """, h AS (SELECT signature, list_filter([
  CASE WHEN list_has_any(list_concat(parts, owners_all), ['P1', 'P2', 'S1', 'S2']) AND NOT list_has_any(list_concat(parts, owners_all), ['S3', 'P4']) THEN 'a_all' END,
  CASE WHEN list_has_any(list_concat(parts, owners_changed), ['P1', 'P2', 'S1', 'S2']) AND NOT list_has_any(list_concat(parts, owners_changed), ['S3', 'P4']) THEN 'b_changed' END,
  CASE WHEN list_has_any(parts, ['P1', 'P2', 'S1', 'S2']) AND NOT list_has_any(parts, ['S3', 'P4']) THEN 'c_keys' END,
  CASE WHEN list_has_all(list_concat(parts, owners_all), ['P5', 'S5']) THEN 'd_both' END], lambda x: x IS NOT NULL) AS f FROM r)
SELECT signature, array_to_string(f, ',') AS filters FROM h WHERE len(f) > 0""")
def tx_token_owner_keys_and_owners(v: Views) -> DataFrame:
    """Include, exclude and required on the keys together with the owners of each mode."""
    some = {"account_include": [_key_of(k) for k in ("P1", "P2", "S1", "S2")], "account_exclude": [_key_of(k) for k in ("S3", "P4")]}
    filters = {
        "a_all": TransactionFilter(token_accounts="ALL", **some), "b_changed": TransactionFilter(token_accounts="BALANCE_CHANGED", **some),
        "c_keys": TransactionFilter(**some), "d_both": TransactionFilter(token_accounts="ALL", account_required=[_key_of("P5"), _key_of("S5")]),
    }
    found = transactions.match(transactions.from_raw(v.raw_transactions()), filters)
    return found.select(F.decode("signature", "UTF-8").cast("long").alias("signature"), F.array_join("filters", ",").alias("filters"))


def _key_set(*keys: str) -> KeySet:
    """A sketch with its keys, so that what it lets pass is checked."""
    return KeySet(max(8, len(keys)), 7, {k.encode() for k in keys})


@query("SELECT slot, pubkey, write_version FROM acc WHERE pubkey % 3 = 0 OR pubkey % 3 = 1")
def account_token_state_of_padded(v: Views) -> DataFrame:
    """Data made as token accounts: initialised (first third), frozen in the longer form (second), without a state (not one)."""
    kind = F.col("pubkey") % 3
    state = F.when(kind == 0, F.unhex(F.lit("01"))).when(kind == 1, F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("00")))
    end = F.when(kind == 1, F.unhex(F.lit("0200"))).otherwise(F.lit(b""))
    data = F.concat(F.encode(F.rpad(F.decode("data", "UTF-8"), 108, "x"), "UTF-8"), state, F.encode(F.repeat(F.lit("x"), 56), "UTF-8"), end)
    found = accounts.match(v.account_updates().withColumn("data", data), {"f": AccountFilter(state=(TokenAccountState(),))})
    return found.select("slot", "pubkey", "write_version")


@query("SELECT slot, pubkey, write_version FROM acc WHERE octet_length(encode(data)) >= 9 AND substr(data, octet_length(encode(data)), 1) = '}' AND octet_length(encode(data)) = 9")
def account_memcmp_at_end(v: Views) -> DataFrame:
    """A comparison that ends with the data: shorter data doesn't reach it, longer data has another byte there."""
    found = accounts.match(v.account_updates(), {"f": AccountFilter(state=(Memcmp(8, b"}"),))})
    return found.select("slot", "pubkey", "write_version")


@query("SELECT slot, signature, is_vote, failed FROM txk WHERE NOT is_vote AND list_has_any(keys, ['P1', 'P2', 'S3', 'S40'])")
def tx_cuckoo_include(v: Views) -> DataFrame:
    """Keys of a sketch, then the exact check, beside listed ones."""
    f = TransactionFilter(vote=False, account_include=("S40",), cuckoo_account_include=_key_set("P1", "P2", "S3"))
    return transactions.match(v.transactions_with_keys(), {"f": f}).select(*_TXCOLS)


@query("SELECT slot, pubkey, write_version FROM acc WHERE pubkey IN (1, 5, 9, 40) AND owner IN ('click', 'error')")
def account_cuckoo(v: Views) -> DataFrame:
    """Keys of a sketch, then the exact check, beside listed ones."""
    rows = v.account_updates().withColumn("pubkey", F.col("pubkey").cast("string"))
    found = accounts.match(rows, {"f": AccountFilter(account=("40",), owner=("click", "error"), cuckoo=_key_set("1", "5", "9"))})
    return found.select("slot", F.col("pubkey").cast("long").alias("pubkey"), "write_version")


@query("""SELECT m.slot, coalesce(t.n, 0) AS n_transactions, coalesce(e.n, 0) AS n_entries FROM meta m
LEFT JOIN (SELECT slot, count(*) AS n FROM txk WHERE list_has_any(keys, ['P1', 'P2', 'S3', 'S40']) GROUP BY 1) t USING (slot) LEFT JOIN (SELECT slot, count(*) AS n FROM entry GROUP BY 1) e USING (slot)""")
def block_cuckoo(v: Views) -> DataFrame:
    """Children by the keys of a sketch and the exact check; every block stays."""
    f = BlockFilter(account_include=("S40",), include_entries=True, cuckoo_account_include=_key_set("P1", "P2", "S3"))
    no_accounts = v.account_updates().where(F.lit(False))
    found = blocks.match_blocks(v.block_meta(), v.transactions_with_keys(), no_accounts, v.entries(), {"f": f})
    return found.select("slot", "n_transactions", "n_entries")


@query("""WITH up AS (SELECT DISTINCT slot FROM st WHERE rank >= 1),
t AS (SELECT * FROM txk WHERE slot IN (SELECT slot FROM up)), m AS (SELECT * FROM meta WHERE slot IN (SELECT slot FROM up))
SELECT 'accounts' AS kind, slot, CAST(pubkey AS VARCHAR) AS key, CASE WHEN owner = 'error' AND lamports > 9000 THEN 'few,rich' WHEN lamports > 9000 THEN 'rich' ELSE 'few' END AS filters
  FROM acc WHERE slot IN (SELECT slot FROM up) AND lamports > 9000
UNION ALL SELECT 'slots', slot, status, 'own' FROM st WHERE status = 'confirmed'
UNION ALL SELECT 'transactions', slot, CAST(signature AS VARCHAR), 'some' FROM t WHERE list_has_any(keys, ['P1', 'S2'])
UNION ALL SELECT 'transactions_status', slot, CAST(signature AS VARCHAR), CASE WHEN is_vote AND list_has_any(keys, ['P1', 'S2']) THEN 'some,votes' WHEN is_vote THEN 'votes' ELSE 'some' END FROM t WHERE is_vote OR list_has_any(keys, ['P1', 'S2'])
UNION ALL SELECT 'entries', slot, CAST(idx AS VARCHAR), 'e' FROM entry WHERE slot IN (SELECT slot FROM up)
UNION ALL SELECT 'blocks', slot, blockhash, 'b' FROM m UNION ALL SELECT 'blocks_meta', slot, blockhash, 'm1,m2' FROM m
UNION ALL SELECT 'deshred_transactions', slot, CAST(signature AS VARCHAR), 'early' FROM txk WHERE is_vote AND list_has_any(keys, ['S7', 'S8'])""")
def request_all_kinds(v: Views) -> DataFrame:
    """One request for messages of all kinds, at commitment level confirmed."""
    some = TransactionFilter(account_include=("P1", "S2"))
    rich = Lamports("gt", 9000)
    asked = Request(
        accounts={"rich": AccountFilter(state=(rich,)), "few": AccountFilter(owner=("error",), state=(rich,))},
        slots={"own": SlotFilter(filter_by_commitment=True)}, transactions={"some": some},
        transactions_status={"votes": TransactionFilter(vote=True), "some": some}, entries={"e": EmptyFilter()}, blocks={"b": BlockFilter()},
        blocks_meta={"m2": EmptyFilter(), "m1": EmptyFilter()}, deshred_transactions={"early": DeshredFilter(vote=True, account_include=("S7", "S8"))},
        commitment="confirmed", data_slices=[(0, 2)],
    )
    tables = {"accounts": v.account_updates(), "slots": v.slot_statuses(), "transactions": v.transactions_with_keys(),
              "entries": v.entries(), "block_meta": v.block_meta(), "deshred": v.transactions_with_keys()}
    return updates(asked, tables)


@query("SELECT signature, owner FROM changed")
def tx_token_owner_balance_changed(v: Views) -> DataFrame:
    return transactions.owners_changed(v.token_pre(), v.token_post())


@query("SELECT slot, signature, is_vote, failed, 'failed_votes' AS filters FROM tx WHERE is_vote AND failed")
def tx_status_projection(v: Views) -> DataFrame:
    rows = v.transactions().withColumn("keys", F.array().cast("array<string>"))
    found = transactions.match(rows, {"failed_votes": TransactionFilter(vote=True, failed=True)})
    return transactions.status(found).withColumn("filters", F.array_join("filters", ","))


@query("""WITH h AS (SELECT signature, list_filter([CASE WHEN NOT failed AND NOT list_has_any(keys, ['S1', 'S2']) THEN 'a_clean' END, CASE WHEN list_has_any(keys, ['P3', 'S4', 'S5']) THEN 'b_some' END,
  CASE WHEN is_vote THEN 'c_votes' END], lambda x: x IS NOT NULL) AS f FROM txk) SELECT signature, array_to_string(f, ',') AS filters FROM h WHERE len(f) > 0""")
def tx_multi_match(v: Views) -> DataFrame:
    filters = {"a_clean": TransactionFilter(failed=False, account_exclude=("S1", "S2")), "b_some": TransactionFilter(account_include=("P3", "S4", "S5")), "c_votes": TransactionFilter(vote=True)}
    return transactions.match(v.transactions_with_keys(), filters).select("signature", F.array_join("filters", ",").alias("filters"))


@query("SELECT signature, 'all,no_votes' AS filters FROM txk WHERE NOT is_vote AND list_has_any(keys, ['S10', 'S11']) UNION ALL SELECT signature, 'all' FROM txk WHERE is_vote AND list_has_any(keys, ['S10', 'S11'])")
def deshred_filter(v: Views) -> DataFrame:
    filters = {"all": DeshredFilter(account_include=("S10", "S11")), "no_votes": DeshredFilter(vote=False, account_include=("S10", "S11"))}
    return transactions.match_deshred(v.transactions_with_keys(), filters).select("signature", F.array_join("filters", ",").alias("filters"))


_MIXED = "(SELECT slot, status FROM st UNION ALL SELECT slot, ['first_shread_received', 'completed', 'created_bank', 'dead'][slot % 4 + 1] FROM meta)"


def _all_statuses(v: Views) -> DataFrame:
    life = F.element_at(F.array(*[F.lit(s) for s in ("first_shread_received", "completed", "created_bank", "dead")]), (F.col("slot") % 4 + 1).cast("int"))
    return v.slot_statuses().unionByName(v.block_meta().select("slot", life.alias("status")))


@query(f"SELECT slot, status FROM {_MIXED} q WHERE status IN ('processed', 'confirmed', 'finalized')")
def slot_commitment_only(v: Views) -> DataFrame:
    return blocks.match_slots(_all_statuses(v), {"s": SlotFilter()}, "processed").select("slot", "status")


@query(f"SELECT slot, status FROM {_MIXED} q")
def slot_interslot(v: Views) -> DataFrame:
    return blocks.match_slots(_all_statuses(v), {"s": SlotFilter(interslot_updates=True)}, "processed").select("slot", "status")


@query(f"SELECT slot, status FROM {_MIXED} q WHERE status = 'confirmed'")
def slot_filter_by_commitment(v: Views) -> DataFrame:
    return blocks.match_slots(_all_statuses(v), {"s": SlotFilter(filter_by_commitment=True)}, "confirmed").select("slot", "status")


@query(f"SELECT slot, status, 'all' AS filters FROM {_MIXED} q")
def deshred_slots(v: Views) -> DataFrame:
    """The stream before execution has no commitment: filters by commitment never match there."""
    filters = {"all": SlotFilter(interslot_updates=True), "own": SlotFilter(filter_by_commitment=True, interslot_updates=True)}
    return blocks.match_slots(_all_statuses(v), filters, None).select("slot", "status", F.array_join("filters", ",").alias("filters"))


@query(f"SELECT slot, status, channel FROM {_MIXED} q CROSS JOIN (VALUES ('processed'), ('confirmed'), ('finalized')) c(channel) WHERE status NOT IN ('processed', 'confirmed', 'finalized') OR slot IN (SELECT slot FROM meta WHERE executed_transaction_count > 5)")
def slot_routing(v: Views) -> DataFrame:
    sealed = v.block_meta().where("executed_transaction_count > 5")
    return blocks.route(_all_statuses(v), sealed).select("slot", "status", "channel")


@query("SELECT slot, idx, num_hashes, 'a,b' AS filters FROM entry")
def entry_all(v: Views) -> DataFrame:
    return blocks.match_all(v.entries(), ["b", "a"]).withColumn("filters", F.array_join("filters", ","))


@query("SELECT slot, parent_slot, blockhash, block_time, block_height, executed_transaction_count, 'm' AS filters FROM meta")
def block_meta_all(v: Views) -> DataFrame:
    return blocks.match_all(v.block_meta(), ["m"]).withColumn("filters", F.array_join("filters", ","))


def _day_accounts(v: Views) -> DataFrame:
    return v.account_updates().withColumn("slot", F.floor(F.col("slot") / 24).cast("long") - 10000)


_DAY_ACC = "SELECT slot // 24 - 10000 AS slot, pubkey, write_version FROM acc"
_LAST = f"SELECT * FROM (SELECT *, max(write_version) OVER (PARTITION BY slot, pubkey) AS top FROM ({_DAY_ACC}) d) e WHERE write_version = top"


@query(f"""WITH last AS ({_LAST}), n AS (SELECT slot, count(*) AS c, count(*) FILTER (WHERE pubkey IN (1, 2, 3)) AS own FROM last GROUP BY slot),
t AS (SELECT slot, count(*) AS c, count(*) FILTER (WHERE list_has_any(keys, ['S1', 'S2'])) AS own FROM txk GROUP BY slot), e AS (SELECT slot, count(*) AS c FROM entry GROUP BY slot)
SELECT m.slot, blockhash, 'a_accounts' AS filters, coalesce(n.c, 0) AS updated_account_count, CAST(0 AS BIGINT) AS n_transactions, coalesce(n.own, 0) AS n_accounts, coalesce(e.c, 0) AS n_entries
FROM meta m LEFT JOIN n USING (slot) LEFT JOIN e USING (slot)
UNION ALL SELECT m.slot, blockhash, 'b_default', coalesce(n.c, 0), coalesce(t.own, 0), 0, 0 FROM meta m LEFT JOIN n USING (slot) LEFT JOIN t USING (slot)""")
def block_children_filtered(v: Views) -> DataFrame:
    """One row a block and filter: children are filtered, the block stays."""
    own = BlockFilter(account_include=(1, 2, 3), include_transactions=False, include_accounts=True, include_entries=True)
    filters = {"a_accounts": own, "b_default": BlockFilter(account_include=("S1", "S2"))}
    found = blocks.match_blocks(v.block_meta(), v.transactions_with_keys(), _day_accounts(v), v.entries(), filters)
    return found.select("slot", "blockhash", F.array_join("filters", ",").alias("filters"), "updated_account_count", "n_transactions", "n_accounts", "n_entries")


@query(f"WITH last AS ({_LAST}) SELECT slot, pubkey, write_version FROM last")
def block_dedup_last_version(v: Views) -> DataFrame:
    return blocks.last_versions(_day_accounts(v)).select("slot", "pubkey", "write_version")


_SOME_TX = "SELECT * FROM tx WHERE signature % 7 <> 0 OR slot % 3 = 0"


@query(f"WITH s AS ({_SOME_TX}), c AS (SELECT slot, count(*) AS n FROM s GROUP BY slot) SELECT slot, executed_transaction_count, n AS n_transactions, n >= executed_transaction_count AS sealable, n <> executed_transaction_count AS mismatch FROM meta JOIN c USING (slot)")
def block_completeness(v: Views) -> DataFrame:
    some = v.transactions().where("signature % 7 <> 0 or slot % 3 = 0")
    found = blocks.completeness(v.block_meta(), some)
    return found.select("slot", "executed_transaction_count", "n_transactions", "sealable", "mismatch")


@query(f"WITH s AS ({_SOME_TX}), c AS (SELECT slot, count(*) AS n FROM s GROUP BY slot) SELECT count(*) FILTER (WHERE n <> executed_transaction_count) AS mismatches, count(*) AS blocks FROM meta JOIN c USING (slot)")
def block_mismatch(v: Views) -> DataFrame:
    some = v.transactions().where("signature % 7 <> 0 or slot % 3 = 0")
    return blocks.completeness(v.block_meta(), some).agg(F.count_if("mismatch").alias("mismatches"), F.count("*").alias("blocks"))


@query(f"""WITH last AS ({_LAST}), n AS (SELECT slot, count(*) AS c FROM last GROUP BY slot), t AS (SELECT slot, count(*) AS c FROM tx GROUP BY slot), e AS (SELECT slot, count(*) AS c FROM entry GROUP BY slot)
SELECT slot, block_height, coalesce(t.c, 0) AS n_transactions, coalesce(n.c, 0) AS updated_account_count, coalesce(e.c, 0) AS n_entries FROM meta LEFT JOIN n USING (slot) LEFT JOIN t USING (slot) LEFT JOIN e USING (slot)""")
def block_assembly_counts(v: Views) -> DataFrame:
    found = blocks.block_counts(v.block_meta(), v.transactions(), _day_accounts(v), v.entries())
    return found.select("slot", "block_height", "n_transactions", "updated_account_count", "n_entries")


@query("SELECT slot, CAST(r AS INTEGER) AS step, ['processed', 'confirmed', 'finalized'][r + 1] AS status FROM (SELECT slot, unnest(range(0, max(rank) + 1)) AS r FROM st GROUP BY slot) q")
def commitment_gap_fill(v: Views) -> DataFrame:
    return blocks.gap_fill(v.slot_statuses())


@query("SELECT slot, string_agg(status, ',' ORDER BY rank) AS levels, arg_max(status, rank) AS commitment FROM st GROUP BY slot")
def commitment_progression(v: Views) -> DataFrame:
    return blocks.progression(v.slot_statuses()).withColumn("levels", F.array_join("levels", ","))


@query("SELECT slot, block_height, ['processed', 'confirmed', 'finalized'][r + 1] AS status FROM (SELECT slot, unnest(range(0, max(rank) + 1)) AS r FROM st GROUP BY slot) q JOIN meta USING (slot)")
def block_at_each_level(v: Views) -> DataFrame:
    return blocks.at_each_level(v.block_meta(), v.slot_statuses()).select("slot", "block_height", "status")


@query("SELECT slot, signature FROM tx WHERE slot IN (SELECT slot FROM entry)")
def tracked_slots(v: Views) -> DataFrame:
    return blocks.tracked(v.transactions(), v.entries()).select("slot", "signature")


@query("SELECT slot, count(*) AS dropped FROM tx WHERE slot NOT IN (SELECT slot FROM entry) GROUP BY slot")
def untracked_slots(v: Views) -> DataFrame:
    return blocks.untracked(v.transactions(), v.entries())


@query("RECURSIVE WITH f AS (SELECT slot FROM meta WHERE block_height IN (40, 200, 1000)), anc AS (SELECT slot FROM f UNION SELECT m.parent_slot FROM meta m JOIN anc a ON m.slot = a.slot WHERE m.parent_slot IN (SELECT slot FROM meta)) SELECT slot FROM anc")
def ancestors_finalized(v: Views) -> DataFrame:
    meta = v.block_meta()
    return blocks.finalized_with_ancestors(meta, meta.where("block_height in (40, 200, 1000)"))


@query("SELECT slot, executed_transaction_count FROM meta WHERE slot NOT IN (SELECT slot FROM st WHERE status = 'confirmed')")
def fork_prune(v: Views) -> DataFrame:
    return blocks.prune(v.block_meta(), v.slot_statuses().where("status = 'confirmed'")).select("slot", "executed_transaction_count")


@query("WITH f AS (SELECT slot, min(seq) + 20000 AS frozen FROM ev_status GROUP BY slot) SELECT slot, seq, seq > frozen AS late FROM ev_status JOIN f USING (slot)")
def late_data(v: Views) -> DataFrame:
    events = v.status_events()
    frozen = events.groupBy("slot").agg((F.min("seq") + 20000).alias("frozen_seq"))
    return blocks.late(events, frozen).select("slot", "seq", "late")


@query("""WITH p AS (SELECT slot, max(rank) AS top FROM st GROUP BY slot), c AS (SELECT (SELECT slot FROM p ORDER BY slot DESC OFFSET 150 LIMIT 1) AS a, (SELECT slot FROM p WHERE top = 2 ORDER BY slot DESC OFFSET 10 LIMIT 1) AS b)
SELECT slot FROM p, c WHERE a IS NULL OR b IS NULL OR slot > least(a, b)""")
def replay_retention(v: Views) -> DataFrame:
    return blocks.retained(blocks.progression(v.slot_statuses()), 150).select("slot")


def _history(v: Views) -> DataFrame:
    tx = v.transactions().select("slot", F.lit(0).alias("phase"), F.col("signature").alias("seq"))
    meta = v.block_meta().select("slot", F.lit(2).alias("phase"), F.col("block_height").alias("seq"))
    block = meta.withColumn("phase", F.lit(1))
    status = v.slot_statuses().select("slot", F.lit(3).alias("phase"), blocks.rank(F.col("status")).cast("long").alias("seq"))
    return tx.unionByName(block).unionByName(meta).unionByName(status)


_HISTORY = "SELECT slot, 0 AS phase, signature AS seq FROM tx UNION ALL SELECT slot, 1, block_height FROM meta UNION ALL SELECT slot, 2, block_height FROM meta UNION ALL SELECT slot, 3, rank FROM st"
_REACHED = "SELECT slot FROM st GROUP BY slot HAVING max(rank) >= 2"


@query(f"WITH h AS ({_HISTORY}) SELECT slot, phase, seq FROM h WHERE slot >= 10000 AND slot IN ({_REACHED})")
def replay_from_slot(v: Views) -> DataFrame:
    return replay.replay(_history(v), blocks.progression(v.slot_statuses()), 10000, "finalized", check=False)


@query(f"WITH h AS ({_HISTORY}) SELECT slot, phase, seq, row_number() OVER (PARTITION BY slot ORDER BY phase, seq) AS place FROM h WHERE slot >= 10200 AND slot IN ({_REACHED})")
def replay_order(v: Views) -> DataFrame:
    """The place of every row in its slot's delivery."""
    from pyspark.sql import Window

    rows = replay.replay(_history(v), blocks.progression(v.slot_statuses()), 10200, "finalized", check=False)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("phase", "seq")).cast("long"))


@query(f"WITH h AS ({_HISTORY}) SELECT min(slot) AS first_available FROM h")
def first_available_slot(v: Views) -> DataFrame:
    return replay.first_available_slot(_history(v))


_LATEST = "SELECT arg_max(slot, seq) AS slot FROM ev_status WHERE status = 'confirmed'"


@query(_LATEST)
def latest_slot(v: Views) -> DataFrame:
    return replay.latest_slot(v.status_events(), "confirmed")


@query(f"SELECT block_height FROM meta WHERE slot = ({_LATEST})")
def block_height(v: Views) -> DataFrame:
    return replay.lookup(v.status_events(), v.block_meta(), "confirmed").select("block_height")


@query(f"SELECT slot, blockhash, block_height, block_height + 300 AS last_valid_block_height FROM meta WHERE slot = ({_LATEST})")
def latest_blockhash(v: Views) -> DataFrame:
    return replay.lookup(v.status_events(), v.block_meta(), "confirmed")


@query("SELECT blockhash, bool_or(status = 'processed') AS processed, bool_or(status = 'confirmed') AS confirmed, bool_or(status = 'finalized') AS finalized FROM st JOIN meta USING (slot) GROUP BY blockhash")
def blockhash_valid(v: Views) -> DataFrame:
    return replay.blockhash_validity(v.slot_statuses(), v.block_meta())


_KEYED = "SELECT seq, slot, kind, CASE kind WHEN 'slot' THEN concat('slot|', status) WHEN 'block_meta' THEN concat('block_meta|', blockhash) ELSE concat('account|', CAST(pubkey AS VARCHAR), '|-') END AS key FROM upd"


@query(f"WITH k AS ({_KEYED}) SELECT slot, key, min(seq) AS seq FROM k GROUP BY slot, key")
def stream_dedup_keys(v: Views) -> DataFrame:
    keyed = v.updates().withColumn("key", replay.dedup_key())
    return replay.first_of_each(keyed).select("slot", "key", "seq")


@query("""WITH s AS (SELECT *, last_value(CASE WHEN kind = 'block_meta' THEN blockhash END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN kind = 'block_meta' THEN blockhash END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM upd)
SELECT slot, seq, kind, CASE WHEN kind = 'slot' OR b IS NULL THEN 'pass' WHEN kind = 'block_meta' THEN CASE WHEN blockhash = b THEN 'discard' ELSE 'pass' END
  WHEN a IS NULL THEN 'held' WHEN a = b THEN 'discard' ELSE 'flush' END AS verdict FROM s""")
def replay_quarantine_verdict(v: Views) -> DataFrame:
    return replay.quarantine(v.updates()).select("slot", "seq", "kind", "verdict")


_RECONNECTS = (300, 5000)


@query(f"""WITH s AS (SELECT *, min(seq) OVER (PARTITION BY slot) AS f, last_value(CASE WHEN kind = 'block_meta' THEN blockhash END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN kind = 'block_meta' THEN blockhash END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM upd WHERE kind <> 'block_meta' OR seq % 4 = 0)
SELECT slot, seq, kind, CASE WHEN kind = 'slot' OR b IS NULL AND len(list_filter({list(_RECONNECTS)}, lambda r: f < r AND r < seq)) = 0 THEN 'pass'
  WHEN kind = 'block_meta' THEN CASE WHEN blockhash = b THEN 'discard' ELSE 'pass' END WHEN a IS NULL THEN 'held' WHEN a = b THEN 'discard' ELSE 'flush' END AS verdict FROM s""")
def quarantine_after_reconnect(v: Views) -> DataFrame:
    updates = v.updates().where("kind <> 'block_meta' or seq % 4 = 0")
    return replay.quarantine(updates, _RECONNECTS).select("slot", "seq", "kind", "verdict")


def _with_banks(v: Views) -> DataFrame:
    return v.updates().withColumn("status", F.when(F.col("status") == "finalized", "created_bank").otherwise(F.col("status")))


@query("""WITH k AS (SELECT seq, slot, CASE kind WHEN 'slot' THEN concat('slot|', replace(status, 'finalized', 'created_bank')) WHEN 'block_meta' THEN concat('block_meta|', blockhash)
  ELSE concat('account|', CAST(pubkey AS VARCHAR), '|-') END AS key, count(*) FILTER (WHERE kind = 'slot' AND status = 'finalized') OVER (PARTITION BY slot ORDER BY seq) AS epoch FROM upd)
SELECT slot, epoch, key, min(seq) AS seq FROM k GROUP BY slot, epoch, key""")
def dedup_after_rollback(v: Views) -> DataFrame:
    return replay.first_after_rollbacks(_with_banks(v).withColumn("key", replay.dedup_key()))


@query("SELECT slot, coalesce(max(seq) FILTER (WHERE kind = 'slot' AND status = 'finalized'), min(seq)) AS first_seen FROM upd GROUP BY slot ORDER BY first_seen DESC LIMIT 20")
def dedup_retention(v: Views) -> DataFrame:
    """A report of the slots still known: the limit is the feature."""
    return replay.remembered_slots(_with_banks(v), 20)


@query("""WITH k AS (SELECT seq, slot, CASE kind WHEN 'slot' THEN concat('slot|', replace(status, 'finalized', 'created_bank')) WHEN 'block_meta' THEN concat('block_meta|', blockhash)
  ELSE concat('account|', CAST(pubkey AS VARCHAR), '|-') END AS key, count(*) FILTER (WHERE kind = 'slot' AND status = 'finalized') OVER (PARTITION BY slot ORDER BY seq) AS epoch FROM upd),
  r AS (SELECT slot, coalesce(max(seq) FILTER (WHERE kind = 'slot' AND status = 'finalized'), min(seq)) AS first_seen FROM upd GROUP BY slot ORDER BY first_seen DESC LIMIT 20)
SELECT k.slot, epoch, key, min(seq) AS seq FROM k JOIN r ON k.slot = r.slot AND k.seq >= r.first_seen GROUP BY k.slot, epoch, key""")
def dedup_of_remembered(v: Views) -> DataFrame:
    """The memory of a client that knows 20 slots: the limit is the feature."""
    return replay.first_of_remembered(_with_banks(v).withColumn("key", replay.dedup_key()), 20)


@query("SELECT slot, blockhash FROM meta WHERE slot >= (SELECT arg_max(slot, seq) FROM ev_status WHERE status = 'finalized') - 332")
def lookup_hashes_kept(v: Views) -> DataFrame:
    slot = replay.latest_slot(v.status_events(), "finalized").first()[0]
    return replay.kept_hashes(v.block_meta(), slot).select("slot", "blockhash")


@query("SELECT arg_max(slot, seq) - 2 AS from_slot FROM upd WHERE kind = 'block_meta'")
def resume_slot(v: Views) -> DataFrame:
    return replay.resume_slot(v.updates())


@query("""WITH r AS (SELECT arg_max(slot, seq) - 2 AS back FROM upd WHERE kind = 'block_meta')
SELECT 'kept' AS server, back AS from_slot FROM r UNION ALL SELECT 'gone', CASE WHEN back >= (SELECT max(slot) FROM upd) + 1 THEN back END FROM r""")
def resume_slot_out_of_range(v: Views) -> DataFrame:
    newest = v.updates().agg(F.max("slot")).first()[0] or 0
    kept, gone = (replay.resume_slot(v.updates(), oldest) for oldest in (0, newest + 1))
    return kept.select(F.lit("kept").alias("server"), "from_slot").union(gone.select(F.lit("gone"), "from_slot"))


_LOST = "(SELECT max(seq) * 9 // 10 FROM upd)"


@query(f"""SELECT seq, slot, kind, seq <= {_LOST} AS replayed FROM upd WHERE seq > {_LOST}
  OR slot >= (SELECT arg_max(slot, seq) - 2 FROM upd WHERE kind = 'block_meta' AND seq <= {_LOST})""")
def reconnect_recovers(v: Views) -> DataFrame:
    lost = v.updates().agg(F.max("seq")).first()[0] * 9 // 10
    return replay.after_reconnect(v.updates(), lost).select("seq", "slot", "kind", "replayed")


@query(f"SELECT seq, slot, kind, false AS replayed FROM upd WHERE seq > {_LOST}")
def reconnect_skips(v: Views) -> DataFrame:
    lost = v.updates().agg(F.max("seq")).first()[0] * 9 // 10
    return replay.after_reconnect(v.updates(), lost, "skip").select("seq", "slot", "kind", "replayed")


@query("SELECT slot, pubkey, write_version, 'mine' AS filters FROM acc WHERE pubkey < 20")
def internal_filter_stripped(v: Views) -> DataFrame:
    rows = v.account_updates().withColumn("filters", F.array_compact(F.array(F.lit(replay.RESERVED_NAME), F.when(F.col("pubkey") < 20, "mine"))))
    return replay.strip_internal(rows).select("slot", "pubkey", "write_version", F.array_join("filters", ",").alias("filters"))


@query("SELECT signature, failed, block_time FROM tx JOIN meta USING (slot)")
def slot_join_blocktime(v: Views) -> DataFrame:
    return replay.with_block_time(v.transactions(), v.block_meta()).select("signature", "failed", "block_time")


@query("SELECT owner AS kind, count(*) AS n, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM acc GROUP BY ROLLUP (owner)")
def kind_stats(v: Views) -> DataFrame:
    return metering.kind_stats(v.account_updates(), F.col("owner"), F.octet_length("data"))


@query("SELECT pubkey, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM acc GROUP BY pubkey")
def bandwidth_by_subscriber(v: Views) -> DataFrame:
    return metering.usage(v.account_updates(), ["pubkey"], F.octet_length("data")).select("pubkey", "bytes")


@query("SELECT pubkey, owner, count(*) AS requests FROM acc GROUP BY pubkey, owner")
def request_count(v: Views) -> DataFrame:
    return metering.usage(v.account_updates(), ["pubkey", "owner"], F.octet_length("data")).select("pubkey", "owner", "requests")


@query("""SELECT concat('{"code":"bytes","subscription_id":', CAST(pubkey AS VARCHAR), ',"method":"', owner, '","quantity":', CAST(sum(octet_length(encode(data))) AS VARCHAR), '}') AS value FROM acc GROUP BY pubkey, owner""")
def billing_rollup(v: Views) -> DataFrame:
    totals = metering.usage(v.account_updates(), ["pubkey", "owner"], F.octet_length("data"))
    return metering.billing_lines(totals.select(F.col("pubkey").alias("subscription_id"), F.col("owner").alias("method"), F.col("bytes").alias("quantity")), "bytes")


def _calls(v: Views) -> DataFrame:
    return v.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("""RECURSIVE WITH c AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), b AS (
  SELECT key, seq, ts_us, i, 3 * 86400000000 AS have, true AS allowed, CAST(0 AS BIGINT) AS retry_us FROM c WHERE i = 1
  UNION ALL SELECT c.key, c.seq, c.ts_us, c.i, x.have, x.have >= 86400000000, CASE WHEN x.have >= 86400000000 THEN 0 ELSE (86400000000 - x.have + 2) // 3 END
  FROM b JOIN c ON c.key = b.key AND c.i = b.i + 1,
  LATERAL (SELECT least(3 * 86400000000, b.have - CASE WHEN b.allowed THEN 86400000000 ELSE 0 END + (c.ts_us - b.ts_us) * 3) AS have) x)
SELECT key, seq, ts_us, allowed, CAST(retry_us AS BIGINT) AS retry_us FROM b""")
def token_bucket_decisions(v: Views) -> DataFrame:
    """Three calls a day for each user."""
    return metering.token_bucket(_calls(v), 3, 86400)


@query("""RECURSIVE WITH c AS (SELECT pubkey AS key, write_version AS seq, octet_length(encode(data)) AS size, row_number() OVER (PARTITION BY pubkey ORDER BY write_version) AS i, count(*) OVER (PARTITION BY pubkey) AS n FROM acc), b AS (
  SELECT key, seq, i, n, CAST(size AS BIGINT) AS total FROM c WHERE i = 1
  UNION ALL SELECT c.key, c.seq, c.i, c.n, CASE WHEN b.total >= 100 THEN 0 ELSE b.total END + c.size FROM b JOIN c ON c.key = b.key AND c.i = b.i + 1)
SELECT key, seq, total AS reported FROM b WHERE total >= 100 OR i = n""")
def bandwidth_reports(v: Views) -> DataFrame:
    rows = v.account_updates().select(F.col("pubkey").alias("key"), F.col("write_version").alias("seq"), F.octet_length("data").cast("long").alias("size"))
    return metering.bandwidth_reports(rows, threshold=100)


@query("""WITH p(plan, method, max_hits) AS (VALUES ('a', 'view', 5), ('a', NULL, 50), ('b', 'click', -1))
SELECT event_id, CASE WHEN x.max_hits >= 0 THEN x.max_hits END AS max_hits FROM (SELECT e.event_id, coalesce(o.max_hits, g.max_hits, 1000) AS max_hits
FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS plan FROM events) e LEFT JOIN p o ON e.plan = o.plan AND e.event_type = o.method LEFT JOIN p g ON e.plan = g.plan AND g.method IS NULL) x""")
def method_limits(v: Views) -> DataFrame:
    plans = v.spark.createDataFrame([("a", "view", 5, 10), ("a", None, 50, 10), ("b", "click", -1, 10)], "plan string, method string, max_hits long, window_seconds long")
    plan = F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b").otherwise("c")
    calls = v.table("events").select("event_id", F.col("event_type").alias("method"), plan.alias("plan"))
    return metering.effective_limits(calls, plans).select("event_id", "max_hits")


@query("""RECURSIVE WITH p(plan, method, max_hits, win) AS (VALUES ('a', 'view', 2, 86400), ('a', NULL, 1, 172800), ('b', 'click', -1, 10)),
  e AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS plan FROM events),
  x AS (SELECT e.user_id AS key, e.event_type AS method, e.event_id AS seq, epoch_us(e.ts) AS ts_us, CAST(coalesce(o.max_hits, g.max_hits, 1000) AS BIGINT) AS m, coalesce(o.win, g.win, 10) * CAST(1000000 AS BIGINT) AS w
    FROM e LEFT JOIN p o ON e.plan = o.plan AND e.event_type = o.method LEFT JOIN p g ON e.plan = g.plan AND g.method IS NULL),
  c AS (SELECT *, row_number() OVER (PARTITION BY key, method ORDER BY ts_us, seq) AS i FROM x WHERE m >= 0), b AS (
  SELECT key, method, seq, ts_us, i, m * w AS have, true AS allowed FROM c WHERE i = 1
  UNION ALL SELECT c.key, c.method, c.seq, c.ts_us, c.i, y.have, y.have >= c.w FROM b JOIN c ON c.key = b.key AND c.method = b.method AND c.i = b.i + 1,
  LATERAL (SELECT least(c.m * c.w, b.have - CASE WHEN b.allowed THEN c.w ELSE 0 END + (c.ts_us - b.ts_us) * c.m) AS have) y)
SELECT key, method, seq, allowed FROM b UNION ALL SELECT key, method, seq, true FROM x WHERE m < 0""")
def method_limit_decisions(v: Views) -> DataFrame:
    plans = v.spark.createDataFrame([("a", "view", 2, 86400), ("a", None, 1, 172800), ("b", "click", -1, 10)], "plan string, method string, max_hits long, window_seconds long")
    plan = F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b").otherwise("c")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    calls = v.table("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("method"), F.col("event_id").alias("seq"), micros.alias("ts_us"), plan.alias("plan"))
    return metering.limited_calls(metering.effective_limits(calls, plans))


@query("""WITH s AS (SELECT user_id AS key, epoch_us(ts) AS t, 1 AS step FROM events UNION ALL SELECT user_id, epoch_us(ts) + 7200000000, -1 FROM events)
SELECT key, CAST(max(o) AS BIGINT) AS most_open, max(o) > 3 AS over FROM (SELECT key, sum(step) OVER (PARTITION BY key ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS o FROM s) q GROUP BY key""")
def connection_cap(v: Views) -> DataFrame:
    spans = _calls(v).select("key", F.col("ts_us").alias("start"), (F.col("ts_us") + 7200000000).alias("end"))
    return metering.over_cap(spans, 3)


@query("""SELECT key, seq, CAST(o AS BIGINT) AS open, o > 3 AS over FROM (SELECT user_id AS key, event_id AS seq,
  sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS o FROM events) q""")
def subscription_cap(v: Views) -> DataFrame:
    step = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return metering.subscriptions(v.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), step.alias("step")), 3).drop("step")


@query("""RECURSIVE WITH c AS (SELECT user_id AS key, event_id AS seq, event_id % 7 AS s, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS step,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), b AS (
  SELECT key, seq, i, CASE WHEN step > 0 THEN [s] ELSE CAST([] AS BIGINT[]) END AS names, true AS allowed FROM c WHERE i = 1
  UNION ALL SELECT c.key, c.seq, c.i, CASE WHEN c.step < 0 THEN list_filter(b.names, lambda x: x <> c.s) WHEN list_contains(b.names, c.s) OR len(b.names) >= 3 THEN b.names ELSE list_append(b.names, c.s) END,
  c.step < 0 OR list_contains(b.names, c.s) OR len(b.names) < 3 FROM b JOIN c ON c.key = b.key AND c.i = b.i + 1)
SELECT key, seq, len(names) AS open, allowed FROM b""")
def subscription_cap_refuses(v: Views) -> DataFrame:
    step = F.when(F.col("event_type") == "error", -1).otherwise(1)
    changes = v.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("subscription"), step.alias("step"))
    return metering.admitted(changes, 3)


@query("SELECT event_id, 'sub' || CAST(c_custkey % 10 AS VARCHAR) AS subscription_id, c_custkey IS NOT NULL AS allowed FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 <> 0")
def auth_lookup(v: Views) -> DataFrame:
    customer = v.table("customer").where("c_custkey % 3 <> 0")
    tokens = customer.select(F.col("c_custkey").alias("token"), F.concat(F.lit("sub"), F.col("c_custkey") % 10).alias("subscription_id"))
    return metering.resolve(v.table("events").select("event_id", F.col("user_id").alias("token")), tokens).drop("token")


@query("SELECT CASE WHEN n <= 8 THEN CAST(8 AS BIGINT) WHEN n <= 9 THEN 9 WHEN n <= 100 THEN 100 END AS le, count(*) AS n FROM (SELECT octet_length(encode(data)) AS n FROM acc) q GROUP BY 1")
def data_size_histogram(v: Views) -> DataFrame:
    return metering.size_histogram(v.account_updates(), F.octet_length("data"), [8, 9, 100])


@query("SELECT 'accounts' AS kind, CAST(4 AS BIGINT) AS filters, CAST(17 AS BIGINT) AS n_keys, CAST(3 AS BIGINT) AS n_state UNION ALL SELECT 'transactions', 1, 2, 0")
def filter_complexity(v: Views) -> DataFrame:
    asked = Request(accounts=FEW, transactions={"t": TransactionFilter(account_include=("a", "b", "a"))})
    found = complexity(v.spark, asked).groupBy("kind").agg(F.count("*").alias("filters"), F.sum("n_keys").alias("n_keys"), F.sum("n_state").alias("n_state"))
    return found


@query("SELECT 'blocks' AS kind, 'b' AS name, CAST(2 AS BIGINT) AS n_keys UNION ALL SELECT 'deshred_transactions', 'd', 4 UNION ALL SELECT 'entries', 'e', 0")
def filter_complexity_by_name(v: Views) -> DataFrame:
    asked = Request(blocks={"b": BlockFilter(account_include=("a", "b", "a"))}, entries={"e": EmptyFilter()},
                    deshred_transactions={"d": DeshredFilter(account_include=("a", "b"), account_exclude=("c",), account_required=("a",))})
    return complexity(v.spark, asked).select("kind", "name", "n_keys")

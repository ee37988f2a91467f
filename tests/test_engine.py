"""The filter engine: oracle rows of every query, truth table, random filters against a naive evaluator, sketches, limits, streams."""

from __future__ import annotations

import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens import queries
from ledgerlens.functions import base58, rendering
from ledgerlens.functions.bytestrings import data_slices, token_account_state
from ledgerlens.functions.cuckoo import Cuckoo, KeySet, TableFull
from ledgerlens.operators import accounts, blocks, metering, replay, transactions
from ledgerlens.plans.request import (
    EmptyFilter,
    AccountFilter, BlockFilter, DataSize, KindLimits, Lamports, Limits, Memcmp, Request, RequestError, SlotFilter, TokenAccountState, TransactionFilter, check,
    check_sketch, check_slices, read_int,
)
from ledgerlens.streaming import pipelines

SF = "/root/testdata/sf0.001"
ACCOUNTS = "slot long, pubkey long, owner long, lamports decimal(20,0), data binary, write_version long, txn_signature long"


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "customer events orders lineitem part supplier".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(queries.ORACLE_SQL[name]).df())


def account_frame(spark, rows: list[tuple], schema: str = ACCOUNTS):
    return spark.createDataFrame([(*r[:3], r[3] if r[3] is None else Decimal(r[3]), *r[4:]) for r in rows], schema)


def token_account(size: int = 165, state: int = 1) -> bytes:
    data = bytearray(size)
    data[108:109] = bytes([state])[: max(0, min(1, size - 108))]
    return bytes(data)


def random_filter(rng: random.Random) -> AccountFilter:
    state = []
    if rng.random() < 0.3:
        state.append(Lamports(rng.choice(["eq", "ne", "lt", "gt"]), rng.choice([98, 99, 100, 101, 2**64 - 1])))
    if rng.random() < 0.2:
        state.append(DataSize(rng.choice([0, 4, 107, 165, 166])))
    if rng.random() < 0.2:
        state.append(Memcmp(rng.randrange(8), b"needle"))
    if rng.random() < 0.2:
        state.append(TokenAccountState())
    keys = lambda n, p: tuple(rng.sample(range(14), rng.randrange(1, n))) if rng.random() < p else ()
    return AccountFilter(keys(6, 0.5), keys(4, 0.5), tuple(state), rng.choice([None, None, None, True, False]))


def naive(f: AccountFilter, a: tuple) -> bool:
    _, pubkey, owner, lamports, data, _, sig = a
    ok = (not f.account or pubkey in f.account) and (not f.owner or owner in f.owner)
    ok &= f.nonempty_txn_signature is None or (sig is not None) == f.nonempty_txn_signature
    for s in f.state:
        if isinstance(s, Lamports):
            ok &= {"eq": lamports == s.value, "ne": lamports != s.value, "lt": lamports < s.value, "gt": lamports > s.value}[s.compare]
        elif isinstance(s, DataSize):
            ok &= len(data) == s.size
        elif isinstance(s, Memcmp):
            ok &= data[s.offset : s.offset + len(s.data)] == s.data
        else:
            ok &= len(data) > 108 and data[108] in (1, 2) and (len(data) == 165 or 165 < len(data) != 355 and data[165] == 2)
    return ok


@pytest.mark.parametrize("n", [0, 1, 4, 63, 64, 65, 129])
def test_plans_agree_with_a_naive_evaluator(spark, n):
    rng = random.Random(n)
    sizes = [0, 4, 107, 108, 164, 165, 166, 2048]
    rows = [(100, rng.randrange(14), rng.randrange(5), rng.choice([0, 98, 99, 100, 101, 2**64 - 1]),
             (b"x" * rng.randrange(8) + b"needle" if rng.random() < 0.3 else token_account(rng.choice(sizes), rng.randrange(4))), i, rng.choice([None, i])) for i in range(150)]
    df = account_frame(spark, rows)
    filters = {f"f{i}": random_filter(rng) for i in range(n)}
    want = sorted((r[5], sorted(k for k, f in filters.items() if naive(f, r))) for r in rows if any(naive(f, r) for f in filters.values()))
    for plan in (accounts.match, accounts.match_direct, accounts.match_by_keys) if n else (accounts.match,):
        got = sorted((r.write_version, list(r.filters)) for r in plan(df, filters).select("write_version", "filters").collect())
        assert got == want


def test_null_columns_never_match(spark):
    df = account_frame(spark, [(1, None, None, None, None, 1, None)])
    some = {"a": AccountFilter(account=(1,)), "o": AccountFilter(owner=(1,)), "m": AccountFilter(state=(Memcmp(0, b""), DataSize(0))), "l": AccountFilter(state=(Lamports("ne", 5),))}
    assert accounts.match(df, some).count() == 0 and accounts.match(df, {"all": AccountFilter()}).count() == 1


def test_slices_and_token_accounts(spark):
    data = bytes(range(16))
    df = spark.createDataFrame([(data,)], "d binary")
    cases = {(): data, ((0, 4),): data[:4], ((4, 4),): data[4:8], ((0, 4), (8, 4)): data[:4] + data[8:12], ((12, 4),): data[12:], ((13, 4),): b"", ((0, 4), (100, 4)): data[:4]}
    for slices, want in cases.items():
        assert bytes(df.select(data_slices(F.col("d"), list(slices))).first()[0]) == want
    tokens = [(token_account(), True), (token_account(165, 0), False), (token_account(164), False), (token_account(166), False), (token_account(165) + b"\2xx", True), (token_account(165) + b"\2" * 190, False)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tokens)], "i int, d binary").select("i", token_account_state(F.col("d"))).collect()
    assert [r[1] for r in sorted(got)] == [w for _, w in tokens]


def test_base58(spark):
    for data in (b"", b"\0\0a", bytes(range(32)), b"\xff" * 64):
        assert base58.decode(base58.encode(data)) == data
    with pytest.raises(ValueError):
        base58.decode_key("0OIl")
    df = spark.createDataFrame([(b"\0abc",), (None,)], "b binary").select(base58.unbase58(base58.base58(F.col("b"))).alias("b"))
    assert [r.b and bytes(r.b) for r in df.collect()] == [b"\0abc", None]


# Fixed value: a sketch of the keys [b] * 32 for b in 0..46, capacity 32, seed 0x0123456789abcdef, as a client sends it.
GOLDEN = bytes([
    98, 225, 76, 119, 190, 148, 14, 101, 11, 41, 217, 3, 119, 174, 0, 0, 66, 89, 195, 68, 95, 234, 230, 233, 20, 49, 10, 177, 0, 0, 0, 0,
    219, 56, 38, 161, 53, 30, 11, 123, 215, 189, 20, 44, 123, 34, 176, 131, 12, 189, 134, 227, 205, 228, 142, 117, 68, 108, 97, 147, 203,
    29, 222, 218, 104, 255, 204, 10, 145, 239, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 41, 254, 16, 199, 37, 77, 0, 0, 170, 17, 23, 225, 34, 7, 180,
    119, 125, 61, 0, 0, 0, 0, 0, 0, 199, 228, 152, 62, 183, 114, 0, 0, 209, 244, 248, 9, 104, 65, 230, 66, 0, 0, 0, 0, 0, 0, 0, 0,
])


def test_sketch(spark):
    keys = [bytes([b]) * 32 for b in range(47)]
    made = Cuckoo.of(keys, capacity=32, seed=0x0123456789ABCDEF)
    assert made.to_wire()["data"] == GOLDEN and len(made.table) == 16 and made.contains(keys).all()
    check_sketch(made.to_wire())
    with pytest.raises(RequestError):
        check_sketch(made.to_wire() | {"bucket_count": 12})
    back = Cuckoo.from_wire(made.to_wire() | {"data": GOLDEN + b"odd"})
    assert (back.table == made.table).all() and not Cuckoo.from_wire({}).contains([b"x"]).any()
    assert made.remove(keys[3]) and not made.remove(b"\xfe" * 32)
    with pytest.raises(TableFull):
        Cuckoo.of([bytes([b, 1]) * 16 for b in range(200)], capacity=4)
    rng = random.Random(1)
    large = Cuckoo.of([rng.randbytes(32) for _ in range(3000)], seed=5)
    assert large.contains(rng.randbytes(32) for _ in range(20000)).mean() < 0.01
    own = KeySet(100)
    assert own.add(keys[0]) and not own.add(keys[0]) and keys[0] in own and own.dirty and own.sent() and not own.dirty and own.discard(keys[0]) and not own.discard(keys[0])
    df = account_frame(spark, [(0, keys[1], 0, 1, b"", 1, None), (0, b"no", 0, 1, b"", 2, None), (0, None, 0, 1, b"", 3, None)], ACCOUNTS.replace("pubkey long", "pubkey binary"))
    f = {"c": AccountFilter(account=(b"no",), cuckoo=Cuckoo.of(keys[:20]))}
    assert sorted(r.write_version for r in accounts.match(df, f).collect()) == [1, 2]


def test_token_owners(spark):
    pre = [(1, 0, "A", "5", 0), (1, 1, "B", "7", 1), (1, 2, "C", "1", 2), (1, 3, "", "1", 3), (1, 4, "E", "1", 4), (1, 4, "F", "2", 5), (2, 0, "G", None, 0)]
    post = [(1, 0, "A", "5", 0), (1, 1, "B", "8", 1), (1, 3, "D", "1", 2), (1, 4, "E", "2", 3), (2, 0, "G", "", 0), (1, 9, "N", "0", 4)]
    schema = "signature long, account_index long, owner string, amount string, pos long"
    a, b = spark.createDataFrame(pre, schema), spark.createDataFrame(post, schema)
    got = {(r.signature, r.owner) for r in transactions.owners_changed(a, b).collect()}
    assert got == {(1, "B"), (1, "C"), (1, "D"), (1, "N")}
    assert {r.owner for r in transactions.owners_all(a, b).collect()} == set("ABCDEFGN")


def test_limits():
    def refused(request, **kinds):
        with pytest.raises(RequestError):
            check(request, Limits(kinds))

    check(Request(accounts={"a": AccountFilter()}))
    shut = KindLimits(any=False, pubkey_max=2, account_reject=frozenset(["bad"]), max=1)
    refused(Request(accounts={"a": AccountFilter(state=(DataSize(1),))}), accounts=shut)
    refused(Request(accounts={"a": AccountFilter(account=("x", "y", "z"))}), accounts=shut)
    refused(Request(accounts={"a": AccountFilter(account=("bad",))}), accounts=shut)
    refused(Request(transactions={"t": TransactionFilter(signature="s")}), transactions=shut)
    check(Request(transactions={"t": TransactionFilter(account_exclude=("bad",))}), Limits({"transactions": shut}))
    refused(Request(blocks={"b": BlockFilter(include_entries=True)}), blocks=KindLimits(include_entries=False))
    refused(Request(accounts={"x" * 129: AccountFilter()}))
    refused(Request(slots={"__autoreconnect": SlotFilter()}))
    refused(Request(commitment=7))
    refused(Request(transactions={"t": TransactionFilter(token_accounts="SOME")}))
    refused(Request(accounts={"a": AccountFilter(state=(DataSize(1), DataSize(2)))}))
    refused(Request(accounts={"a": AccountFilter(state=tuple(Lamports("gt", i) for i in range(5)))}))
    refused(Request(accounts={"a": AccountFilter(state=(TokenAccountState(False),))}))
    refused(Request(accounts={"a": AccountFilter(state=(Memcmp(0, b"x" * 129),))}))
    for slices in ([(4, 2), (0, 2)], [(0, 4), (2, 2)]):
        with pytest.raises(RequestError):
            check_slices(slices)
    check_slices([(0, 4), (4, 4)])
    assert Memcmp.of_text(1, "YWJj", "base64").data == b"abc" and read_int("1_000") == 1000
    assert Request().level == "processed" and Request(commitment=2).level == "finalized" and not Request(ping=1).replaces_filters


def test_ties_of_the_last_version_stay(spark):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 5, "b"), (1, 1, 4, "c"), (2, 1, 1, "d")], "slot long, pubkey long, write_version long, x string")
    assert sorted(r.x for r in blocks.last_versions(df).collect()) == ["a", "b", "d"]
    nulls = spark.createDataFrame([(1, None, 1, "a"), (1, None, 2, "b"), (None, 7, 3, "c"), (2, 1, None, "d")], df.schema)
    assert sorted(r.x for r in blocks.last_versions(nulls).collect()) == ["b", "c"]
    assert blocks.last_versions(df.limit(0)).count() == 0


def test_reconnects_seal_slots_in_flight(spark):
    rows = [(1, 10, "account", None), (2, 10, "account", None), (4, 10, "account", None), (5, 10, "slot", None), (6, 10, "block_meta", "x"),  # seen before 3
            (7, 11, "account", None), (8, 11, "block_meta", "y"), (9, 11, "account", None),  # first seen after it
            (1, 12, "block_meta", "z"), (5, 12, "account", None), (6, 12, "block_meta", "z"), (2, 13, "account", None), (9, 13, "account", None)]
    df = spark.createDataFrame(rows, "seq long, slot long, kind string, blockhash string")
    got = {(r.slot, r.seq): r.verdict for r in replay.quarantine(df, [3]).collect()}
    want = {(10, 1): "pass", (10, 2): "pass", (10, 4): "flush", (10, 5): "pass", (10, 6): "pass", (11, 7): "pass", (11, 8): "pass", (11, 9): "held",
            (12, 1): "pass", (12, 5): "discard", (12, 6): "discard", (13, 2): "pass", (13, 9): "held"}
    assert got == want
    assert replay.quarantine(df).where("slot = 10 and verdict <> 'pass'").count() == 0


def test_banks_start_slots_anew(spark):
    rows = [(1, 5, "account", "p", "a"), (2, 5, "account", "p", "a"), (3, 5, "slot", "created_bank", "b"), (4, 5, "account", "p", "a"), (5, 6, "account", "p", None), (6, 7, "account", None, "a")]
    df = spark.createDataFrame(rows, "seq long, slot long, kind string, status string, key string")
    got = sorted((r.slot, r.epoch, r.key, r.seq) for r in replay.first_after_rollbacks(df).collect())
    assert got == [(5, 0, "a", 1), (5, 1, "a", 4), (5, 1, "b", 3), (7, 0, "a", 6)]
    assert {(r.slot, r.first_seen) for r in replay.remembered_slots(df, 2).collect()} == {(6, 5), (7, 6)}
    assert {r.first_seen for r in replay.remembered_slots(df).collect()} == {3, 5, 6}


def test_text_forms(spark):
    df = spark.createDataFrame([(1, b"\0abc"), (2, None)], "slot long, data binary")
    got = [df.orderBy("slot").select(rendering.encode(F.col("data"), e).alias("t")).collect() for e in rendering.ENCODINGS]
    assert [[r.t for r in part] for part in got] == [["1ZiCa", None], ["AGFiYw==", None], ["00616263", None]]
    assert [r.value for r in rendering.json_lines(df, "account").collect()] == ['{"kind":"account","slot":1,"data":"AGFiYw=="}', '{"kind":"account","slot":2}']
    with pytest.raises(ValueError):
        rendering.encode(F.col("data"), "base32")


def test_replay_and_validity(spark):
    history = spark.createDataFrame([(5, 0, 1), (6, 0, 1), (6, 3, 0)], "slot long, phase int, seq long")
    levels = spark.createDataFrame([(5, "confirmed"), (6, "finalized")], "slot long, commitment string")
    assert [r.slot for r in replay.replay(history, levels, 5, "confirmed").collect()] == [5, 6, 6]
    assert [r.slot for r in replay.replay(history, levels, 5, "finalized").collect()] == [6, 6]
    assert replay.replay(history, levels, 9, "processed").count() == 0
    with pytest.raises(RequestError, match="5"):
        replay.replay(history, levels, 4, "processed")
    flags = spark.createDataFrame([("h", True, False, False)], "blockhash string, processed boolean, confirmed boolean, finalized boolean")
    assert replay.is_blockhash_valid(flags, "h", "processed").first()[0] is None
    assert [replay.is_blockhash_valid(flags, h, c, least=1).first()[0] for h, c in (("h", "processed"), ("h", "finalized"), ("x", "processed"))] == [True, False, False]
    dead = spark.createDataFrame([("processed", "e"), ("processed", None), ("completed", "e")], "status string, dead_error string")
    assert [r.event for r in blocks.lifecycle(dead).collect()] == ["dead", "processed", "completed"]


def test_no_hits_always_denies(spark):
    calls = spark.createDataFrame([(1, 1, 0), (1, 2, 10)], "key long, seq long, ts_us long")
    assert {(r.allowed, r.retry_us) for r in metering.token_bucket(calls, 0, 1).collect()} == {(False, None)}


def run_stream(spark, tmp_path, rows: pd.DataFrame, schema: str, plan, pieces: int = 3) -> list:
    """Rows in a few files, one micro-batch each."""
    step = -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows.iloc[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else state that can lapse keeps the query running
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    pipelines.write(plan(stream), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_stream_matches_like_batch(spark, tmp_path):
    v = queries.Views(spark, SF).account_updates().withColumn("data", F.decode("data", "UTF-8"))
    rows = v.toPandas()
    rows["txn_signature"] = rows.txn_signature.astype("Int64").astype(object).where(rows.txn_signature.notna(), None)
    schema = v.schema.simpleString()[7:-1].replace(":", " ")
    got = run_stream(spark, tmp_path, rows, schema, lambda s: pipelines.match_accounts(s.withColumn("data", F.encode("data", "UTF-8")), queries.FEW).select("write_version", "filters"))
    want = accounts.match(queries.Views(spark, SF).account_updates(), queries.FEW).select("write_version", "filters").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_seals_slots(spark, tmp_path):
    rows = [(s, "transaction", None, None) for s in (1, 1, 2)] + [(1, "entry", None, None), (1, "block_meta", 2, 1), (2, "block_meta", 2, 0), (3, "block_meta", 0, 0), (2, "transaction", None, None), (1, "transaction", None, None)]
    df = pd.DataFrame(rows, columns=["slot", "kind", "want_tx", "want_entries"]).fillna(0).astype({"want_tx": int, "want_entries": int})
    got = run_stream(spark, tmp_path, df, "slot long, kind string, want_tx long, want_entries long", pipelines.seal_slots)
    assert sorted((r.slot, r.sealed, r.n_tx, r.n_entries, r.late) for r in got) == [(1, False, 2, 1, 1), (1, True, 2, 1, 0), (2, True, 2, 0, 0)]


def test_stream_quarantine_is_that_of_batch(spark, tmp_path):
    updates = queries.Views(spark, SF).updates().select("slot", "seq", "kind", "blockhash").orderBy("seq").toPandas()
    schema = "slot long, seq long, kind string, blockhash string"
    got = run_stream(spark, tmp_path, updates, schema, pipelines.quarantine)
    want = replay.quarantine(spark.createDataFrame(updates, schema)).where("verdict <> 'held'")
    assert sorted((r.slot, r.seq, r.verdict) for r in got) == sorted((r.slot, r.seq, r.verdict) for r in want.collect())


def test_stream_quarantine_of_lost_connections_and_banks(spark, tmp_path):
    rows = [(1, 1, "account", None), (1, 2, "reconnect", None), (1, 3, "account", None), (1, 4, "block_meta", "x"), (1, 5, "account", None),
            (1, 6, "created_bank", None), (1, 7, "account", None), (1, 8, "block_meta", "x"), (2, 9, "block_meta", "y"), (2, 10, "reconnect", None), (2, 11, "block_meta", "y")]
    updates = pd.DataFrame(rows, columns=["slot", "seq", "kind", "blockhash"])
    got = run_stream(spark, tmp_path, updates, "slot long, seq long, kind string, blockhash string", pipelines.quarantine)
    want = {1: "pass", 3: "flush", 4: "pass", 5: "discard", 6: "pass", 7: "pass", 8: "pass", 9: "pass", 11: "discard"}
    assert {r.seq: r.verdict for r in got} == want


def test_stream_state_lapses(spark, tmp_path):
    rows = pd.DataFrame([(1, s, "account" if s % 2 else "block_meta", "x") for s in range(6)], columns=["slot", "seq", "kind", "blockhash"])
    got = run_stream(spark, tmp_path, rows, "slot long, seq long, kind string, blockhash string", lambda s: pipelines.quarantine(s, keep_ms=1), pieces=3)
    metas = [r.verdict for r in sorted(got, key=lambda r: r.seq) if r.kind == "block_meta"]
    assert metas == ["pass"] * 3  # each micro-batch comes after the state of the one before has lapsed


def test_stream_buckets_of_text_keys(spark, tmp_path):
    calls = pd.DataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2), ("a", 4, 10_000_000)], columns=["key", "seq", "ts_us"])
    got = run_stream(spark, tmp_path, calls, "key string, seq long, ts_us long", lambda s: pipelines.token_bucket(s, 1, 10))
    assert {(r.key, r.seq): r.allowed for r in got} == {("a", 1): True, ("a", 2): False, ("b", 3): True, ("a", 4): True}


def test_own_filter_is_added_and_policies(spark):
    assert replay.with_internal(Request()).blocks_meta.keys() == {replay.RESERVED_NAME}
    asked = Request(blocks_meta={"mine": EmptyFilter()})
    assert replay.with_internal(asked) is asked
    none = spark.createDataFrame([(1, 5, "account"), (2, 6, "account")], "seq long, slot long, kind string")
    assert [r.seq for r in replay.after_reconnect(none, 1).collect()] == [2]
    with pytest.raises(ValueError):
        replay.after_reconnect(none, 1, "other")


def test_billing_bodies(spark):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(100)] + [(None,)], "value string").repartition(3)
    bodies = metering.billing_batches(lines, 64).collect()
    assert sorted(x for b in bodies for x in b.body.splitlines()) == sorted(f"line {i}" for i in range(100))
    assert all(len(b.body) == b.bytes < 64 + 8 and b.body.count("\n") == b.n_lines for b in bodies)
    assert sum(b.bytes < 64 for b in bodies) <= 3
    assert metering.billing_batches(lines.limit(0)).count() == 0


def test_stream_buckets_are_those_of_batch(spark, tmp_path):
    calls = queries._calls(queries.Views(spark, SF)).orderBy("ts_us", "seq").toPandas()
    got = run_stream(spark, tmp_path, calls, "key long, seq long, ts_us long", lambda s: pipelines.token_bucket(s, 3, 86400))
    want = metering.token_bucket(spark.createDataFrame(calls), 3, 86400).collect()
    assert sorted((r.seq, r.allowed) for r in got) == sorted((r.seq, r.allowed) for r in want)


def test_stream_dedup(spark, tmp_path):
    rows = pd.DataFrame({"slot": [1, 1, 1, 2], "key": ["a", "b", "a", "a"], "created_at": pd.to_datetime(["2024-01-01"] * 4)})
    got = run_stream(spark, tmp_path, rows, "slot long, key string, created_at timestamp", pipelines.first_of_each)
    assert sorted((r.slot, r.key) for r in got) == [(1, "a"), (1, "b"), (2, "a")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_sketch_holds_every_key(spark, tmp_path):
    from ledgerlens import queries

    keys = 5 * 100_400  # every fifth is wanted, more than 100 000 in all
    spark.range(5, keys + 1).selectExpr("id as c_custkey").repartition(4).write.parquet(f"{tmp_path}/customer.parquet")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = events.schema["user_id"].dataType
    events.limit(0).union(events.limit(1).crossJoin(spark.range(1, keys + 1, 7)).withColumn("user_id", F.col("id").cast(kind)).drop("id")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r.pubkey for r in queries.QUERIES["sketch_then_exact_keys"](spark, str(tmp_path)).collect())
    assert got == [k for k in range(1, keys + 1, 7) if k % 5 == 0]


def test_raw_transactions(spark):
    """First signature, loaded keys, unreadable owners, repeated balances of an index, closed and changed accounts."""
    from ledgerlens.functions import base58
    from ledgerlens.operators import transactions
    from ledgerlens.plans.request import TransactionFilter
    from ledgerlens.schema import TRANSACTIONS

    key = lambda n: bytes([n]) * 32
    one = lambda at, n, amount: {"account_index": at, "owner": base58.encode(key(n)) if isinstance(n, int) else n, "amount": amount}
    pre = [one(0, 1, "5"), one(0, 1, "7"), one(1, 2, "3"), one(2, 3, "3"), one(3, "bad", "1"), one(4, 8, None)]
    post = [one(0, 1, "7"), one(1, 2, "4"), one(3, 5, "1"), one(5, None, "1"), one(4, 8, None), one(6, "1" * 31, "2")]
    rows = [
        {"slot": 1, "idx": 0, "is_vote": False, "signatures": [b"s1", b"s2"], "static_keys": [key(20), key(21)],
         "meta": {"err": None, "pre_token_balances": pre, "post_token_balances": post, "loaded_writable": [key(22)], "loaded_readonly": [key(20)]}},
        {"slot": 1, "idx": 1, "is_vote": True, "signatures": [], "static_keys": None, "meta": {"err": b"e"}},
        {"slot": 2, "idx": 2, "is_vote": None, "signatures": None, "static_keys": [], "meta": None},
    ]
    found = {r.idx: r for r in transactions.from_raw(spark.createDataFrame(rows, TRANSACTIONS)).collect()}
    keys = lambda values: sorted(bytes(v)[0] for v in values)
    assert bytes(found[0].signature) == b"s1" and found[1].signature is None and found[2].signature is None
    assert [found[i].failed for i in range(3)] == [False, True, False] and keys(found[0]["keys"]) == [20, 21, 22] and found[1]["keys"] == []
    # the last balance of index 0 counts; 1 changed; 2 was closed; 3 is new, as its owner before can't be read
    assert keys(found[0].owners_all) == [1, 2, 3, 5, 8] and keys(found[0].owners_changed) == [2, 3, 5]
    table = transactions.from_raw(spark.createDataFrame(rows, TRANSACTIONS))
    filters = {
        "all": TransactionFilter(account_include=[key(1)], token_accounts="ALL"), "changed": TransactionFilter(account_include=[key(1)], token_accounts="BALANCE_CHANGED"),
        "closed": TransactionFilter(account_required=[key(3), key(22)], token_accounts="BALANCE_CHANGED"), "out": TransactionFilter(account_exclude=[key(2)], token_accounts="ALL"),
        "first": TransactionFilter(signature=b"s1"), "second": TransactionFilter(signature=b"s2"),
        "sketch": TransactionFilter(cuckoo_account_include=Cuckoo.of([key(22)], 8, 3)),
    }
    assert {r.idx: r.filters for r in transactions.match(table, filters).collect()} == {0: ["all", "closed", "first", "sketch"], 1: ["out"], 2: ["out"]}
    with pytest.raises(ValueError):
        transactions.match(table.drop("owners_all"), {"all": filters["all"]})


def test_whole_requests(spark):
    from ledgerlens.plans.evaluate import evaluate, updates
    from ledgerlens.plans.request import EmptyFilter, Request, RequestError, SlotFilter, TransactionFilter

    slots = spark.createDataFrame([(1, "finalized"), (2, "confirmed"), (3, "processed"), (3, "dead")], "slot long, status string")
    made = spark.createDataFrame([(s, f"t{s}", s == 2, False, ["k"]) for s in (1, 2, 3, 4)], "slot long, signature string, is_vote boolean, failed boolean, keys array<string>")
    asked = lambda level: Request(transactions={"a": TransactionFilter(account_include=["k"])}, transactions_status={"v": TransactionFilter(vote=True)}, slots={"s": SlotFilter()}, commitment=level)
    tables = {"slots": slots, "transactions": made}
    got = lambda level: sorted((r.kind, r.slot) for r in updates(asked(level), tables).collect())
    states = [("slots", 1), ("slots", 2), ("slots", 3)]
    assert got(None) == states + [("transactions", s) for s in (1, 2, 3, 4)] + [("transactions_status", 2)]
    assert got("confirmed") == states + [("transactions", 1), ("transactions", 2), ("transactions_status", 2)]
    assert got(2) == states + [("transactions", 1)]
    assert evaluate(Request(), tables) == {}
    with pytest.raises(ValueError):
        updates(Request(), tables)
    with pytest.raises(RequestError):
        evaluate(Request(entries={"e": EmptyFilter()}, data_slices=[(5, 1), (0, 1)]), tables)


def rows_and_sql(spark, folder, name: str, changes: dict[str, dict]) -> tuple[list, list]:
    """Rows of a query and of its SQL on the small tables with rows added: each table's first row with the given columns."""
    import duckdb

    from ledgerlens import queries

    c = duckdb.connect()
    for t in "events orders lineitem".split():
        own = spark.read.parquet(f"{SF}/{t}.parquet")
        more = own.limit(1).withColumns({k: F.lit(x).cast(own.schema[k].dataType) for k, x in changes.get(t, {}).items()})
        own.union(more).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return plain(queries.QUERIES[name](spark, str(folder)).toPandas()), plain(c.sql(queries.ORACLE_SQL[name]).df())


def test_account_cuckoo_checks_what_its_sketch_lets_pass(spark, tmp_path):
    passing = Cuckoo.of([b"1", b"5", b"9"], 8, 7).contains([b"42862"])
    got, want = rows_and_sql(spark, tmp_path, "account_cuckoo", {"events": {"event_id": 10**6, "user_id": 42862, "event_type": "click"}})
    assert passing.all() and want and got == want


def test_block_cuckoo_checks_what_its_sketch_lets_pass(spark, tmp_path):
    passing = Cuckoo.of([b"P1", b"P2", b"S3"], 8, 7).contains([b"P30637"])
    more = {"orders": {"o_orderkey": 10**6}, "lineitem": {"l_orderkey": 10**6, "l_partkey": 30637, "l_suppkey": 9}}
    got, want = rows_and_sql(spark, tmp_path, "block_cuckoo", more)
    assert passing.all() and want and got == want


def test_tx_cuckoo_include_checks_what_its_sketch_lets_pass(spark, tmp_path):
    passing = Cuckoo.of([b"P1", b"P2", b"S3"], 8, 7).contains([b"P30637", b"S12057"])
    more = {"orders": {"o_orderkey": 10**6, "o_orderpriority": "5-LOW"}, "lineitem": {"l_orderkey": 10**6, "l_partkey": 30637, "l_suppkey": 12057}}
    got, want = rows_and_sql(spark, tmp_path, "tx_cuckoo_include", more)
    assert passing.all() and want and got == want


def test_token_owners_agree_with_a_naive_evaluator(spark):
    from ledgerlens.schema import TRANSACTIONS

    rng = random.Random(5)
    keys = [bytes([n]) * 32 for n in range(6)]
    texts = [*map(base58.encode, keys), "bad", "1" * 31, "z" * 44, "", None]
    some = lambda: rng.choice([None, [], *[[{"account_index": rng.randrange(4), "owner": rng.choice(texts), "amount": rng.choice(["1", "2", "", None])} for _ in range(rng.randrange(6))]] * 8])
    rows = [{"slot": 1, "idx": i, "meta": {"pre_token_balances": some(), "post_token_balances": some()}} for i in range(300)]

    def naive(meta):
        pre, post = ([b for b in meta[f"{s}_token_balances"] or [] if b["owner"] in texts[:6]] for s in ("pre", "post"))
        last, after = {b["account_index"]: b for b in pre}, {b["account_index"] for b in post}
        new = [b for b in post if b["account_index"] not in last or (last[b["account_index"]]["amount"] or "") != (b["amount"] or "")]
        gone = [b for b in pre if b is last[b["account_index"]] and b["account_index"] not in after]
        return tuple(list(dict.fromkeys(base58.decode(b["owner"]) for b in some)) for some in (pre + post, new + gone))

    found = transactions.from_raw(spark.createDataFrame(rows, TRANSACTIONS).repartition(3))
    got = {r.idx: ([bytes(k) for k in r.owners_all], [bytes(k) for k in r.owners_changed]) for r in found.collect()}
    assert got == {r["idx"]: naive(r["meta"]) for r in rows}
    filters = {m: TransactionFilter(account_include=[keys[1]], account_exclude=[keys[2]], token_accounts=m) for m in ("ALL", "BALANCE_CHANGED")}
    plan = transactions.match(found, filters)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # owners are found once a row, not again for the condition


def test_raw_transactions_take_few_shuffles(spark, tmp_path):
    """Lines are shuffled raw, once for keys and once for balances; flags beside A and R, repeated lines and orders without lines count as in the SQL."""
    import duckdb

    from ledgerlens.sources.tables import Views

    plan = Views(spark, SF).raw_transactions()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "SortAggregate" not in plan and plan.count("ArrowEvalPython") == 1
    lines, orders = spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/orders.parquet")
    flags = F.array(*[F.lit(x) for x in ("0", "A", "B", "N", "R", "Z")], F.lit(None).cast("string"))
    odd = lines.withColumn("l_returnflag", F.get(flags, (F.xxhash64("l_orderkey", "l_suppkey", "l_partkey") % 7 + 7).cast("int") % 7))
    odd.union(odd.where("l_orderkey % 3 = 0").withColumn("l_suppkey", F.col("l_suppkey") + 1)).where("l_orderkey % 5 <> 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("tx_from_raw", "tx_token_owner_balance_changed"):
        assert plain(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(c.sql(queries.ORACLE_SQL[name]).df())

"""Streams: files landed bit by bit leave the same state as one batch over everything."""

import base64
import json
import random
import struct
from datetime import datetime

from ledgerlens.operators import holders
from ledgerlens.streaming import events, holders as holder_stream
from ledgerlens.streaming.ingest import ingest_landed
from ledgerlens.sources import landed, tables


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(line) for line in lines))


def notification(method, value=None, slot=None, seq=0, context=1):
    result = {"context": {"slot": context}}
    if value is not None:
        result["value"] = value
    if slot is not None:
        result["slot"] = slot
    return {"method": method, "received_at": "2024-01-01T00:00:00Z", "seq": seq, "result": result}


def parsed(pubkey, mint, owner, amount, seq=0, context=1):
    info = {"mint": mint, "owner": owner, "tokenAmount": {"amount": str(amount)}}
    value = {"pubkey": pubkey, "account": {"data": {"parsed": {"info": info}}}}
    return notification(events.PROGRAM, value, seq=seq, context=context)


def raw(pubkey, mint, owner, amount, size=165, seq=0, context=1):
    body = mint.to_bytes(32, "big") + owner.to_bytes(32, "big") + struct.pack("<Q", amount)
    data = base64.b64encode((body + b"\x00" * 100)[:size]).decode()
    return notification(events.PROGRAM, {"pubkey": pubkey, "account": {"data": [data, "base64"]}}, seq=seq, context=context)


def test_event_rows(spark, tmp_path):
    write_lines(
        tmp_path / "in",
        "a.json",
        [
            notification(events.SLOT, slot=7),
            notification(events.SLOT, slot=0),
            notification(events.LOGS, {"signature": "s", "logs": ["a", "b"]}),
            notification(events.LOGS, {"signature": "s", "logs": []}),
            notification(events.LOGS, {"signature": "", "logs": ["a"]}),
            notification(events.PROGRAM, {"pubkey": "p"}),
            notification(events.PROGRAM, {"pubkey": ""}),
            notification("other", {"pubkey": "p"}),
        ],
    )
    stream = events.event_rows(events.read_notifications(spark, str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        events.write_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["event_type"], r["slot"], r["signature"], r["log_count"], r["pubkey"]) for r in rows) == [
        ("logs", 0, "s", 2, ""),
        ("program", 0, "", 0, "p"),
        ("slot", 7, "", 0, ""),
    ]
    assert rows[0]["received_at"] == datetime(2024, 1, 1)


def test_account_updates(spark, tmp_path):
    write_lines(
        tmp_path / "in",
        "a.json",
        [
            parsed("p1", "M", "alice", 2**63 + 5),
            raw("p2", 58, 59, 2**64 - 1),
            raw("p3", 58, 59, 5, size=71),
            parsed("", "M", "alice", 5),
            parsed("p4", "M", "", 5),
            notification(events.PROGRAM, {"pubkey": "p5"}),
        ],
    )
    notes = spark.read.schema(events.NOTIFICATION).json(str(tmp_path / "in"))
    rows = {r["account"]: (r["mint"], r["owner"], int(r["amount"])) for r in events.account_updates(notes).collect()}
    assert rows == {"p1": ("M", "alice", 2**63 + 5), "p2": ("21", "22", 2**64 - 1)}


def test_state_in_pieces_equals_one_batch(spark, tmp_path):
    random.seed(11)
    lines = [
        parsed(f"p{random.randrange(40)}", f"M{i % 3}", f"o{random.randrange(9)}", random.choice([0, 5, 9]), i, random.randrange(6))
        for i in range(400)
    ]
    (tmp_path / "in").mkdir()
    stream = events.account_updates(events.read_notifications(spark, str(tmp_path / "in")))
    random.shuffle(lines)  # late updates arrive in later files
    for part in range(4):
        write_lines(tmp_path / "in", f"{part}.json", lines[part * 100 : part * 100 + 100])
        holder_stream.follow_accounts(stream, str(tmp_path / "log"), str(tmp_path / "cp"), True).awaitTermination()
    log = holder_stream.read_log(spark, str(tmp_path / "log"))
    everything = events.account_updates(spark.read.schema(events.NOTIFICATION).json(str(tmp_path / "in")))

    def state(df):
        return sorted(tuple(r) for r in df.select("account", "mint", "owner", "amount", "slot", "seq").collect())

    expected = state(holders.latest_accounts(everything))
    assert state(holder_stream.current_accounts(log)) == expected and expected
    newest = {}
    for line in sorted(lines, key=lambda n: (n["result"]["context"]["slot"], n["seq"])):
        newest[line["result"]["value"]["pubkey"]] = line
    alive = {p for p, n in newest.items() if n["result"]["value"]["account"]["data"]["parsed"]["info"]["tokenAmount"]["amount"] != "0"}
    assert {row[0] for row in expected} == alive
    root = str(tmp_path / "compact")
    holder_stream.compact(log, root)
    assert tables.read_version(spark, root).count() == len(newest)
    assert state(holders.latest_accounts(tables.read_version(spark, root))) == expected
    # Folding the log twice keeps the state; batches stay for readers until the next version.
    path, folded = str(tmp_path / "log"), str(tmp_path / "folded")
    assert state(holder_stream.state(spark, path, folded)) == expected
    logged = holder_stream.batches(spark, path)
    assert holder_stream.fold(spark, path, folded) and holder_stream.batches(spark, path) == logged != []
    assert holder_stream.fold(spark, path, folded) is None
    assert state(holder_stream.state(spark, path, folded)) == expected
    gone = spark.createDataFrame([(expected[0][0], "m", "o", 0, 10**9, 1)], holder_stream.CHANGE_LOG.replace("decimal(20,0)", "int"))
    gone.selectExpr("account", "mint", "owner", "cast(amount as decimal(20,0)) amount", "slot", "seq").write.parquet(f"{path}/batch=99")
    assert state(holder_stream.state(spark, path, folded)) == expected[1:]
    assert holder_stream.fold(spark, path, folded) and state(holder_stream.state(spark, path, folded)) == expected[1:]
    assert holder_stream.batches(spark, path) == [99]


def test_periodic_ingest_reads_each_file_once(spark, tmp_path):
    def payload(owner, amount):
        info = {"owner": owner, "tokenAmount": {"uiAmount": amount}}
        return {"mint_address": "M", "slot": 1, "payload": json.dumps({"pubkey": "p", "account": {"data": {"parsed": {"info": info}}}})}

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("mint_address string, slot bigint, payload string").json(str(tmp_path / "in"))

    def run():
        to_rows = lambda df: landed.token_holders(df, "2024-01-01 00:00:00")
        ingest_landed(stream, to_rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    write_lines(tmp_path / "in", "1.json", [payload("a", 1.5), payload(None, None)])
    assert run() == 2 and run() == 2
    write_lines(tmp_path / "in", "2.json", [payload("b", 2)])
    assert run() == 3
    rows = {(r["wallet_address"], r["balance"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("a", 1.5), ("p", 0.0), ("b", 2.0)}


def test_closed_accounts_leave_the_store_and_stay_closed(spark, tmp_path):
    schema = "account string, mint string, owner string, amount decimal(20,0), slot bigint, seq bigint, at timestamp"
    folder = tmp_path / "in"
    folder.mkdir()

    def land(name, *rows):
        lines = [dict(zip(("account", "amount", "slot", "at"), row), mint="M", owner="o", seq=0) for row in rows]
        write_lines(folder, name, lines)
        stream = spark.readStream.schema(schema).json(str(folder))
        query = holder_stream.follow_accounts(stream, str(tmp_path / "log"), str(tmp_path / "cp"), True, lateness="10 minutes")
        query.awaitTermination()

    def held():
        rows = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "last").load()
        return sorted(r[0] for r in rows.selectExpr("key.account").collect())

    def alive():
        log = holder_stream.read_log(spark, str(tmp_path / "log"))
        return {r["account"]: int(r["amount"]) for r in holder_stream.current_accounts(log).collect()}

    land("1.json", ("a", 5, 1, "2024-01-01 00:00:00"), ("b", 7, 1, "2024-01-01 00:00:00"), ("a", 0, 3, "2024-01-01 00:01:00"))
    assert held() == ["a", "b"] and alive() == {"b": 7}
    # Late, but not too late: the tombstone is still there.
    land("2.json", ("a", 9, 2, "2024-01-01 00:00:30"))
    assert held() == ["a", "b"] and alive() == {"b": 7}
    land("3.json", ("c", 1, 9, "2024-01-01 01:00:00"), ("b", 8, 4, "2024-01-01 01:00:00"))
    land("4.json", ("c", 2, 10, "2024-01-01 01:01:00"))
    assert held() == ["b", "c"] and alive() == {"b": 8, "c": 2}
    # Too late: it is dropped, and does not open the account again.
    land("5.json", ("a", 9, 2, "2024-01-01 00:00:40"))
    assert held() == ["b", "c"] and alive() == {"b": 8, "c": 2}
    land("6.json", ("a", 4, 20, "2024-01-01 01:02:00"))
    assert held() == ["a", "b", "c"] and alive() == {"a": 4, "b": 8, "c": 2}

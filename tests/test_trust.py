"""Payload contracts against a plain walk of the same JSON; versions that are published whole or not at all; events that land once."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.payloads import broken_payloads
from plumbline.plans.trust import CONTRACT
from plumbline.sources import publish
from plumbline.streaming.late import correct_windows, corrected_windows, late_rows


def walked(payloads):
    """What CONTRACT finds, by reading each payload with Python."""
    broken, serials = [], set()
    for key, text in payloads:
        try:
            whole = json.loads(text)
        except (TypeError, ValueError):
            broken.append((key, "$", "json"))
            continue
        deals = whole.get("deals") if isinstance(whole, dict) else None
        if not isinstance(deals, list):
            broken.append((key, "$.deals", "missing"))
            continue
        if whole.get("total") != len(deals):
            broken.append((key, "$.total", "total"))
        ids, rejected = set(), {r["id"] for r in whole.get("rejected") or [] if r.get("id") is not None}
        for i, d in enumerate(deals):
            at = f"$.deals[{i}]"
            line = (d.get("evidence") or {}).get("line")
            broken += [(key, f"{at}.{p}", "missing") for p, v in (("id", d.get("id")), ("amount", d.get("amount")), ("evidence.line", line)) if v is None]
            amount = d.get("amount")
            if amount is not None and not isinstance(amount, (int, float)):
                broken.append((key, f"{at}.amount", "type"))
            elif amount is not None and amount < 2000:
                broken.append((key, f"{at}.amount", "small"))
            if isinstance(line, str):
                broken.append((key, f"{at}.evidence.line", "type"))
            if d.get("flag") == "R" and (d.get("quantity") or 0) >= 40:
                broken.append((key, f"{at}.flag", "returned"))
            for value, seen, path in ((d.get("id"), ids, "id"), (d.get("serial"), serials, "serial")):
                if value is not None and value in seen:
                    broken.append((key, f"{at}.{path}", "repeated"))
                seen.add(value)
            if d.get("id") in rejected:
                broken.append((key, f"{at}.id", "also rejected"))
    return broken


def test_payload_contract_equals_a_plain_walk(spark):
    rnd = random.Random(6)

    def deal():
        d = {"id": f"d{rnd.randint(0, 30)}", "serial": "common" if rnd.random() < 0.3 else f"s{rnd.randint(0, 2000)}", "amount": rnd.choice([1, 1999.5, 2000, 3e5, "n/a", None]), "flag": rnd.choice("RAN"), "quantity": rnd.choice([3, 40, 50.5, None]), "evidence": rnd.choice([None, {}, {"line": 4}, {"line": "x"}, {"line": None}])}
        for k in [k for k in d if rnd.random() < 0.1]:
            del d[k]
        return d

    def payload():
        deals = [deal() for _ in range(rnd.randint(0, 9))]
        return json.dumps({"total": len(deals) + (rnd.random() < 0.2), "deals": deals, "rejected": [{"id": f"d{rnd.randint(0, 30)}"} for _ in range(rnd.randint(0, 3))]})

    payloads = [(i, payload()) for i in range(400)]
    payloads += [(500, None), (501, ""), (502, '{"deals": ['), (503, "[]"), (504, '{"deals": 3}'), (505, '{"total": 0, "deals": []}'), (506, '{"total": "many", "deals": []}')]
    got = broken_payloads(spark.createDataFrame(payloads, "k long, p string"), "k", "p", CONTRACT).collect()
    assert sorted(map(tuple, got)) == sorted(walked(payloads))
    assert broken_payloads(spark.createDataFrame([], "k long, p string"), "k", "p", CONTRACT).count() == 0


def test_payloads_without_repeats_or_clashes_of_their_own_are_not_compared(spark, monkeypatch):
    from plumbline.operators import payloads

    met = []
    real = payloads.join_unique
    monkeypatch.setattr(payloads, "join_unique", lambda rows, *rest, **more: met.append(rows.count()) or real(rows, *rest, **more))
    deal = lambda i, serial: {"id": i, "serial": serial, "amount": 3000, "flag": "N", "quantity": 1, "evidence": {"line": 1}}
    given = [(k, json.dumps({"total": 2, "deals": [deal("a", f"s{k}"), deal("b", f"t{k}")], "rejected": [{"id": "z"}]})) for k in range(50)]
    given += [(50, json.dumps({"total": 3, "deals": [deal("a", "u"), deal("a", "s7"), deal(None, "w")], "rejected": []})), (51, json.dumps({"total": 1, "deals": [deal("z", "x")], "rejected": [{"id": "z"}, {"id": "z"}]}))]
    got = broken_payloads(spark.createDataFrame(given, "k long, p string"), "k", "p", CONTRACT).collect()
    assert sorted(map(tuple, got)) == sorted(walked(given)) and len(got) == 4
    assert met == [2, 104, 1]  # 103, 104 and 103 before


def test_readers_keep_the_old_version_until_the_last_step(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/feed"
    with pytest.raises(LookupError):
        publish.read(spark, root, "rows")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "k")
    none = {"few": lambda staged: staged["rows"].where("k > 100")}
    first = publish.publish(root, {"rows": rows(10)}, {"seen": rows(3)}, none)
    assert first["broken"] == [] and publish.read(spark, root, "rows").count() == 10
    read_all = lambda: (publish.pinned(spark, root), publish.read(spark, root, "rows").count(), publish.read(spark, root, "seen", "reports").count())
    before = read_all()

    def dies(*_):
        raise RuntimeError("killed")

    bad = rows(5).withColumn("k", F.expr("raise_error('killed')").cast("long"))
    for feed, reports, audits in (({"rows": bad}, {}, none), ({"rows": rows(20)}, {"seen": bad}, none), ({"rows": rows(20)}, {"seen": rows(4)}, {"few": dies})):
        with pytest.raises(Exception, match="killed"):
            publish.publish(root, feed, reports, audits)
        assert read_all() == before
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(publish, "claim", dies)
        publish.publish(root, {"rows": rows(20)}, {"seen": rows(4)}, none)
    assert read_all() == before
    refused = publish.publish(root, {"rows": rows(200)}, {"seen": rows(4)}, none)
    assert refused["broken"] == ["few"] and read_all()[1:] == (10, 4) and publish.read(spark, root, "breaches", "reports").count() == 99
    assert publish.publish(root, {"rows": rows(30)}, {"seen": rows(5)}, none, apply=False)["broken"] == [] and read_all()[1:] == (10, 5)
    publish.publish(root, {"rows": rows(40)}, {"seen": rows(6)}, none)
    assert read_all()[1:] == (40, 6) and publish.read(spark, root, "rows", pin=before[0]).count() == 10
    assert not publish.claim(spark, f"{root}/current", f"{1:012d}", "{}")  # a step is taken once


def test_a_replayed_stream_lands_nothing_twice(spark, tmp_path):
    schema = "id string, at timestamp, x int"
    for i in range(4):
        spark.range(i * 50, i * 50 + 100).selectExpr("concat('e', id) id", "timestamp_seconds(id * 600) at", "cast(id as int) x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/out"

    def run(state, per, die_at=None):
        land = publish.land_once(root, "id", "at")

        def write(batch, number):
            if number == die_at:  # rows are written, the commit is never noted
                batch.write.parquet(f"{root}/rows/{number:012d}-dead")
                raise RuntimeError("killed")
            land(batch, number)

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run("a", 1, die_at=2)
    whole = lambda: sorted(map(tuple, publish.landed(spark, root, spark.read.parquet(str(tmp_path / "in")).schema).select("id", "x").collect()))
    assert len(whole()) == 150
    run("a", 1)
    want = sorted((f"e{i}", i) for i in range(250))
    assert whole() == want
    run("b", 3)  # from the beginning, in other batches
    assert whole() == want


def test_batches_that_are_read_again_are_not_kept(spark, tmp_path, monkeypatch):
    schema = "id string, at timestamp, x int"
    spark.range(90).selectExpr("CASE WHEN id % 30 < 28 THEN concat('e', id % 60) END AS id", "CASE WHEN id % 30 <> 27 THEN timestamp_seconds(id * 600) END AS at", "CAST(id AS int) AS x").repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/out"
    monkeypatch.setattr(type(rows), "persist", lambda *_: pytest.fail("a batch was kept"))
    land = publish.land_once(root, "id", "at", reread=True)
    for k, batch in enumerate((rows.where("x < 45"), rows.where("x >= 30"), rows)):
        land(batch, k)
    got = sorted((r["x"] for r in publish.landed(spark, root, rows.schema).collect()))
    told = [x for x in range(60) if x % 30 < 27]  # of e0 to e59 the earliest; what has no id or no time lands each time
    untold = [x for x in (*range(45), *range(30, 90), *range(90)) if x % 30 >= 27]
    assert got == sorted(told + untold)


def test_late_rows_correct_their_windows(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, i * 60, "hot" if rnd.random() < 0.4 else f"k{i % 7}", i % 13) for i in range(6000)]
    late = {i for i, *_ in rows if rnd.random() < 0.1}
    for b in range(4):  # each file has its own time, and the late rows of the one before the last
        part = [r for r in rows if r[0] // 1500 == b and r[0] not in late or r[0] // 1500 == b - 2 and r[0] in late]
        part += [r for r in rows if b == 3 and r[0] // 1500 >= 2 and r[0] in late] + ([(-1, None, "hot", 5)] if b == 1 else [])
        spark.createDataFrame(part, "id long, at long, k string, x int").select("id", F.timestamp_seconds("at").alias("ts"), "k", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/out"
    land, died = correct_windows(root, "ts", "k", "x", "1 hour", 3600), []

    def write(batch, number):
        if number == 2 and not died:
            died.append(number)
            raise RuntimeError("killed")
        land(batch, number)
        land(batch, number)  # a batch that comes again is passed over

    def run():
        stream = spark.readStream.schema("id long, ts timestamp, k string, x int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    want = {}
    for _, at, k, x in rows:
        n, total = want.get((at // 3600, k), (0, 0))
        want[(at // 3600, k)] = (n + 1, total + x)
    got = corrected_windows(spark, root, "k").withColumn("h", F.unix_seconds("start") / 3600).collect()
    assert {(int(r["h"]), r["k"]): (r["n"], r["total"]) for r in got} == want
    side = {r["id"] for r in late_rows(spark, root).collect()}
    assert {i for i in late if i < 3000} <= side and -1 in side and sum(r["n_late"] for r in got) == len(side) - 1 > 200

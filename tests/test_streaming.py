"""Streams over landed files end in the state that the batch forms give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import state

SF = "/root/testdata/sf0.001"


def drained(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.sql(f"select * from {name}").collect()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events in three files by time, so that each micro-batch brings a later part."""
    at = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        events.where(F.dayofmonth("ts").between(10 * k + 1, 10 * k + 10 + (k == 2))).coalesce(1).write.mode("append").parquet(at)
    return at


def stream(spark, files):
    return spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files)


def test_each_key_once(spark, files):
    got = drained(spark, state.first_seen(stream(spark, files), ["event_type", "event_id"], "ts"), "seen", "append")
    assert len(got) == len({(r["event_type"], r["event_id"]) for r in got}) == spark.read.parquet(files).count()


def test_decayed_counters(spark, files):
    got = drained(spark, state.decayed_counters(stream(spark, files), "user_id", "event_id", "value"), "decayed", "update")
    last = {}
    for r in got:
        if r["user_id"] not in last or r["runs"] > last[r["user_id"]][0]:
            last[r["user_id"]] = (r["runs"], r["recent"])
    rows = spark.read.parquet(files).orderBy("ts").collect()
    counts = {}
    for r in rows:
        counts[r["user_id"]] = counts.get(r["user_id"], 0) + 1
    assert {u: n for u, (n, _) in last.items()} == counts


def test_claims(spark, tmp_path):
    rows = [("t1", "start", 100, "a", "v"), ("t1", "complete", 105, "a", "v"), ("t1", "complete", 120, "a", "v"), ("t1", "complete", 130, "a", "v"), ("t2", "start", 0, "b", "b"), ("t3", "start", 50, "c", "v"), ("t3", "complete", 8 * 86400, "c", "v")]
    spark.createDataFrame(rows, "token string, kind string, at long, inviter string, visitor string").coalesce(1).write.parquet(str(tmp_path / "claims"))
    source = spark.readStream.schema("token string, kind string, at long, inviter string, visitor string").parquet(str(tmp_path / "claims")).withColumn("ts", F.timestamp_seconds("at"))
    emitted = drained(spark, state.claims(source, "token", "kind", "at", "inviter", "visitor", "ts"), "claims", "update")
    got = {(r["token"], r["status"], r["started"], r["completed"]) for r in emitted}
    assert ("t1", "completed", 100, 120) in got and ("t3", "pending", 50, -1) in got  # pending claims expire once the watermark is past them
    assert got <= {("t1", "completed", 100, 120), ("t3", "pending", 50, -1), ("t3", "expired", 50, -1)}


def test_windows(spark, files):
    got = drained(spark, state.windowed_counts(stream(spark, files), "ts", "event_type", "6 hours", "7 days"), "windows", "update")
    total = {}
    for r in got:
        key = (r["start"], r["event_type"])
        total[key] = max(total.get(key, 0), r["n"])
    assert sum(total.values()) == spark.read.parquet(files).count()


def batched(spark, at, batches, schema, run):
    """Runs `run` on a stream that brings each list of rows as a micro-batch; all that is emitted, in order, and the rows of state at the end."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    out = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = run(source).writeStream.outputMode("update").foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_decayed_counters_of_many_keys_take_one_state_a_bucket(spark, tmp_path):
    rnd = random.Random(3)
    keys = [None, *range(2**60, 2**60 + 300)]
    batches = [[(rnd.choice(keys) if rnd.random() < 0.7 else 5, rnd.choice([None, b * 2**58 + i]) if i % 50 == 0 else b * 2**58 + i, rnd.choice([None, 1.0, 7.0, 30.0])) for i in range(800)] for b in range(3)]
    got, held = batched(spark, str(tmp_path / "in"), batches, "k long, o long, x double", lambda s: state.decayed_counters(s, "k", "o", "x", buckets=16))
    want = {}
    for batch, emitted in zip(batches, got):
        for k, _, x in sorted(batch, key=lambda r: (r[1] is not None, r[1] or 0, -1 if r[2] is None else r[2])):
            n, recent = want.get(k, (0, 0.0))
            want[k] = (n + 1, recent * state.DECAY + (x or 0.0))
        assert {k: (n, pytest.approx(recent)) for k, n, recent in emitted} == {k: want[k] for k in {r[0] for r in batch}}
    assert held <= 17  # a state for each key before


def test_claims_of_many_tokens_take_one_state_a_bucket(spark, tmp_path):
    rnd = random.Random(4)
    day, tokens = 86400, [None, *(f"t{i}" for i in range(200))]

    def move(b):
        at = b * 6 * day + rnd.randrange(6 * day)
        return (rnd.choice(tokens), rnd.choice(["start", "complete", "complete", "view"]), at, "a", rnd.choice("abcd"))

    batches = [[move(b) for _ in range(150)] for b in range(5)]
    run = lambda s: state.claims(s.withColumn("ts", F.timestamp_seconds("at")), "token", "kind", "at", "inviter", "visitor", "ts", buckets=16)
    got, held = batched(spark, str(tmp_path / "in"), batches, "token string, kind string, at long, inviter string, visitor string", run)
    known, mark = {}, 0
    for batch, emitted in zip([*batches, []], [*got, []]):
        told, live = [], {r[0] for r in batch}
        for t in live:
            was = start, done = known.get(t, (-1, -1, 0))[:2]
            for _, kind, at, inviter, visitor in sorted((r for r in batch if r[0] == t), key=lambda r: r[2]):
                if inviter != visitor and kind == "start" and done < 0 and (start < 0 or at - start > state.CLAIM_TTL_S):
                    start = at
                elif inviter != visitor and kind == "complete" and start >= 0 > done and state.CLAIM_LEAST_S <= at - start <= state.CLAIM_TTL_S:
                    done = at
            known[t] = (start, done, max((max(start, done, 0) + state.CLAIM_TTL_S) * 1000, mark) + 1)
            told += [(t, "completed" if done >= 0 else "pending", start, done)] if (start, done) != was else []
        for t in [t for t, x in known.items() if t not in live and x[2] < mark]:
            start, done, _ = known.pop(t)
            told += [(t, "expired", start, done)] if start >= 0 > done else []
        if batch:
            assert sorted(map(str, emitted)) == sorted(map(str, told))
            mark = max(mark, (max(r[2] for r in batch) - 3600) * 1000)
        else:
            assert sorted(map(str, sum(got[len(batches):], []))) == sorted(map(str, told)) and any("expired" in str(r) for r in told)
    assert held <= 17  # a state for each token before


def test_a_landed_part_has_many_files_and_is_one_batch(spark, tmp_path):
    from plumbline.plans.queries import _event_stream

    at = str(tmp_path / "sf")
    spark.range(3000).selectExpr("id AS event_id", "CASE WHEN id > 0 THEN timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) END AS ts").repartitionByRange(5, "event_id").write.parquet(f"{at}/events.parquet")
    out = []
    source = _event_stream(spark, at)
    source.select("event_id", F.input_file_name()).writeStream.foreachBatch(lambda df, n: out.append(df.collect())).trigger(availableNow=True).start().awaitTermination(180)
    assert sorted(r[0] for b in out for r in b) == list(range(3000))  # with the event that has no time, which was left out before
    assert len(out) == 3 and max(len({r[1] for r in b}) for b in out) > 1
    assert all(max(r[0] for r in a) < min(r[0] for r in b) for a, b in zip(out, out[1:]))


def test_rows_of_one_row_group_land_in_files_of_several_tasks(spark, tmp_path):
    from plumbline.plans.queries import _event_stream

    at = str(tmp_path / "sf")
    spark.range(300_000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts").coalesce(1).write.parquet(f"{at}/events.parquet")
    out = []
    count = lambda df, n: out.append(df.groupBy(F.input_file_name().alias("file")).agg(F.count("ts").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last")).collect())
    _event_stream(spark, at).writeStream.foreachBatch(count).trigger(availableNow=True).start().awaitTermination(180)
    assert len(out) == 3 and sum(r["n"] for b in out for r in b) == 300_000
    assert all(len(b) == 3 and max(r["n"] for r in b) < 50_000 for b in out)  # one file held all of a part before
    assert all(max(r["last"] for r in a) < min(r["first"] for r in b) for a, b in zip(out, out[1:]))


def test_a_part_without_rows_lands_as_a_batch_of_empty_files(spark, tmp_path):
    from plumbline.plans.queries import _event_stream

    at = str(tmp_path / "sf")
    spark.range(500).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts").repartition(4).write.parquet(f"{at}/events.parquet")
    out = []
    _event_stream(spark, at).writeStream.foreachBatch(lambda df, n: out.append(df.count())).trigger(availableNow=True).start().awaitTermination(180)
    assert out == [500, 0, 0]

"""Greedy merges against one plain pass over the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import greedy


def one_pass(rows):
    """rows: (number, keys). What a map from keys to records gives, row by row."""
    stands, record_of, keys_of = {}, {}, {}
    for r, keys in sorted(rows):
        keys = [k for k in keys or [] if k]
        record = next((stands[k] for k in keys if k in stands), r)
        record_of[r] = record
        keys_of.setdefault(record, []).extend(keys)
        for k in keys_of[record]:
            stands[k] = record
    return record_of


def drawn(seed, n, spread):
    draw = random.Random(seed)
    key = lambda kind, most: draw.choice([None, "", *[f"{kind}{draw.randrange(most)}"] * 8])
    return [[key("a", n // spread), key("b", n // 3), key("c", n)][: draw.randint(1, 3)] for _ in range(n)]


@pytest.mark.parametrize("order", ["as they come", "reversed", "shuffled"])
def test_records_of_5000_rows(spark, order):
    keys = drawn(1, 5000, 2)
    keys = keys[::-1] if order == "reversed" else random.Random(4).sample(keys, len(keys)) if order == "shuffled" else keys
    rows = list(enumerate(keys))
    df = spark.createDataFrame(rows, "n long, keys array<string>").repartition(5)
    got = {r["n"]: r["record"] for r in greedy.greedy_records(df, "n", F.col("keys")).collect()}
    assert got == one_pass(rows)


def test_keys_change_hands(spark):
    """Row 3 bridges two records: its keys then stand for the first, until the second is joined again."""
    rows = [(1, ["a"]), (2, ["b"]), (3, ["a", "b"]), (4, ["b"]), (5, ["c", "b"]), (6, ["x"]), (7, ["x", "a"]), (8, ["a"]), (9, ["b"]), (10, None), (11, []), (12, ["", None])]
    df = spark.createDataFrame(rows, "n long, keys array<string>")
    expected = one_pass(rows)
    assert {r["n"]: r["record"] for r in greedy.greedy_records(df, "n", F.col("keys")).collect()} == expected
    assert expected[4] == 1 and expected[8] == 6 and expected[9] == 1


def test_a_chain_and_a_hot_key(spark):
    chain = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(600)]
    hot = [(1000 + i, ["hot", f"h{i % 7}"]) for i in range(1500)]
    df = spark.createDataFrame(chain + hot, "n long, keys array<string>")
    assert {r["n"]: r["record"] for r in greedy.greedy_records(df, "n", F.col("keys")).collect()} == one_pass(chain + hot)


@pytest.mark.parametrize("at_once", [0, 300])
def test_groups_by_rounds_and_by_passes(spark, at_once):
    """Groups above the limit go by rounds, others by a pass: the result is the same."""
    rows = list(enumerate(drawn(2, 700, 2))) + [(1000 + i, [f"h{i % 40}", f"v{i % 7}"]) for i in range(400)] + [(2000 + i, [f"x{i // 3}"]) for i in range(90)]
    df = spark.createDataFrame(rows, "n long, keys array<string>").repartition(5)
    assert {r["n"]: r["record"] for r in greedy.greedy_records(df, "n", F.col("keys"), at_once=at_once).collect()} == one_pass(rows)


def test_small_groups_take_no_rounds(spark):
    """Keys that change hands row after row are settled by a pass: no round is left to take."""
    rows = [(100 * g + i, [f"{g}h{i // 2}" if i % 3 else f"{g}v{i % 5}", f"{g}v{i * i % 5}"]) for g in range(50) for i in range(100)]
    df = spark.createDataFrame(rows, "n long, keys array<string>")
    assert {r["n"]: r["record"] for r in greedy.greedy_records(df, "n", F.col("keys"), most_rounds=0).collect()} == one_pass(rows)


def test_merged_rows(spark):
    rows = [(1, "a", None, 2, None), (2, "b", None, 5, "x"), (3, "a", "b", 5, "y"), (4, "z", None, 1, None)]
    df = spark.createDataFrame(rows, "n long, k string, l string, score int, note string")
    got = {r["record"]: (r["score"], r["note"], r["n_merged"]) for r in greedy.greedy_merge(df, "n", F.array("k", "l"), F.col("score"), ["score"], ["note"]).collect()}
    assert got == {1: (5, "y", 2), 2: (5, "x", 1), 4: (1, None, 1)}
    assert greedy.greedy_merge(df.limit(0), "n", F.array("k", "l"), F.col("score"), ["score"]).collect() == []


def test_query_of_events(spark):
    """The registered query over the whole table."""
    from plumbline.plans.queries import QUERIES
    from plumbline.plans import timing  # noqa: F401

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id", "value", "event_type", "cast(ts AS timestamp) AS ts").collect()
    at = lambda r: r["ts"].replace(minute=0, second=0, microsecond=0)
    rows = [(r["event_id"], [f"h{r['user_id']}|{at(r)}", f"v{r['user_id']}|{int(r['value'] // 1)}", f"d{r['user_id']}|{r['ts'].date()}" if r["event_type"] == "signup" else None]) for r in events]
    record = one_pass(rows)
    best: dict = {}
    for r in events:
        best.setdefault(record[r["event_id"]], []).append((r["value"], -r["event_id"]))
    got = {r["record"]: (r["event_id"], r["n_merged"]) for r in QUERIES["q_greedy_merge"](spark, sf).collect()}
    assert got == {k: (-max(v)[1], len(v)) for k, v in best.items()}
    assert len(got) < len(events)

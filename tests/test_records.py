"""Record operators on rows made by hand, and those without SQL against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.operators import rank, retention, reviews
from plumbline.operators.joins import join_unique


SF = "/root/testdata/sf0.001"


def test_join_unique_on_hot_and_null_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(None, 1), ("a", 2), ("gone", 3)] + [(f"k{i}", i) for i in range(2500)], "k string, v long")
    unique = spark.createDataFrame([("hot", 1), (None, 2), ("a", 3), ("unused", 4)] + [(f"k{i}", i) for i in range(2500)], "k string, w long")
    got = sorted(map(tuple, join_unique(rows, unique, ["k"]).collect()), key=str)
    values = {r["k"]: r["w"] for r in unique.collect()}
    assert got == sorted(((r["k"], r["v"], values[r["k"]]) for r in rows.collect() if r["k"] in values), key=str)
    assert join_unique(rows.where("false"), unique, ["k"]).count() == 0


def test_positions_of_a_hot_group(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("aaaaaab"), rnd.randint(0, 50), i) for i in range(4000)] + [(None, 1, 5000), (None, 0, 5001)]
    got = {r["n"]: r["position"] for r in rank.positions(spark.createDataFrame(data, "g string, x int, n int"), ["g"], [("x", False), ("n", True)]).collect()}
    for g in ("a", "b", None):
        order = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(len(order)))


def test_several_key_dedup_against_brute_force(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice(["a", "b", "", None]) and f"u{rnd.randint(0, 60)}", rnd.choice([None, f"i{rnd.randint(0, 90)}"]), rnd.randint(0, 9)) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, url string, social string, score int")
    got = {r["id"]: r["n_merged"] for r in retention.several_key_dedup(rows, "id", [F.col("url"), F.col("social")], F.struct("score", -F.col("id")), ["score"]).collect()}
    parent = {r[0]: r[0] for r in data}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at in (1, 2):
        first: dict = {}
        for r in data:
            if r[at]:
                a, b = root(first.setdefault(r[at], r[0])), root(r[0])
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for r in data:
        groups[root(r[0])].append(r)
    assert got == {max(g, key=lambda r: (r[3], -r[0]))[0]: len(g) for g in groups.values()}


def test_the_window_of_owners_moves_on(spark):
    rows = spark.createDataFrame([(f"o{i}", n) for i in range(30) for n in range(30 - i)], "owner string, at int")
    rest = spark.createDataFrame([("o1",)], "owner string")
    turns = [{r["owner"] for r in reviews.owners_to_verify(rows, "owner", "at", rest, 3, turn, 5).collect()} for turn in range(3)]
    assert all({"o0", "o2", "o3"} <= t and len(t) == 8 and "o1" not in t for t in turns) and len(set().union(*turns)) > 8


def test_source_health_reads_rows_once_and_moves_no_texts(spark, monkeypatch):
    """The table is read for one stored result, and no join carries texts to it."""
    from plumbline.operators import stats
    from plumbline.plans.queries import QUERIES

    plans, store = [], stats.store
    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(stats, "store", lambda df, tag: (plans.append(of(df)), store(df, tag))[1])
    assert "md5(" not in of(QUERIES["q_source_health"](spark, "/root/testdata/sf0.001"))
    assert len(plans) == 1
    lines = plans[0].splitlines()
    digest = next(i for i, line in enumerate(lines) if "md5(" in line)
    assert any("Join" in line for line in lines[:digest]) and not any("text#" in line for line in lines[:digest])

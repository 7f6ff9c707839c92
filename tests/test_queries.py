"""Every registered query against its SQL on the smallest tables; those without SQL against what they must satisfy."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import pytest

from plumbline.plans import records, texts, timing, trust  # noqa: F401  (they register their queries)
from plumbline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_hash_ids(spark):
    def base36(n):
        digits = ""
        while True:
            n, r = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
            if not n:
                return digits

    def fold(seed, start, step):
        h = start
        for c in seed:
            h = step(h, ord(c)) & 0xFFFFFFFF
        return base36(h)

    rows = QUERIES["q_hash_ids"](spark, SF).collect()
    seeds = {r["doc_id"]: f"{r['source']}|{r['lang']}|{r['doc_id']}" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        seed = seeds[r["doc_id"]]
        assert r["xor33"] == fold(seed, 5381, lambda h, c: (h * 33) ^ c)
        assert r["poly31"] == fold(seed, 0, lambda h, c: h * 31 + c) and r["poly33"] == fold(seed, 0, lambda h, c: h * 33 + c)
        assert r["fnv1a"] == fold(seed, 2166136261, lambda h, c: (h ^ c) * 16777619)


def test_groups_that_share_keys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r["group"] for r in QUERIES["q_multi_key_components"](spark, SF).collect()}
    heads: dict[str, int] = {}
    loose = lambda t: "".join(c for c in t.lower() if c.isalpha())
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        heads.setdefault(loose(r["text"]), r["doc_id"])
    assert got == {r["doc_id"]: heads[loose(r["text"])] for r in docs}


def test_feed_version_follows_rows_and_order(spark):
    from pyspark.sql import functions as F

    from plumbline.sources.sinks import feed_version

    rows = spark.range(25_000).withColumn("x", F.col("id") * 3)
    one, again = feed_version(rows, "id").first(), feed_version(rows.repartition(7), "id").first()
    assert one == again and one["total"] == 25_000 and one["version"].startswith("ff1-") and len(one["version"]) == 24
    assert feed_version(rows.withColumn("x", F.col("x") + (F.col("id") == 9).cast("int")), "id").first()["version"] != one["version"]
    assert feed_version(rows.withColumn("id", 24_999 - F.col("id")), "id").first()["version"] != one["version"]
    assert feed_version(rows.where("false"), "id").first()["total"] == 0

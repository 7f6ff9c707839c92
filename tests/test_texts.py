"""Cuts between grapheme clusters, JSON with halves of pairs, and budgets against a check-by-check allotment."""

from __future__ import annotations

import json
import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.budget import MOST_SCORE, allotted

# Emoji with two joiners in a row, which are not well formed, are one cluster to the JVM and two to others: none here.
PIECES = ["a", "Z", " ", "\r\n", "\n", "\r", "e\u0301", "o\u0302\u0323", "\u0301", "\U0001f600", "\U0001f44d\U0001f3fd", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f1e6\U0001f1f9", "\U0001f1e9", "\u1100\u1161\u11a8", "\uac00\u11a8", "a\u200d", "1\ufe0f\u20e3", "ß"]


def test_no_cluster_is_split(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 14))) for _ in range(10_000)] + [None, "e" + "\u0301" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most in (0, 1, 7):
        got = {r["i"]: r["v"] for r in df.select("i", text.cut_graphemes(F.col("t"), most).alias("v")).collect()}
        for i, t in enumerate(texts):
            want = ""
            for cluster in regex.findall(r"\X", t or ""):
                if len(want) + len(cluster) > most:
                    break
                want += cluster
            assert got[i] == want, (most, t)


def test_halves_of_pairs_become_replacements(spark):
    rnd = random.Random(4)
    bits = ["a", "\\n", "\\\\", "\\ud83d", "\\uDE00", "\\ud83d\\ude00", "\\u00e4", "\\\\ud83d", "ud83d", "é"]
    payloads = ['"' + "".join(rnd.choices(bits, k=rnd.randint(0, 12))) + '"' for _ in range(2000)]
    payloads += ['"' + "\\n\\u00e4x" * 200_000 + '\\ud83d"']  # long, and all escapes
    got = spark.createDataFrame(list(enumerate(payloads)), "i int, p string").select("i", text.repair_surrogates(F.col("p")).alias("v")).collect()
    for r in got:
        said = json.loads(payloads[r["i"]])
        assert json.loads(r["v"]) == "".join("\ufffd" if 0xD800 <= ord(c) <= 0xDFFF else c for c in said)
    assert spark.range(1).select(text.repair_surrogates(F.lit(None).cast("string")).alias("v")).first()["v"] == ""


@pytest.mark.parametrize("raw, want", [("  Gültig\u00a0bis  Größe ", "gultig bis grosse"), ("3.\u20139. März\u22122026", "3.-9. marz-2026"), ("\ufb01n \u2460", "fin 1"), (None, "")])
def test_signal(spark, raw, want):
    assert spark.range(1).select(text.signal(F.lit(raw).cast("string")).alias("v")).first()["v"] == want


def one_by_one(rows, budget, step):
    """Each check goes to the stratum whose next row is worth most; the smaller name first, a null before all names."""
    queues = {}
    for s, v, k in rows:
        if v is not None and int(v // 1) > 0:
            queues.setdefault(s, []).append((-min(int(v // 1), MOST_SCORE), k))
    for q in queues.values():
        q.sort()
    done, out = dict.fromkeys(queues, 0), {}
    for _ in range(budget):
        offers = [(-(-q[done[s]][0] - step * done[s]), s is not None, s or "", s) for s, q in queues.items() if done[s] < len(q)]
        offers = sorted(o for o in offers if o[0] < 0)
        if not offers:
            break
        s = offers[0][3]
        out[queues[s][done[s]][1]] = -offers[0][0]
        done[s] += 1
    return out


@pytest.mark.parametrize("budget, step, top", [(0, 1, 40), (1, 3, 40), (60, 7, 40), (150, 1, 12), (90, 2, 30_000), (5000, 5, 40)])
def test_budget_goes_where_checks_are_worth_most(spark, budget, step, top):
    rnd = random.Random(budget + step)
    names = ["hot"] * 8 + [None, ""] + [f"s{i}" for i in range(12)]
    rows = [(rnd.choice(names), rnd.choice([None, 0.0, -3.0, rnd.uniform(0, top), float(rnd.randint(1, top))]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, v double, k long").repartition(5)
    got = allotted(df, "s", "v", "k", budget, step).collect()
    assert {r["k"]: r["worth"] for r in got} == one_by_one(rows, budget, step) and len({r["k"] for r in got}) == len(got)


def test_budget_of_no_rows(spark):
    assert allotted(spark.createDataFrame([], "s string, v int, k long"), "s", "v", "k", 9, 1).collect() == []
    with pytest.raises(ValueError):
        allotted(spark.range(1), "id", "id", "id", 9, 0)

"""What texts say of validity, and dates of pages, against cases and plain Python."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import expiry, hints

TODAY = datetime.date(2026, 6, 27)
CASES = [
    ("4.9.2026", "end", "2026-09-04"), ("04.09.2026", "end", "2026-09-04"), ("4/9/2026", "end", "2026-09-04"), ("2026-05-08T23:59:59.999Z", "end", "2026-05-08"),
    ("Am 29.06", "single", "2026-06-29"), ("Kurzfristig / siehe TikTok", "recurring", ""), ("Ganztägig", "recurring", ""), ("Gutschein-abhängig", "recurring", ""),
    ("Gültig bis 30.9.2026", "end", "2026-09-30"), ("endet am 3. Juli", "end", "2026-07-03"), ("letzter Tag 5.8.", "end", "2026-08-05"),
    ("12.3.2026 - 15.4.26", "range", "2026-03-12 2026-04-15"), ("12/3/2026–15/4/2026", "range", "2026-03-12 2026-04-15"), ("28.12. - 3.1.2027", "range", "2026-12-28 2027-01-03"),
    ("1.6.-30.6.", "range", "2026-06-01 2026-06-30"), ("20.7. – 5.1.", "range", "2026-07-20 2027-01-05"), ("28.12. – 3.1.", "range", "2025-12-28 2026-01-03"),
    ("12.-15.3.2026", "range", "2026-03-12 2026-03-15"), ("30.-2.1.2027", "range", "2026-12-30 2027-01-02"), ("27. - 3.8.", "range", "2026-07-27 2026-08-03"),
    ("5. - 7. August 2026", "range", "2026-08-05 2026-08-07"), ("Anfang Mai 2026", "approx-range", "2026-05-01 2026-05-10"), ("Mitte Februar 2026", "approx-range", "2026-02-10 2026-02-20"),
    ("Ende Februar 2026", "approx-range", "2026-02-20 2026-02-28"), ("im Oktober 2026", "month", "2026-10-01 2026-10-31"), ("3. Juli 2026", "end", "2026-07-03"), ("July 4 2026", "end", "2026-07-04"),
    ("jeden Mittwoch", "recurring", ""), ("wöchentlich ab 3.4.", "recurring", ""), ("solange der Vorrat reicht", "recurring", ""), ("Mo-Fr 10:00-18:00", "recurring", ""), ("Mo-Fr", "recurring", ""),
    ("nur heute", "single", "2026-06-27"), ("nur morgen", "single", "2026-06-28"), ("gültig am 1.8.2026", "single", "2026-08-01"), ("gültig ab 1.10.2026", "start", "2026-10-01"), ("Abholung ab 1.10.", "start", "2026-10-01"),
    ("öffnet am 1.10.2026", "start", "2026-10-01"), ("1.10.2026 ab 17:00", "start", "2026-10-01"), ("1.10.2026 bis 18:00", "single", "2026-10-01"), ("Konzert 1.10.2026", "single", "2026-10-01"),
    ("2.1.", "end", "2026-01-02"), ("31.2.2026", "unknown", ""), ("kein Datum", "unknown", ""), ("", "unknown", ""), (None, "unknown", ""), ("99999999999.5 km", "unknown", ""),
]


def test_shapes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    rows = df.select("i", expiry.shape(F.col("t"), F.lit(str(TODAY)).cast("date")).alias("s")).select("i", "s.*").collect()
    got = {r["i"]: (r["kind"], " ".join(str(r[c]) for c in ("valid_on", "valid_from", "valid_until") if r[c])) for r in rows}
    assert {CASES[i][0]: got[i] for i in got} == {t: (kind, days) for t, kind, days in CASES}


def test_context_adds_words_and_no_dates(spark):
    day = F.lit(str(TODAY)).cast("date")
    of = lambda t, c: spark.range(1).select(expiry.shape(F.lit(t), day, F.lit(c)).alias("s")).first()["s"]
    assert of("4.9.2026", "Am 4. September findet das 6. Straßenfest statt.")["valid_on"] == datetime.date(2026, 9, 4)
    assert of("bald", "am 4.9.2026")["kind"] == "unknown"


def test_a_december_day_is_next_year_s_only_when_it_is_near(spark):
    of = lambda t, d: spark.range(1).select(expiry.shape(F.lit(t), F.lit(d).cast("date")).alias("s")).first()["s"]
    assert of("2.1.", "2026-12-20")["valid_until"] == datetime.date(2027, 1, 2)
    assert of("28.12. - 3.1.", "2026-12-20")["valid_until"] == datetime.date(2027, 1, 3)


PIECE = re.compile(rf"(?s)(?P<date>{hints.DATE})|(?P<end>(?<![^\W\d_])(?:{'|'.join(sorted((r'\s+'.join(p.split()) for p in hints.ENDS), key=lambda p: (-len(p), p)))})(?![^\W\d_]))|(?P<other>(?<![^\W\d_])(?:{'|'.join(hints.OTHERS)})(?![^\W\d_]))|[^\W\d_]+|\d+|(?P<stop>[.!?;\n])|.")


def pairs_of(text, reach=hints.REACH):
    """All dates against all phrases of their sentence."""
    dates, ends, zone, other = [], [], 0, False
    for m in PIECE.finditer(text.lower()):
        if m["stop"]:
            zone, other = zone + 1, False
        elif m["end"]:
            ends.append((m.start(), m.end(), zone, m[0]))
            other = False
        elif m["other"]:
            other = True
        elif m["date"]:
            dates.append((m.start(), m.end(), zone, m[0], other))
            other = False
    found = []
    for at, end, zone, day, other in dates:
        for s, e, z, phrase in ends:
            gap = at - e if e <= at else s - end
            if z == zone and not other and gap <= reach:
                found.append((gap, max(at, s), at, day, phrase))
    if found:
        gap, _, at, day, phrase = min(found)
        return hints.EXPLICIT, gap, at, day, phrase
    return (hints.BROAD, None, dates[0][0], dates[0][3], None) if dates else None


def test_nearest_pairs(spark):
    draw = random.Random(3)
    words = ["Gültig bis", "endet am", "Aktualisiert am", "stand", "letzter Tag", "1.2.2026", "2026-03-04", "3. Juli 2026", "5.6.", ".", "!", "\n", "Rabatt", "auf alles", "und noch mehr Worte hier", "x" * 50, "Standort", "bis"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 14))) for _ in range(800)] + ["", "gültig bis auf Widerruf. Reisezeitraum: 12.4. bis 20.4."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r["i"]: r["n"] and tuple(r["n"]) for r in df.select("i", hints.nearest(F.col("t")).alias("n")).collect()}
    assert got.pop(-1) is None
    assert {texts[i]: got[i] for i in got} == {t: pairs_of(t) for t in texts}


@pytest.mark.parametrize(
    ("page", "evidence", "day"),
    [
        ('<meta property="og:title" content="1+1 jeden Mittwoch"><footer>Zuletzt aktualisiert am 3. Juli 2026</footer>', "broad-token", "2026-07-03"),
        ('<meta property="og:title" content="20% Kaffee-Rabatt"><meta property="og:description" content="Gültig bis 30.9.2026">', "explicit-phrase", "2026-09-30"),
        ('<meta property="og:title" content="Sammler"><meta property="og:description" content="Das Angebot ist gültig bis für dich weiter. Aktualisiert am 07.07.2026 und online verfügbar.">', "broad-token", "2026-07-07"),
        ('<meta property="og:description" content="Gültig bis auf Widerruf. Reisezeitraum: 12.4. bis 20.4.">', "broad-token", "2026-04-12"),
        ("<p>Stand 1.1.2026</p><p>Aktion bis 5.8.2026!</p>", "explicit-phrase", "2026-08-05"),
        ("<p>nichts</p>", None, None),
        (None, None, None),
    ],
)
def test_page_dates(spark, page, evidence, day):
    got = spark.range(1).select(hints.page_dates(F.lit(page).cast("string"), F.lit(str(TODAY)).cast("date")).alias("h")).first()["h"]
    assert (got["evidence"], got["day"] and str(got["day"])) == (evidence, day)


@pytest.mark.parametrize("title", ["Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Host 17.65.244.232 und 4.5.60.7", "so 65.3", "so 10.3", "am 30.2. nie", "4711-55-99", "1.2.199"])
def test_numbers_that_are_no_dates(spark, title):
    page = f"<title>{title}</title><p>Zuletzt aktualisiert am 3.7.2026</p>"
    got = spark.range(1).select(hints.page_dates(F.lit(page), F.lit(str(TODAY)).cast("date")).alias("h")).first()["h"]
    assert (got["evidence"], got["zone"], str(got["day"])) == ("broad-token", "text", "2026-07-03")


@pytest.mark.parametrize(("text", "day"), [("endet am 10.3", "10.3"), ("endet am 31.12.", "31.12."), ("12.4.-20.4.2026", "12.4."), ("29.2.2028.", "29.2.2028"), ("(1/2/26)", "1/2/26")])
def test_short_dates(spark, text, day):
    assert spark.range(1).select(hints.nearest(F.lit(text)).alias("n")).first()["n"]["day"] == day

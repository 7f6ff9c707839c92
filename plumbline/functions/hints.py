"""Dates of a page and what is said about them: two lists of places in a text, merged in one sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.dates import bound
from plumbline.functions.expiry import MONTH_WORDS, shape
from plumbline.functions.text import html_to_text
from plumbline.sources.landed import meta, page_title

# Phrases that name an end, and words of dates that are something else.
ENDS = ("gültig bis", "gueltig bis", "einlösbar bis", "einloesbar bis", "aktion bis", "angebot bis", "läuft bis", "laeuft bis", "nur bis", "endet am", "endet", "letzter tag", "valid until", "ends on", "expires")
OTHERS = ("aktualisiert", "stand", "zuletzt", "veröffentlicht", "veroeffentlicht", "reisezeitraum", "updated", "published", "posted")
#: Characters between a date and its phrase at most.
REACH = 60
# Days and months that the calendar has (29.2. in any year): a version 4.0. or a part of an address is no date.
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_DAY_MONTH = r"(?:(?:0?[1-9]|1\d|2\d){0}(?:0?[1-9]|1[0-2])|30{0}(?:0?[13-9]|1[0-2])|31{0}(?:0?[13578]|1[02]))"
_BARE = rf"{_DAY_MONTH.replace('{0}', '[.]')}(?!\.?\d)"
DATE = rf"(?=\d)(?<!\d)(?<!\d\.)(?:\d{{4}}-(?:0?[1-9]|1[0-2])-{_DAY}(?!\d)|{_DAY_MONTH.replace('{0}', '[./]')}[./](?:\d{{4}}|\d{{2}})(?!\.?\d)|{_DAY}\.?\s+(?:{'|'.join(w for ws in MONTH_WORDS for w in ws)})\b(?:\s+\d{{4}}\b)?|{_BARE}\.?)"
#: Ranks of what a page says of a date.
EXPLICIT, BROAD = 1, 2
EVIDENCE = {EXPLICIT: "explicit-phrase", BROAD: "broad-token"}

_FOUND = "struct<rank:int,distance:int,at:int,day:string,phrase:string>"
_STATE = f"struct<at:int,phrase_end:int,phrase:string,date_end:int,date_at:int,day:string,other:boolean,best:{_FOUND}>"


def _words(phrases: Sequence[str]) -> str:
    return rf"(?:{'|'.join(sorted((r'\s+'.join(p.split()) for p in phrases), key=lambda p: (-len(p), p)))})"


def nearest(text: Column, ends: Sequence[str] = ENDS, others: Sequence[str] = OTHERS, reach: int = REACH) -> Column:
    """The date in a text that stands nearest to a phrase for an end, in one sentence and at most `reach` characters away, as
    (rank, distance, at, day, phrase): the phrase may come before or after; a date that a word of `others` introduces is
    none. Of equally near ones the first counts. Without such a pair it is the first date, with rank BROAD, where 5.6 counts
    only with its second point or a year; without a date, or text, null. Each token is read once and moves a state of fixed
    size, so the work is linear in the text and its dates and phrases.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    phrase, other = rf"(?<!\p{{L}}){_words(ends)}(?!\p{{L}})", rf"(?<!\p{{L}}){_words(others)}(?!\p{{L}})"
    token = rf"(?s)({DATE}|{phrase}|{other}|\p{{L}}+|\d+|[^\p{{L}}\d.!?;\n]+|.)"
    null, none = F.lit(None).cast("int"), F.lit(None).cast("string")

    def found(rank: int, distance: Column, at: Column, day: Column, said: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), distance.alias("distance"), at.alias("at"), day.alias("day"), said.alias("phrase")).cast(_FOUND)

    def read(t: Column) -> Column:
        kind = F.when(t.rlike(r"^\d"), F.when(t.rlike(rf"^(?:{DATE})$"), F.when(t.rlike(rf"^{_BARE}$"), "bare").otherwise("date")).otherwise("")).when(t.isin(*".!?;\n"), "stop").when(t.rlike(rf"^{_words(ends)}$"), "phrase").when(t.rlike(rf"^{_words(others)}$"), "other").otherwise("")
        return F.struct(t.alias("t"), kind.alias("kind"))

    def step(s: Column, token: Column) -> Column:
        t, kind = token["t"], token["kind"]
        at, end = s["at"], s["at"] + F.char_length(t)
        is_date, is_phrase, is_other, stop = kind.isin("date", "bare"), kind == "phrase", kind == "other", kind == "stop"
        before = at - s["phrase_end"]
        after = at - s["date_end"]
        pair = (
            F.when(is_date & ~s["other"] & (before <= reach), found(EXPLICIT, before, at, t, s["phrase"]))
            .when(is_phrase & (after <= reach), found(EXPLICIT, after, s["date_at"], s["day"], t))
            .when(kind == "date", found(BROAD, null, at, t, none))
        )
        better = pair.isNotNull() & (s["best"].isNull() | (pair["rank"] < s["best"]["rank"]) | (pair["rank"] == EXPLICIT) & (s["best"]["rank"] == EXPLICIT) & (pair["distance"] < s["best"]["distance"]))
        # a date waits for a phrase after it, unless it has one or is another's
        open_date = is_date & ~s["other"]
        keep = lambda mark, new, old: F.when(stop, F.lit(None)).when(mark, new).otherwise(old)
        return F.struct(
            end.alias("at"),
            keep(is_phrase, end, s["phrase_end"]).cast("int").alias("phrase_end"),
            keep(is_phrase, t, s["phrase"]).cast("string").alias("phrase"),
            keep(open_date, end, s["date_end"]).cast("int").alias("date_end"),
            keep(open_date, at, s["date_at"]).cast("int").alias("date_at"),
            keep(open_date, t, s["day"]).cast("string").alias("day"),
            (~stop & ~is_phrase & (s["other"] | is_other) & ~is_date).alias("other"),
            F.when(better, pair).otherwise(s["best"]).alias("best"),
        ).cast(_STATE)

    zero = F.struct(F.lit(0).alias("at"), null.alias("phrase_end"), none.alias("phrase"), null.alias("date_end"), null.alias("date_at"), none.alias("day"), F.lit(False).alias("other"), F.lit(None).cast(_FOUND).alias("best")).cast(_STATE)
    return bound(low, lambda x: F.when(x.rlike(DATE), F.aggregate(F.transform(F.regexp_extract_all(x, F.lit(token), 1), read), zero, step)["best"]))


def page_dates(html: Column, today: Column) -> Column:
    """(evidence, zone, day, kind, phrase, distance) of a page: what its title and description say of a date, else its text.
    Evidence is explicit-phrase where a phrase for an end stands by the date, broad-token where a date stands alone, and null
    without one; an explicit date anywhere comes before a broad one. Kind is `end` with a phrase, else what the date's
    text alone says. A null page has nothing."""
    focus = F.concat_ws(". \n", F.nullif(meta(html, "og:title"), F.lit("")), F.nullif(page_title(html), F.lit("")), F.nullif(F.coalesce(F.nullif(meta(html, "og:description"), F.lit("")), meta(html, "description")), F.lit("")))

    def judged(two: Column) -> Column:
        first, rest = two["focus"], two["text"]
        use_text = first.isNull() | (first["rank"] == BROAD) & (rest["rank"] == EXPLICIT)
        best = F.when(use_text, rest).otherwise(first)

        def named(b: Column) -> Column:
            said = shape(b["day"], today)
            return F.struct(
                F.when(b["rank"] == EXPLICIT, EVIDENCE[EXPLICIT]).when(b["rank"] == BROAD, EVIDENCE[BROAD]).alias("evidence"),
                F.when(b.isNotNull(), F.when(use_text, "text").otherwise("head")).alias("zone"),
                F.coalesce(said["valid_on"], said["valid_until"]).alias("day"),
                F.when(b["rank"] == EXPLICIT, "end").when(b.isNotNull(), said["kind"]).alias("kind"),
                b["phrase"].alias("phrase"),
                b["distance"].alias("distance"),
            )

        return bound(best, named)

    return bound(F.struct(nearest(focus).alias("focus"), nearest(html_to_text(html)).alias("text")), judged)

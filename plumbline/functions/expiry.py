"""The validity that a text states, read by one tokeniser and one automaton over its tokens: each text is read once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.dates import ROLL_DAYS, bound, make_date, single_year
from plumbline.functions.text import collapse

# Month names, and the words that say how a date is meant.
MONTH_WORDS = (
    ("jänner", "januar", "janner", "january"), ("februar", "february"), ("märz", "maerz", "marz", "march"), ("april",), ("mai", "may"), ("juni", "june"),
    ("juli", "july"), ("august",), ("september",), ("oktober", "october"), ("november",), ("dezember", "december"),
)
WORDS = {
    "part": ("anfang", "mitte", "ende"),
    "end": ("bis", "endet", "deadline", "frist", "until"),
    "start": ("startet",),
    "from": ("ab",),
    "on": ("am",),
    "valid": ("gültig", "gueltig"),
    "ready": ("abholung", "verfügbar", "verfuegbar"),
    "opens": ("öffnet", "oeffnet"),
    "opening": ("eröffnung", "eroeffnung"),
    "only": ("nur", "only"),
    "today": ("heute", "today"),
    "tomorrow": ("morgen", "tomorrow"),
    "last": ("letzter",),
    "day": ("tag",),
    "every": ("jeden", "jede", "jedes", "every"),
    "weekday": ("montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag"),
    "again": ("wöchentlich", "woechentlich", "monatlich", "regelmäßig", "regelmaessig", "regelmässig", "tba", "variiert", "täglich"),
    "event": ("opening", "launch", "event", "veranstaltung", "konzert", "brunch", "verkostung", "tasting", "festival", "straßenfest", "strassenfest"),
}
# Texts that name no date, by how they begin and by what they hold.
VAGUE_START = r"^(?:siehe|unbekannt|dauerhaft|unbegrenzt|jederzeit|laufend|ongoing|k\.a\.?|tbd|coming soon|bei er(?:ö|oe)ffnung|regelm(?:ä|a|ae)(?:ß|ss)ig|immer|permanent\b|kurzfristig\b|laut quelle\b|nicht angegeben\b|gutschein[- ]?abh[aä]ngig\b|fr(?:ü|ue)hjahr\b|season opening\b)"
VAGUE_INSIDE = r"siehe (?:details|website|webseite|post|tiktok|instagram)|check website|not specified|unknown unknown|zeiten auf webseite|aktuelle termine|ganzt[aä]gig|solange (?:der )?vorrat reicht|\b(?:vormittag|nachmittag|abend|morgens|mittags|abends)\b"
SCHEDULE = r"^(?:mo|di|mi|do|fr|sa|so)\b"

#: Tokens: full dates, times, days with a month, numbers, dashes, words, and signs that end a phrase.
TOKEN = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4}|\d{1,2}:\d{2}|\d{1,2}[./]\d{1,2}(?!\d)\.?|\d+\.?|[-–—]|\p{L}+|[(;!?,\x01]"
#: What a token is: 1 to 12 month names; then the words by kind; then forms.
_KINDS = {name: 20 + i for i, name in enumerate(WORDS)}
FULL, SHORT, CLOCK, NUMBER, YEAR, DASH, SPLIT, OTHER = range(50, 58)
_CODES = {w: i for i, names in enumerate(MONTH_WORDS, 1) for w in names} | {w: _KINDS[name] for name, words in WORDS.items() for w in words}
#: What the words of a text say together.
SAYS = ("end", "clock_end", "start", "clock_start", "single", "event", "today", "tomorrow", "recurring", "schedule", "dated")
#: Ranks of what a phrase can be: of several, the least rank counts, then the first phrase.
RANGE, PART_OF_MONTH, DAY, DAY_OF_YEAR, MONTH, NOTHING = range(1, 7)

_PHRASE = "side int, p int, d1 int, m1 int, y1 int, d2 int, m2 int, y2 int, part int"
_STATE = f"struct<{', '.join(x.replace(' ', ':') for x in _PHRASE.split(', '))},phrase:int,rank:int,found:struct<phrase:int,d1:int,m1:int,y1:int,d2:int,m2:int,y2:int,part:int>,before:int,says:int,first:string,more:boolean,outside:boolean>"


def _read_token(word: Column) -> Column:
    """(c: what the token is, d, m, y: its numbers, w: the token)."""
    null = F.lit(None).cast("int")
    numbers = F.transform(F.regexp_extract_all(word, F.lit(r"(\d+)"), 1), lambda x: F.try_to_number(F.right(x, F.lit(9)), F.lit("999999999")).cast("int"))
    codes = F.create_map(*[F.lit(x) for item in _CODES.items() for x in item])

    def of(n: Column) -> Column:
        row = lambda c, d=null, m=null, y=null: F.struct(F.lit(c).cast("int").alias("c"), d.alias("d"), m.alias("m"), y.alias("y"), word.alias("w"))
        year = n[2] + F.when(n[2] < 100, 2000).otherwise(0)
        named = F.coalesce(F.try_element_at(codes, word), F.lit(OTHER))
        number = F.get(n, F.lit(0))
        return (
            F.when(word.rlike(r"^\d{4}-"), row(FULL, n[2], n[1], n[0]))
            .when(F.size(n) == 3, row(FULL, n[0], n[1], year))
            .when(word.contains(":"), row(CLOCK))
            .when(F.size(n) == 2, row(SHORT, n[0], n[1]))
            .when((F.size(n) == 1) & (F.char_length(word) == 4) & number.between(1900, 2199), row(YEAR, null, null, number))
            .when((F.size(n) == 1) & number.between(1, 31), row(NUMBER, number))
            .when(word.isin("-", "–", "—"), row(DASH))
            .when(word == "\x01", row(SPLIT))
            .otherwise(F.struct(named.cast("int").alias("c"), null.alias("d"), F.when(named <= 12, named).cast("int").alias("m"), null.alias("y"), word.alias("w")))
        )

    return bound(numbers, of)


def _step(s: Column, t: Column) -> Column:
    """The automaton's state after a token. A phrase has one side, or two about a dash; a side is 0 nothing, 1 a day, 2 a day
    and month, 3 a whole date, 4 a month, 5 a month and year."""
    c, k = t["c"], _KINDS
    is_month = c <= 12
    moved = (
        F.when((c == NUMBER) & s["p"].isin(0, 4), F.when(s["p"] == 0, 1).otherwise(2))
        .when(is_month & s["p"].isin(0, 1), F.when(s["p"] == 0, 4).otherwise(2))
        .when((c == YEAR) & s["p"].isin(2, 4), F.when(s["p"] == 2, 3).otherwise(5))
        .when((c == SHORT) & (s["p"] == 0), 2)
        .when((c == FULL) & (s["p"] == 0), 3)
    )
    dash = (c == DASH) & (s["side"] == 1) & s["p"].isin(1, 2, 3)
    begins = F.when(c == NUMBER, 1).when(is_month, 4).when(c == SHORT, 2).when(c == FULL, 3).otherwise(0)
    goes_on = moved.isNotNull() & ~s["outside"]
    side2 = goes_on & (s["side"] == 2)

    def part(name: str, n: int) -> Column:
        """A number of a side: the token's where it has one for this side, else as it was while the phrase goes on."""
        mine = side2 if n == 2 else goes_on & (s["side"] == 1)
        fresh = F.lit(None).cast("int") if n == 2 else t[name]
        return F.when(mine, F.coalesce(t[name], s[f"{name}{n}"])).when(goes_on | dash, s[f"{name}{n}"]).otherwise(fresh)

    phrase = s["phrase"] + F.when(goes_on | dash, 0).otherwise(1)
    p = F.when(dash, 0).when(goes_on, moved).otherwise(begins)
    side = F.when(dash, 2).when(goes_on, s["side"]).otherwise(1)
    part_of = F.when(goes_on & (s["side"] == 1), s["part"]).when(goes_on | dash, F.lit(0)).when(is_month & (s["before"] == k["part"]), s["part"]).otherwise(F.lit(0))
    part_of = F.when(c == k["part"], F.array_position(F.array(*map(F.lit, WORDS["part"])), t["w"])).otherwise(part_of).cast("int")
    new = F.struct(side.cast("int").alias("side"), p.cast("int").alias("p"), *[part(x, n).alias(f"{x}{n}") for n in (1, 2) for x in ("d", "m", "y")], part_of.alias("part"), phrase.alias("phrase"))

    def judged(x: Column) -> Column:
        rank = (
            F.when(s["outside"], NOTHING).when((x["side"] == 2) & x["p"].isin(2, 3), RANGE)
            .when((x["side"] == 2) | (x["p"] < 2), NOTHING).when((x["p"] == 5) & (x["part"] > 0), PART_OF_MONTH)
            .when(x["p"] == 3, DAY).when(x["p"] == 2, DAY_OF_YEAR).when(x["p"] == 5, MONTH).otherwise(NOTHING)
        )
        better = (rank < s["rank"]) | (rank < NOTHING) & (x["phrase"] == s["found"]["phrase"])
        found = F.struct(x["phrase"].alias("phrase"), *[x[f"{a}{n}"].alias(f"{a}{n}") for n in (1, 2) for a in ("d", "m", "y")], x["part"].alias("part"))
        explicit = c.isin(FULL, SHORT) & ~s["outside"]
        more = s["more"] | explicit & s["first"].isNotNull() & (s["first"] != t["w"])
        before = s["before"]
        # a sign between two words that belong together ends what they say; a dash and a bracket do not change what was before
        signals = {
            "end": (c == k["end"]) | (c == k["day"]) & (before == k["last"]),
            "clock_end": (c == CLOCK) & (before == k["end"]),
            "start": (c == k["start"]) | (c == k["from"]) & before.isin(k["valid"], k["ready"]) | (c == k["on"]) & (before == k["opens"]) | (c == k["opening"]) & (before == k["from"]),
            "clock_start": (c == CLOCK) & (before == k["from"]),
            "single": c.isin(k["today"], k["tomorrow"], k["weekday"]) | (c == k["on"]) & (before == k["valid"]) | c.isin(FULL, SHORT, NUMBER) & (before == k["on"]),
            "event": c.isin(k["event"], k["opening"]),
            "today": ((c == k["today"]) & (before == k["only"]) | (c == k["only"]) & (before == k["today"])) & ~s["outside"],
            "tomorrow": ((c == k["tomorrow"]) & (before == k["only"]) | (c == k["only"]) & (before == k["tomorrow"])) & ~s["outside"],
            "recurring": ((c == k["again"]) | (c == k["weekday"]) & (before == k["every"])) & ~s["outside"],
            "schedule": ((c == CLOCK) | (c == k["weekday"])) & ~s["outside"],
            "dated": explicit,
        }
        bits = sum((F.when(signals[name], 1 << i).otherwise(0) for i, name in enumerate(SAYS)), F.lit(0))
        return F.struct(
            *[x[a].alias(a) for a in ("side", "p", "d1", "m1", "y1", "d2", "m2", "y2", "part", "phrase")],
            F.least(rank, s["rank"]).cast("int").alias("rank"),
            F.when(better, found).otherwise(s["found"]).alias("found"),
            c.alias("before"),
            s["says"].bitwiseOR(bits).cast("int").alias("says"),
            F.when(explicit, F.coalesce(s["first"], t["w"])).otherwise(s["first"]).alias("first"),
            more.alias("more"),
            (s["outside"] | (c == SPLIT)).alias("outside"),
        ).cast(_STATE)

    return bound(new, judged)


def _folded(text: Column, context: Column) -> Column:
    """The last state over the text's tokens, then, for what words say only, over the context's."""
    null = F.lit(None).cast("int")
    found = F.struct(F.lit(-1).alias("phrase"), *[null.alias(f"{a}{n}") for n in (1, 2) for a in ("d", "m", "y")], F.lit(0).alias("part"))
    zero = F.struct(F.lit(1).alias("side"), F.lit(0).alias("p"), *[null.alias(f"{a}{n}") for n in (1, 2) for a in ("d", "m", "y")], F.lit(0).alias("part"), F.lit(0).alias("phrase"), F.lit(NOTHING).alias("rank"), found.alias("found"), F.lit(OTHER).alias("before"), F.lit(0).alias("says"), F.lit(None).cast("string").alias("first"), F.lit(False).alias("more"), F.lit(False).alias("outside")).cast(_STATE)
    tokens = F.regexp_extract_all(F.concat(text, F.lit("\x01"), context), F.lit(f"({TOKEN})"), 1)
    return F.aggregate(F.transform(tokens, _read_token), zero, _step)


def shape(value: Column, today: Column, context: Column | None = None) -> Column:
    """What kind of validity a text states: (kind, valid_on, valid_from, valid_until, confidence).

    Kinds are single, range, start, end, month, approx-range (the beginning, middle or end of a month), recurring and unknown.
    Spans may lack what their end says (12. to 15.3.2026, 28.12. to 3.1.2026); years that are not said are inferred from
    `today`. `context`, such as a title, adds what its words say, but no dates. Null and empty texts, and days that do not
    exist, are unknown. A text's tokens are folded once, however long it is.
    """
    own = F.lower(collapse(value))
    other = F.lower(collapse(context)) if context is not None else F.lit("")
    return bound(own, lambda text: bound(_folded(text, other), lambda s: _decided(text, s, today)))


def _decided(text: Column, s: Column, today: Column) -> Column:
    says = lambda name: s["says"].bitwiseAND(1 << SAYS.index(name)) > 0
    f, none, day = s["found"], F.lit(None).cast("date"), F.lit(1)

    def of(kind: str, confidence: str, on: Column = none, begin: Column = none, end: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), on.alias("valid_on"), begin.alias("valid_from"), end.alias("valid_until"), F.lit(confidence).alias("confidence"))

    # a span: its end has day and month, its beginning may lack the month, and either the year
    later_day = F.coalesce(f["m1"], f["m2"]) * 100 + f["d1"] > f["m2"] * 100 + f["d2"]
    begin_month = F.coalesce(f["m1"], F.when(f["d1"] > f["d2"], F.when(f["m2"] == 1, 12).otherwise(f["m2"] - 1)).otherwise(f["m2"]))
    over = (begin_month > f["m2"]) | f["y2"].isNotNull() & later_day & f["m1"].isNotNull()
    near = F.date_diff(make_date(F.year(today), begin_month, f["d1"]), today) <= ROLL_DAYS
    end_year = F.coalesce(f["y2"], F.year(today) + F.when(over & near, 1).otherwise(0))
    begin_year = F.coalesce(f["y1"], end_year - F.when(over, 1).otherwise(0))
    begin, end = make_date(begin_year, begin_month, f["d1"]), make_date(end_year, f["m2"], f["d2"])
    # a part of a month, a month, and one day
    month = make_date(f["y1"], f["m1"], day)
    from_day, to_day = F.element_at(F.array(*map(F.lit, (1, 10, 20))), f["part"]), F.element_at(F.array(*map(F.lit, (10, 20, 31))), f["part"])
    part = of("approx-range", "medium", begin=F.date_add(month, from_day - 1), end=F.least(F.date_add(month, to_day - 1), F.last_day(month)))
    one = make_date(F.coalesce(f["y1"], single_year(f["m1"], f["d1"], today)), f["m1"], f["d1"])
    single_date = s["first"].isNotNull() & ~s["more"]
    starts = ~says("end") & (says("start") | says("clock_start"))
    by_words = (
        F.when(one.isNull(), of("unknown", "low"))
        .when(starts, of("start", "high", begin=one))
        .when(single_date & says("clock_end"), of("single", "high", on=one))
        .when(says("end"), of("end", "high", end=one))
        .when(says("single") | single_date & says("event"), of("single", "medium", on=one))
        .when(single_date, of("end", "medium", end=one))
        .otherwise(of("end", "low", end=one))
    )
    undated = s["rank"] == NOTHING
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    vague = ~iso & (text.rlike(VAGUE_START) | text.rlike(VAGUE_INSIDE)) | text.rlike(r"^jeden\b") | undated & (says("schedule") | text.rlike(SCHEDULE))
    return (
        F.when(text == "", of("unknown", "low"))
        .when(says("today"), of("single", "high", on=today))
        .when(says("tomorrow"), of("single", "high", on=F.date_add(today, 1)))
        .when(vague | says("recurring"), of("recurring", "low"))
        .when((s["rank"] == RANGE) & begin.isNotNull() & end.isNotNull(), of("range", "high", begin=begin, end=end))
        .when((s["rank"] == PART_OF_MONTH) & month.isNotNull(), part)
        .when((s["rank"] == MONTH) & month.isNotNull(), of("month", "medium", begin=month, end=F.last_day(month)))
        .when(undated | s["rank"].isin(RANGE, PART_OF_MONTH, MONTH), of("unknown", "low"))
        .otherwise(by_words)
    )

"""Personal data: base rules, plus spans that high-recall generators propose and boosted trees select."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import bound, running
from plumbline.workspace import store

# Base patterns. Each starts only where the run of characters that it begins with starts, or where the last match
# ended; a match from inside such a run would end where the one from its start fails, so nothing is lost and each
# text is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans that begin together; only the generators know secrets.
KINDS = (*BASE_KINDS, "secret")
#: Generators: a kind, what a text must hold to be searched, and a wide pattern. They overlap the base rules and each other.
GENERATORS = (
    ("email", r"@|[(\[](?:at|AT)[)\]]", r"[A-Za-z0-9._%+-]++ ?(?:@|\((?:at|AT)\)|\[(?:at|AT)\]) ?[A-Za-z0-9-]++(?:(?:\.| \. | ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]) ?)[A-Za-z0-9-]++)*+"),
    ("phone", r"[0-9][0-9\x20()./-]{5}", r"[+(]?[0-9][0-9\x20()./-]{5,40}[0-9]"),
    ("ip", r"[0-9] ?[.(\[]", r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"[0-9]{4}[^0-9]{0,2}[0-9]", r"(?<![0-9])[0-9]{4}(?:[\x20._/–—-]{1,2}[0-9]{2,6}|[0-9]{2,6}){2,4}(?![0-9])"),
    ("secret", r"[:=].{0,4}[A-Za-z0-9_+/=-]{16}", r"[A-Za-z0-9_+/=-]{16,}+"),
)
#: Characters before a candidate that are read as its context.
CONTEXT = 24
NOT_CUES = r"(?i)(?:order|invoice|version|isbn|issn|issue|ticket|item|page|article|serial|section|chapter|doi|\bv|\bid|\bref)[^\p{L}]*$"
CUES = r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|write|reach)[^\p{L}]*$"
SECRET_CUES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth)[\"']?[\x20]{0,3}[:=][\x20]{0,3}[\"']?$"
#: Signs written out, as (pattern, sign): features are those of the mail address or number behind them.
WRITTEN_OUT = ((r" ?[(\[](?:at|AT)[)\]] ?", "@"), (r" ?[(\[](?:dot|DOT|\.)[)\]] ?| \. ", "."), (r" @ ", "@"))
MAIL = r"^[A-Za-z0-9._%+-]+@(?!www\.)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Grouped digits that are no phone number: dates, spans of years, versions and thousands, book numbers, digits in one run.
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:[12][0-9])?[0-9]{2}"
NOT_PHONES = (
    rf"^[12][0-9]{{3}}[-./]{_MONTH}[-./]{_DAY}(?![0-9])|^(?:{_DAY}[-./]{_MONTH}|{_MONTH}[-./]{_DAY})[-./]{_YEAR}(?![0-9])",
    r"^[12][0-9]{3} ?[-/] ?[12][0-9]{3}$",
    r"^[0-9]+(?:\.[0-9]{1,2})+(?:\.[0-9]+)*$|^[0-9]{1,3}(?:\.[0-9]{3})+$",
    r"^97[89][ -][0-9 -]+$",
    r"^[0-9]+$",
)
#: Positions of a candidate's features: 0 generator, 1 to 4 its form, 5 what it touches, 6 cue, 7 and 8 sizes of the last
#: two groups of digits, 9 whether the form alone could be something else.
N_FEATURES, CUE, BARE = 10, 6, 9
#: Boosting: trees, their step, and the precision that a threshold must reach on labelled candidates held out from the trees.
TREES, DEPTH, STEP, PRECISION, BAND, LEAST = 40, 3, 0.4, 0.98, 0.9, 20
def spans(text: str, pattern: str, likely: str) -> Column:
    """Leftmost, non-overlapping matches in the column `text`, if `likely` is found, as an array of (start, end, s, before,
    after): code points, end exclusive, and the texts up to the match before and after. Linear in the text and, but for
    blocks, in its matches."""
    n = "size(p.found)"
    ends = running("zip_with(p.found, slice(p.gaps, 1, size(p.found)), (s, g) -> char_length(s) + char_length(g))", "{a} + {b}", 0, "r")
    around = f"zip_with(slice(p.gaps, 1, {n}), slice(p.gaps, 2, {n}), (x, y) -> named_struct('before', x, 'after', y))"
    matches = f"zip_with(p.found, {ends}, (s, e) -> named_struct('s', s, 'end', e))"
    placed = f"zip_with({matches}, {around}, (m, w) -> named_struct('start', m.end - char_length(m.s), 'end', m.end, 's', m.s, 'before', w.before, 'after', w.after))"
    found = bound(placed, "p", found=f"regexp_extract_all({text}, r'{pattern}', 0)", gaps=f"split({text}, r'{pattern}', -1)")
    return F.expr(f"CASE WHEN {text} RLIKE r'{likely}' THEN {found} ELSE cast(array() AS {NO_MATCHES}) END")


NO_MATCHES = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check: from the right, each second one is doubled, less 9 above 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _as_span(place: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: str) -> Column:
    """All base spans of the column `text` in order of start, then kind: array of (start, ord, end, kind)."""
    n = lambda m: F.char_length(_digits(m["s"]))
    rules = (
        ("email", "@", EMAIL, None),
        ("ip", r"[0-9]\.[0-9]", IP, lambda m: m["s"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        ("card", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", CARD, lambda m: n(m).between(14, 19) & _luhn(_digits(m["s"]))),
        ("phone", r"\+[0-9]", PHONE, lambda m: n(m).between(10, 15)),
    )
    parts = []
    for i, (kind, likely, pattern, test) in enumerate(rules):
        found = spans(text, pattern, likely)
        parts.append(F.transform(F.filter(found, test) if test else found, _as_span(i, kind)))
    return F.sort_array(F.concat(*parts))


def _bin(x: Column, *bounds: int) -> Column:
    return sum(((x > b).cast("int") for b in bounds), F.lit(0))


def _flags(s: Column, *signs: str) -> Column:
    return sum((s.contains(sign).cast("int") * 2**i for i, sign in enumerate(signs)), F.lit(0))


def _plain(s: Column) -> Column:
    for pattern, sign in WRITTEN_OUT:
        s = F.regexp_replace(s, pattern, sign)
    return s


def _mail(s: Column) -> tuple[list[Column], Column, Column]:
    plain, mention = _plain(s), s.rlike(" @[^ ]|[^ ]@ ")
    whole = plain.rlike(MAIL)
    return [whole.cast("int"), _bin(F.size(F.split(plain, r"\.")), 1, 2), mention.cast("int"), plain.contains("@www.").cast("int")], ~whole | mention, F.lit(0)


def _phone(s: Column) -> tuple[list[Column], Column, Column]:
    # a leading 00 stands for the plus sign, and neither counts: what the base rules miss looks like what they find
    bare = (~s.rlike(r"^\+|^00[1-9]|^\(?[0-9 ]{0,3}\(?[0-9]{2,4}\)")).cast("int")
    plain = F.regexp_replace(s, "^00(?=[1-9])", "+")
    n = F.char_length(_digits(plain))
    other = ~n.between(7, 15)
    for pattern in NOT_PHONES:
        other = other | plain.rlike(pattern)
    parts = F.split(F.regexp_replace(plain, r"^[^0-9]+|[^0-9]+$", ""), r"[^0-9]+")
    return [_bin(n, 0, 6, 9, 12, 13, 15, 19), _bin(F.size(parts), 1, 2, 3, 4, 5), _flags(F.regexp_extract(plain, r"([^0-9]+)[0-9]+$", 1), " ", "-", "."), _flags(plain, "/")], other, bare


def _ip(s: Column) -> tuple[list[Column], Column, Column]:
    plain = _plain(s)
    valid = plain.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    small = plain.rlike(r"^[0-9](?:\.[0-9]{1,2}){3}$")
    return [valid.cast("int"), small.cast("int"), plain.rlike(r"(?:^|\.)0[0-9]").cast("int"), F.lit(0)], ~valid | small, F.lit(0)


def _card(s: Column) -> tuple[list[Column], Column, Column]:
    digits = _digits(s)
    n = F.char_length(digits)
    passes = n.between(14, 19) & _luhn(digits)
    grouped = s.rlike(r"^[0-9]{4}(?:([^0-9]{0,2})[0-9]{4}){3}$|^[0-9]{4}([^0-9]{0,2})[0-9]{6}([^0-9]{0,2})[0-9]{4,5}$")
    return [passes.cast("int"), _bin(n, 13, 14, 15, 16, 18), grouped.cast("int"), F.lit(0)], ~passes, (~grouped).cast("int")


def _secret(s: Column) -> tuple[list[Column], Column, Column]:
    digits = F.char_length(_digits(s))
    n = F.char_length(s)
    kinds = s.rlike("[a-z]").cast("int") + s.rlike("[A-Z]").cast("int") + s.rlike("[0-9]").cast("int")
    word = (digits * 16 < n) | s.rlike(r"^[0-9/=_+-]+$|[_=+/-]{4}") | (kinds < 2)
    return [_bin(n, 19, 31, 47, 63), kinds, s.rlike("^[0-9a-fA-F]+$").cast("int"), F.lit(0)], word, F.lit(1)


FORMS = (_mail, _phone, _ip, _card, _secret)


def described(generator: int, s: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """The features of a candidate of this generator, and whether form or context say that it is not personal. The features
    of a written-out form are those of the plain one."""
    own, other, bare = FORMS[generator](s)
    before = F.substring(before, -CONTEXT, CONTEXT)
    digits = generator == 1
    size = lambda i: _bin(F.char_length(F.regexp_extract(s, r"([0-9]+)[^0-9]+([0-9]+)$", i)), 0, 1, 2, 3, 4) if digits else F.lit(0)
    no_cue = before.rlike(NOT_CUES) if digits or generator == 2 else F.lit(False)
    inside = before.rlike(r"[A-Za-z0-9=\"'.,:-]$").cast("int") + 2 * F.substring(after, 1, 1).rlike(r"^[A-Za-z0-9\"']").cast("int")
    cue = before.rlike(SECRET_CUES if generator == 4 else CUES)
    f = F.array(F.lit(generator), *own, F.lit(0) if generator == 4 else inside, F.when(cue, 1).when(no_cue, 2).otherwise(0), size(1), size(2), bare)
    return f, other | no_cue | (~cue if generator == 4 else F.lit(False))


def candidates(matches: list[str], plant: str, base: str) -> Column:
    """What the generators propose, by start: array of (start, end, ord, known, other, f). `matches` are the columns of the
    generators' spans. `known`: overlaps a base span; `other`: does not, and has a form or context that is known not to
    be personal; `f`: format and context features. The first ones are the planted decoy (start and end -2), which is `other`,
    and the planted candidate (-1), which is known."""

    def of(generator: int, kind: str):
        def one(m: Column) -> Column:
            f, other = described(generator, m["s"], m["before"], m["after"])
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("ord"), other.alias("other"), f.alias("f"))

        return one

    mine = lambda g: F.expr(f"transform(filter({plant}, p -> p.g = {g}), p -> named_struct('start', p.at, 'end', p.at, 's', p.s, 'before', p.before, 'after', p.after))")
    parts = [F.transform(F.concat(mine(g), m), of(g, kind)) for g, ((kind, _, _), m) in enumerate(zip(GENERATORS, matches))]
    return F.sort_array(F.concat(*parts))


def _held_against(cands: str, base: str) -> Column:
    """Whether candidates overlap base spans (both by start), in one sweep: does the farthest end of the base spans that
    begin no later reach into a candidate, or does the next one begin inside it?"""
    far = 2**31 - 1
    row = lambda side: f"x -> named_struct('start', x.start, 'side', {side}, 'end', x.end)"
    ends = running("transform(m.every, x -> if(x.side = 0, x.end, 0))", "greatest({a}, {b})", 0, "r")
    nexts = running(f"reverse(transform(m.every, x -> if(x.side = 0, x.start, {far})))", "least({a}, {b})", far, "q")
    reach = f"zip_with({ends}, reverse({nexts}), (e, n) -> named_struct('e', e, 'n', n))"
    held = f"filter(zip_with(m.every, {reach}, (x, r) -> named_struct('side', x.side, 'known', r.e > x.start OR r.n < x.end)), x -> x.side = 1)"
    swept = f"zip_with(m.c, {held}, (c, h) -> named_struct('start', c.start, 'end', c.end, 'ord', c.ord, 'known', c.start = -1 OR c.start >= 0 AND h.known, 'other', c.start = -2 OR c.start >= 0 AND NOT h.known AND c.other, 'f', c.f))"
    every = f"array_sort(concat(transform(v.b, {row(0)}), transform(v.c, {row(1)})))"
    return F.expr(bound(bound(swept, "m", every=every, c="v.c"), "v", c=cands, b=base))


def planted(text: Column) -> Column:
    """Two synthetic candidates for each text, each set into a place of the text: (g, at, s, before, after). One is personal
    (at -1), one is a lookalike that is not (at -2). Their generators and forms go by the text's hash. Forms that could be
    something else stand behind a cue, as in life."""
    draw = lambda i: F.xxhash64(text, F.lit(i))
    number = lambda i, n: F.lpad(F.pmod(draw(i), F.lit(10**n)).cast("string"), n, "0")
    octet = lambda i: F.pmod(draw(i), F.lit(256)).cast("string")
    word = lambda i: F.translate(F.substring(F.sha2(draw(i).cast("string").cast("binary"), 256), 1, 7), "0123456789", "ghijklmnop")
    stem = F.concat(F.lit("4"), number(1, 14))
    card = F.concat(stem, F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(stem, d.cast("string")))), F.lit(0)).cast("string"))
    quarters = lambda sign: F.concat_ws(sign, *[F.substring(card, at, 4) for at in (1, 5, 9, 13)])
    digest = F.sha2(draw(2).cast("string").cast("binary"), 256)
    call, key, none = "call ", 'token = "', ""
    forms = (
        (0, none, F.concat(word(1), F.lit("."), word(2), F.lit(" (at) "), word(3), F.lit(".example (dot) com"))),
        (0, none, F.concat(word(1), F.lit("[at]"), word(3), F.lit("[dot]org"))),
        (1, none, F.concat(F.lit("1 ("), number(3, 3), F.lit(") "), number(4, 3), F.lit("-"), number(5, 4))),
        (1, none, F.concat(F.lit("("), number(3, 3), F.lit(") "), number(4, 3), F.lit("-"), number(5, 4))),
        (1, none, F.concat(F.lit("0043 660 "), number(3, 7))),
        (1, none, F.concat(F.lit("0049 "), number(4, 3), F.lit(" "), number(3, 7))),
        (1, call, F.concat(F.lit("0660 1"), number(3, 6))),
        (1, call, F.concat(F.lit("01/"), number(3, 7))),
        (1, call, F.concat(number(3, 3), F.lit("-"), number(4, 3), F.lit("-"), number(5, 4))),
        (2, none, F.concat_ws("[.]", F.lit("203"), *map(octet, (3, 4, 5)))),
        (2, none, F.concat_ws(" . ", F.lit("198"), *map(octet, (3, 4, 5)))),
        (3, none, quarters(".")),
        (3, none, quarters("  ")),
        (4, key, F.substring(digest, 1, 40)),
        (4, key, F.substring(digest, 1, 32)),
        (4, key, F.regexp_replace(F.base64(F.unhex(digest)), "=", "")),
        (4, "password: ", F.substring(F.base64(F.unhex(digest)), 1, 20)),
        (4, key, digest),
    )
    failing = F.concat(stem, F.pmod(F.substring(card, 16, 1).cast("int") + 1 + F.pmod(draw(9), F.lit(9)), F.lit(10)).cast("string"))
    groups = lambda sign, *sizes: F.concat_ws(sign, *[number(20 + i, n) for i, n in enumerate(sizes)])
    day = F.concat_ws("-", F.lit("2024"), *[F.lpad((F.pmod(draw(i), F.lit(12)) + 1).cast("string"), 2, "0") for i in (30, 31)])
    decoys = (
        (0, "met ", F.concat(F.lit("us (at) "), word(1))),
        (0, "follow ", F.concat(F.lit("all @"), word(2), F.lit(".example"))),
        (1, "order no. ", groups("-", 3, 3, 4)),
        (1, "order ", F.concat(F.lit("("), number(3, 3), F.lit(") "), groups("-", 3, 4))),
        (1, "ticket ", F.concat(F.lit("0049 "), groups(" ", 3, 7))),
        (1, none, F.concat(day, F.lit(" "), number(4, 2))),
        (1, none, groups(" ", 2, 2, 2, 2)),
        (1, none, groups(".", 3, 3, 3)),
        (1, "ISBN ", F.concat(F.lit("978-3-"), groups("-", 4, 3, 1))),
        (1, none, number(3, 9)),
        (2, "version ", F.concat_ws("[.]", F.lit("203"), *map(octet, (3, 4, 5)))),
        (2, "section ", F.concat_ws(".", F.lit("10"), *map(octet, (3, 4, 5)))),
        (2, none, groups(".", 1, 1, 2, 1)),
        (3, none, F.concat_ws(".", *[F.substring(failing, at, 4) for at in (1, 5, 9, 13)])),
        (3, none, F.concat_ws("  ", *[F.substring(failing, at, 4) for at in (1, 5, 9, 13)])),
        (3, none, groups("-", 4, 3, 5)),
        (4, "commit = ", F.substring(digest, 1, 40)),
        (4, "sha256: ", digest),
        (4, 'id: "', F.substring(digest, 1, 32)),
        (4, 'etag = "', F.regexp_replace(F.base64(F.unhex(digest)), "=", "")),
        (4, key, F.translate(F.substring(digest, 1, 24), "0123456789", "ghijklmnop")),
        (4, key, F.translate(F.substring(digest, 1, 48), "0123456789", "ghijklmnop")),
        (4, key, F.rpad(F.lit(""), 24, "_-=")),
    )
    n = F.char_length(text)
    after = F.array(*map(F.lit, (" ", ". ", ", ", ")", '"')))

    def drawn(at: int, forms: tuple, seed: int) -> Column:
        context = F.rtrim(F.substring(text, F.pmod(draw(seed), F.greatest(n.cast("long"), F.lit(1))).cast("int") + 1, F.lit(CONTEXT)))
        one = F.get(F.array(*[F.struct(F.lit(g).alias("g"), x.alias("s"), F.lit(cue).alias("cue")) for g, cue, x in forms]), F.pmod(draw(seed + 6), F.lit(len(forms))).cast("int"))
        return F.struct(one["g"].alias("g"), F.lit(at).alias("at"), one["s"].alias("s"), F.concat(context, F.lit(" "), one["cue"]).alias("before"), F.get(after, F.pmod(draw(seed + 8), F.lit(5)).cast("int")).alias("after"))

    return F.array(drawn(-2, decoys, 50), drawn(-1, forms, 0))


Pattern = tuple[tuple[int, ...], int, int]


def boost(patterns: list[Pattern], trees: int = TREES, step: float = STEP) -> list:
    """Gradient-boosted trees of depth DEPTH, on logistic loss, over (features, n, n_positive).

    Returns a bias and trees; a tree is (feature, most, left, right), where left and right are a value or such a tree.
    """
    n, good = sum(p[1] for p in patterns), sum(p[2] for p in patterns)
    bias = math.log((good + 0.5) / (n - good + 0.5))
    score = [bias] * len(patterns)

    def grow(rows: list[int], slope: list[float], bend: list[float], depth: int):
        gain = lambda g, h: g * g / (h + 1)
        g, h = sum(slope[i] for i in rows), sum(bend[i] for i in rows)
        best = (gain(g, h) + 1e-9, None, None)
        for f in range(N_FEATURES) if depth else ():
            sums: dict[int, list[float]] = {}
            for i in rows:
                cell = sums.setdefault(patterns[i][0][f], [0.0, 0.0])
                cell[0], cell[1] = cell[0] + slope[i], cell[1] + bend[i]
            low_g = low_h = 0.0
            for most in sorted(sums)[:-1]:
                low_g, low_h = low_g + sums[most][0], low_h + sums[most][1]
                if (found := gain(low_g, low_h) + gain(g - low_g, h - low_h)) > best[0]:
                    best = (found, f, most)
        _, f, most = best
        if f is None:
            return step * g / (h + 1)
        return f, most, grow([i for i in rows if patterns[i][0][f] <= most], slope, bend, depth - 1), grow([i for i in rows if patterns[i][0][f] > most], slope, bend, depth - 1)

    grown: list = []
    for _ in range(trees if patterns and 0 < good < n else 0):
        odds = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(list(range(len(patterns))), [p[2] - p[1] * q for p, q in zip(patterns, odds)], [p[1] * q * (1 - q) for p, q in zip(patterns, odds)], DEPTH)
        grown.append(tree)
        score = [s + predict(tree, p[0]) for s, p in zip(score, patterns)]
    return [bias, *grown]


def predict(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def score_of(model: list, features: tuple[int, ...]) -> float:
    return round(sum((predict(t, features) for t in model[1:]), model[0]), 9)


def threshold(model: list, patterns: list[Pattern], precision: float = PRECISION, least: int = LEAST) -> float:
    """The least score such that, of all labelled candidates scored as high or higher, `precision` are known to be personal
    data, with `least` of them known at least; infinite if there is none. Scores are passed from the highest in bands of
    `least` candidates or more, and none is passed of which less than BAND is known: good ones above don't carry it."""
    by_score: dict[float, list[int]] = {}
    for f, n, good in patterns:
        row = by_score.setdefault(score_of(model, f), [0, 0])
        row[0], row[1] = row[0] + n, row[1] + good
    all_n = all_good = band_n = band_good = 0
    chosen = math.inf
    for score in sorted(by_score, reverse=True):
        n, good = by_score[score]
        all_n, all_good, band_n, band_good = all_n + n, all_good + good, band_n + n, band_good + good
        if band_n < least:
            continue
        if band_good < BAND * band_n:
            break
        band_n = band_good = 0
        if all_good >= least and all_good >= precision * all_n:
            chosen = score
    return chosen


def accepted(fitting: list[Pattern], held_out: list[Pattern], every: list[tuple[int, ...]], least: int = LEAST) -> list[tuple[int, ...]]:
    """Those of the patterns `every` that score as high as the threshold.

    fitting and held_out are (features, n, n_positive) of labelled candidates, of two halves of the texts: the trees are
    fitted on one, the threshold is calibrated on the other. What the base rules miss is no negative, and takes nothing
    from the precision, however much of it there is.
    """
    model = boost(fitting)
    limit = threshold(model, held_out, least=max(1, least // 2))
    return [f for f in every if score_of(model, f) >= limit]


def _code(f):
    return sum(f[i] * 16**i for i in range(N_FEATURES))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, all_spans.

    Base spans always stay. Generators propose further spans of the base kinds in forms that no base rule takes, and
    secrets (long tokens behind a word for them). Boosted trees learn to select from labels of three sources: candidates
    that a base rule confirms; synthetic ones in the missed forms, one planted into a place of each text; and, as
    negatives, lookalikes planted likewise (order numbers, dates, versions, failed Luhn, hashes) and candidates in forms and
    contexts that are seldom personal. The rest is unlabelled. Half of the texts fit the trees, the other half calibrates
    the threshold, which alone decides: a candidate that scores as high is added, whatever its label, if it overlaps no
    base span and no added one that begins before.
    all_spans is an array of (start, ord, end, kind); spans joins it as kind:start:end.

    A null or empty text has no spans (the digest is that of the empty string); null keys and repeated rows are treated
    like others; no rows give no rows; other columns are not read. The texts are read once, without a shuffle; a text's
    work is linear in its length and matches. Counts of features (a few thousand patterns at most) reach the driver.
    """
    whole = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    matches = [spans("_t", pattern, likely).alias(f"_m{g}") for g, (_, likely, pattern) in enumerate(GENERATORS)]
    half = F.pmod(F.xxhash64("_t", F.lit(7)), F.lit(2)).cast("int").alias("half")
    read = whole.select(key, base_spans("_t").alias("base"), *matches, planted(F.col("_t")).alias("_p"), half)
    proposed = read.select(key, "base", candidates([f"_m{g}" for g in range(len(GENERATORS))], "_p", "base").alias("_c"), "half")
    found = store(proposed.select(key, "base", _held_against("_c", "base").alias("cands"), "half"), "pii")
    total = lambda c: F.sum(F.col(f"c.{c}").cast("long")).alias(c)
    counted = found.select("half", F.explode("cands").alias("c")).groupBy("half", "c.f").agg(total("known"), total("other"), F.count_if((F.col("c.start") >= 0) & ~F.col("c.known")).alias("open")).collect()
    known = lambda h: sorted((tuple(r["f"]), r["known"] + r["other"], r["known"]) for r in counted if r["half"] == h and r["known"] + r["other"])
    open_ones = sorted({tuple(r["f"]) for r in counted if r["open"]})
    codes = [_code(f) for f in accepted(known(0), known(1), open_ones)]
    added = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    if codes:
        picked = F.filter("cands", lambda c: (c["start"] >= 0) & ~c["known"] & _code([c["f"][i].cast("long") for i in range(N_FEATURES)]).isin(codes))
        names = F.array(*map(F.lit, KINDS))
        added = F.sort_array(F.transform(picked, lambda c: F.struct(c["start"], c["ord"], c["end"], F.get(names, c["ord"]).alias("kind"))))
    before = running("transform(v.a, x -> x.end)", "greatest({a}, {b})", 0, "r")
    apart = bound(f"transform(filter(zip_with(v.a, concat(array(0), slice({before}, 1, greatest(size(v.a) - 1, 0))), (x, e) -> named_struct('s', x, 'free', x.start >= e)), x -> x.free), x -> x.s)", "v", a="_added")
    every = found.withColumn("_added", added).withColumn("all_spans", F.sort_array(F.concat("base", F.expr(apart) if codes else "_added")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE_KINDS]
    return every.select(key, *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), "all_spans")

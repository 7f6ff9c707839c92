"""Cleaning, keys and extraction on text. A null text counts as empty throughout."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and word characters as the source's patterns know them (Java's \s and \b are ASCII only).
WS = r"[\x09-\x0d \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Words that come from page furniture, in the order in which they go.
UI_WORDS = ("alle anzeigen", "kategorien", "app", "ap")
# A word that the source misspells, and the word meant.
MISSPELT, MEANT = "Bestellunge", "Bestellung"
# Letters with marks and the plain letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīłńňőřśšşťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegilnnorssstuuuzzz"
# Account names that are pages of the site itself.
RESERVED_HANDLES = ("p", "reel", "reels", "explore", "accounts", "stories", "tv")


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def collapse(value: Column) -> Column:
    """Single spaces, trimmed."""
    return F.trim(F.regexp_replace(text_of(value), f"{WS}+", " "))


def bounded(value: Column, most: int) -> Column:
    return F.substring(collapse(value), 1, most)


def clean_text(value: Column) -> Column:
    """Tags become spaces, three character references are decoded, white space collapses."""
    bare = F.regexp_replace(text_of(value), "<[^>]*>", " ")
    for name, sign in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return collapse(bare)


def clean_ui_noise(value: Column) -> Column:
    """clean_text without page-furniture words, starred runs and outer punctuation."""
    text = F.regexp_replace(clean_text(value), rf"(?i)\b(?:{'|'.join(UI_WORDS)})\b", " ")
    text = F.regexp_replace(F.regexp_replace(text, rf"(?i)\b{MISSPELT}\b", MEANT), r"\*{3,}", " ")
    return F.trim(F.regexp_replace(collapse(text), r"^[,:\-–\s]+|[,:\-–\s]+$", ""))


def normalized_words(value: Column) -> Column:
    """Lower-case letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(clean_ui_noise(value)), r"[^\p{L}\p{N}]+", " "))


def fold(value: Column) -> Column:
    """Lower case, marks off Latin letters."""
    return F.translate(F.lower(clean_ui_noise(value)), MARKED, PLAIN)


def brand_key(value: Column) -> Column:
    return F.regexp_replace(fold(value), "[^a-z0-9]+", "")


def slug(value: Column, most: int = 60) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(fold(value), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def handle(value: Column) -> Column:
    """An account name without @, in lower case; empty if it is none."""
    name = F.lower(F.regexp_replace(collapse(value), "^@", ""))
    return F.when(name.rlike("^[a-z0-9._]{2,40}$") & ~name.isin(*RESERVED_HANDLES), name).otherwise("")


def html_to_text(value: Column) -> Column:
    return clean_text(F.regexp_replace(F.regexp_replace(text_of(value), r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "))


def truncate_words(value: Column, most: int = 112, least: int = 105) -> Column:
    """The text if it has at most `most` characters, else its first `least` at most, cut before a space, with an ellipsis."""
    text = collapse(value)
    head = F.regexp_extract(text, rf"^(.{{0,{least}}}) ", 1)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.when(head != "", head).otherwise(F.substring(text, 1, least)), F.lit("…")))


def amount(value: Column, pattern: str) -> Column:
    """The first number that the pattern's first group finds, with comma or point decimals."""
    return F.try_to_number(F.nullif(F.replace(F.regexp_extract(text_of(value), pattern, 1), F.lit(","), F.lit(".")), F.lit("")), F.lit("9999999999.99")).cast("double")


def price(value: Column) -> Column:
    return amount(value, r"([0-9]{1,6}(?:[.,][0-9]{1,2})?) ?(?:€|EUR|Euro)")


def percent(value: Column) -> Column:
    return amount(value, r"([0-9]{1,3}) ?%")


def district(value: Column) -> Column:
    """The district that a Vienna postcode names."""
    code = F.regexp_extract(text_of(value), r"(?:^|[^0-9])1([0-9]{2})0(?:[^0-9]|$)", 1)
    return F.when((code != "") & F.nullif(code, F.lit("")).cast("int").between(1, 23), F.concat(F.nullif(code, F.lit("")).cast("int").cast("string"), F.lit(". Bezirk"))).otherwise("")


def tokens(value: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of at least `least` characters that are not stop words."""
    return F.array_distinct(F.filter(F.split(normalized_words(value), " "), lambda w: (F.char_length(w) >= least) & ~w.isin(*stop) if stop else F.char_length(w) >= least))


def overlap(words: Column, text: Column) -> Column:
    """How many of the words stand in the text."""
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def keyword_hits(value: Column, keywords: list[str]) -> Column:
    text = F.lower(text_of(value))
    return sum((text.contains(k).cast("int") for k in keywords), F.lit(0))


def distinct_ci(values: Column, most: int) -> Column:
    """The first spelling of each value, whatever its case, in order, `most` at most."""
    def add(seen: Column, v: Column) -> Column:
        return F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(v)) | (v == ""), seen).otherwise(F.concat(seen, F.array(v)))

    return F.slice(F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<string>"), add), 1, most)


def repair_mojibake(value: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, read again, where that leaves fewer tell-tale letters."""
    text, marks = text_of(value), "[ÃÂâð]"
    again = F.try_validate_utf8(F.decode(F.encode(text, "ISO-8859-1"), "UTF-8"))
    return F.when(text.rlike(marks) & text.rlike(r"^[\x00-\xff]*$") & (F.regexp_count(again, F.lit(marks)) < F.regexp_count(text, F.lit(marks))), again).otherwise(text)


def caption(value: Column) -> Column:
    """A post's caption without the 'N likes, M comments - user on date:' around it."""
    return F.regexp_replace(F.regexp_replace(collapse(value), r"(?i)^[0-9.,]+ likes?, [0-9.,]+ comments? - [a-z0-9._]+ on [^:]+: *", ""), '^"|"[.]?$', "")


@F.pandas_udf(StringType())
def decode_references(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All named and numeric character references; Spark has no built-in for them."""
    for batch in values:
        yield batch.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def decomposed(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition (NFKD); Spark has no built-in for it."""
    for batch in values:
        yield batch.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def signal(value: Column) -> Column:
    """Text as date rules read it: decomposed, without marks, with plain dashes and single spaces, in lower case."""
    plain = F.regexp_replace(decomposed(text_of(value)), r"[\u0300-\u036f]", "")
    return F.lower(collapse(F.regexp_replace(F.regexp_replace(plain, "\u00df", "ss"), r"[\u2010-\u2015\u2212]", "-")))


def repair_surrogates(payload: Column) -> Column:
    """JSON text in which escapes of half a character, which parsers turn into question marks, stand for U+FFFD.

    Escaped pairs and escaped backslashes stay. One pass from match to match, possessive, so long payloads take neither
    stack nor backtracking.
    """
    hexes, high, low = "[0-9a-fA-F]{2}", r"\\u[dD][89abAB]", r"\\u[dD][c-fC-F]"
    whole = rf"[^\\]++|\\[^u]|\\u(?![dD][89a-fA-F]{hexes})|{high}{hexes}{low}{hexes}"
    return F.regexp_replace(text_of(payload), rf"(?s)\G((?:{whole})*+)\\u[dD][89a-fA-F]{hexes}", r"$1\\ufffd")


def cut_graphemes(value: Column, most: int) -> Column:
    """The longest start of the text that has at most `most` code points and ends where a grapheme cluster ends.

    Clusters are those of the JVM's `\\X`. Where a cluster ends depends on what stands before and on the next code point
    alone, so one code point more than `most` is read, and the last cluster of these goes. A first cluster longer than `most` leaves
    an empty text.
    """
    text = text_of(value)
    clusters = F.regexp_extract_all(F.substring(text, 1, most + 1), F.lit(r"\X"), F.lit(0))
    return F.when(F.char_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.lit(most + 1) - F.char_length(F.element_at(clusters, -1))))

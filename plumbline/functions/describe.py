"""Short texts about a record: summaries, titles, descriptions, owners and links. Vocabularies and patterns are arguments."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import collapse, text_of


def summary(value: Column, most: int, sentences: int = 2) -> Column:
    """The first `sentences` sentences that fit in `most` code points together; the first one cut at a word if none fits."""
    parts = F.filter(F.transform(F.split(text_of(value), r"(?<=[.!?])\s+"), collapse), lambda s: s != "")
    first = F.slice(parts, 1, sentences)
    fitting = F.aggregate(first, F.lit(""), lambda acc, s: F.when(F.char_length(acc) + F.char_length(s) + 1 <= most, F.when(acc == "", s).otherwise(F.concat(acc, F.lit(" "), s))).otherwise(acc))
    cut = F.regexp_replace(F.substring(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), 1, most), r"\s+\S*$", "")
    return F.when(fitting != "", fitting).otherwise(cut)


def without_echoes(value: Column, echoes: Sequence[Column], meta: Sequence[str], sign: str = "|") -> Column:
    """A description without the parts (between signs) that repeat an echo, or whose words are all metadata."""
    words = lambda p: F.filter(F.split(F.lower(p), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = F.array(*[F.lower(collapse(e)) for e in echoes]) if echoes else F.array().cast("array<string>")
    listed = F.array(*[F.lit(m) for m in meta]) if meta else F.array().cast("array<string>")
    parts = F.transform(F.split(text_of(value), re.escape(sign)), collapse)
    kept = F.filter(parts, lambda p: (p != "") & ~F.array_contains(known, F.lower(p)) & ~F.forall(words(p), lambda w: F.array_contains(listed, w)))
    return F.array_join(kept, f" {sign} ")


def fallback_description(kind: Column, parts: Mapping[str, Sequence[Column]], default: Sequence[Column], sign: str = " • ") -> Column:
    """What there is to say by kind: its parts that are not empty, joined."""
    joined = lambda cs: F.array_join(F.filter(F.array(*[collapse(c) for c in cs]), lambda p: p != ""), sign)
    return F.coalesce(*[F.when(kind == k, joined(cs)) for k, cs in parts.items()], joined(default))


def without_brand(value: Column, brand: Column) -> Column:
    """The text without mentions of the brand and the signs that this leaves at its ends. The brand is taken literally."""
    bare = F.when(F.length(text_of(brand)) > 0, F.replace(F.lower(text_of(value)), F.lower(text_of(brand)), F.lit(""))).otherwise(F.lower(text_of(value)))
    return F.regexp_replace(collapse(bare), r"^[\s:,.–-]+|[\s:,.–-]+$", "")


def bracketed(value: Column, words: Sequence[str]) -> Column:
    """What stands in the first brackets, else after one of the words; empty without either."""
    inside = F.regexp_extract(text_of(value), r"[(\[]([^)\]]{2,40})[)\]]", 1)
    after = F.regexp_extract(text_of(value), rf"(?i)(?:^|\s)(?:{'|'.join(words)})\s+([^\s,.;|]+(?:\s+[^\s,.;|]+)?)", 1)
    return collapse(F.when(inside != "", inside).otherwise(after))


def phrase_after(value: Column, triggers: Sequence[str], most: int = 60) -> Column:
    """The text after the first trigger up to a line's or a sentence's end."""
    return F.substring(collapse(F.regexp_extract(text_of(value), rf"(?i)(?:{'|'.join(triggers)})\s*:?\s*([^\n.;|]+)", 1)), 1, most)


def title_of(value: Column, brand: Column, sign: str, most: int = 90) -> Column:
    """The first line that holds the sign (a pattern), without the brand, at most so long; else the first line."""
    lines = F.filter(F.transform(F.split(text_of(value), r"[\n|]"), collapse), lambda x: x != "")
    chosen = F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(f"(?i){sign}")), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return F.substring(without_brand(chosen, brand), 1, most)


def is_generic(value: Column, names: Sequence[str], least: int = 3) -> Column:
    """Whether a value is too short, a number, a link or one of the names, and so says nothing."""
    plain = F.lower(collapse(value))
    return (F.char_length(plain) < least) | plain.isin(*names) | plain.rlike(r"^[0-9\W]+$|^https?://|^www\.")


def compact(columns: Mapping[str, tuple[Column, int]]) -> list[Column]:
    """A fixed list of fields, each text at most so long."""
    return [F.substring(collapse(c), 1, most).alias(name) for name, (c, most) in columns.items()]


def resolved(link: Column, base: Column) -> Column:
    """A link against the address of its page: absolute, `//host`, `/path`, `?query`, `#part` and relative links; dot segments
    at the start of a relative link go up. Empty for links that are not http."""
    scheme, origin = F.regexp_extract(base, r"^(https?:)//", 1), F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    ups = F.size(F.split(F.regexp_extract(link, r"^((?:\.\./)*)", 1), r"\.\./")) - 1
    steps = F.filter(F.split(folder, "/"), lambda s: s != "")
    up = F.concat(F.lit("/"), F.array_join(F.transform(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - ups, F.lit(0))), lambda s: F.concat(s, F.lit("/"))), ""))
    rest = F.regexp_replace(link, r"^(?:\.\./)*(?:\./)?", "")
    return (
        F.when(link.rlike(r"^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(""))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#") | (link == ""), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(origin, up, rest))
    )


def owner(candidates: Sequence[Column], profile: Column, reserved: Sequence[str]) -> Column:
    """The first valid account name among the candidates, else that of a profile address with one path part."""
    valid = lambda c: F.when(F.lower(F.regexp_replace(c, "^@", "")).rlike(r"^[a-z0-9._]{2,30}$") & ~F.lower(F.regexp_replace(c, "^@", "")).isin(*reserved), F.lower(F.regexp_replace(c, "^@", "")))
    return F.coalesce(*[valid(c) for c in candidates], valid(F.regexp_extract(F.coalesce(profile, F.lit("")), r"^https?://[^/]+/([^/?#]+)/?(?:[?#].*)?$", 1)))


def url_variants(url: Column) -> Column:
    """The forms under which an address may be known: as it is, without query and fragment, without a last slash, other scheme."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    other = F.when(bare.startswith("https://"), F.regexp_replace(bare, "^https", "http")).otherwise(F.regexp_replace(bare, "^http:", "https:"))
    return F.array_sort(F.array_distinct(F.array(url, bare, F.regexp_replace(bare, "/+$", ""), other)))


def identity_url(url: Column, parameters: Sequence[str]) -> Column:
    """An address by host, path and the parameters that identify what it shows, in fixed order."""
    base = F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://(?:www\.)?", ""))
    value = lambda p: F.regexp_extract(url, rf"[?&]{re.escape(p)}=([^&#]*)", 1)
    kept = F.array_join(F.array_compact(F.array(*[F.when(value(p) != "", F.concat(F.lit(f"{p}="), value(p))) for p in parameters])), "&")
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def listed_names(value: Column) -> Column:
    """Names of a hand-kept list, separated by commas, semicolons, spaces or lines: lower case, without @ and #, once each, in order."""
    parts = F.transform(F.split(text_of(value), r"[\s,;]+"), lambda p: F.lower(F.regexp_replace(p, "^[@#]+", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def signature_fields(signature: Column, names: Sequence[str], sign: str = "|") -> list[Column]:
    """The fields of a signature that joins them by a sign; missing ones are empty."""
    parts = F.split(text_of(signature), re.escape(sign), -1)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]

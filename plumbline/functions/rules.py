"""Ordered rules on text. The vocabulary of a site or a source is the caller's: functions take it as an argument."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import clean_text, clean_ui_noise


@dataclass(frozen=True)
class Rule:
    """A label for texts that hold any of the words `any_of`, one of `also` too if given, and none of `unless`."""

    label: str
    any_of: Sequence[str]
    also: Sequence[str] = ()
    unless: Sequence[str] = ()

    def holds(self, text: Column) -> Column:
        found = holds_word(text, self.any_of)
        if self.also:
            found = found & holds_word(text, self.also)
        return found & ~holds_word(text, self.unless) if self.unless else found


def word_pattern(words: Sequence[str]) -> str:
    """A pattern for any of the words, none of them inside a longer run of letters and digits."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(re.escape(w) for w in words)})(?![\p{{L}}\p{{N}}])"


def holds_word(text: Column, words: Sequence[str]) -> Column:
    """Whether the cleaned text, in lower case, holds one of the words."""
    return F.lower(clean_text(text)).rlike(word_pattern([w.lower() for w in words]))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str = "") -> Column:
    """The label of the first rule (label, pattern) whose pattern is found, without regard to case."""
    found = F.coalesce(*[F.when(text.rlike(f"(?iU){pattern}"), F.lit(label)) for label, pattern in rules])
    return F.coalesce(found, F.lit(default))


def classified(text: Column, rules: Sequence[Rule], default: Column | None = None) -> Column:
    """The label of the first rule that holds; `default`, or null, without any."""
    label = F.coalesce(*[F.when(rule.holds(text), F.lit(rule.label)) for rule in rules])
    return label if default is None else F.coalesce(label, default)


def offer_type(text: Column, given: Column, rules: Sequence[Rule]) -> Column:
    """The type that the text names by the rules, else the given one in lower case."""
    return classified(clean_ui_noise(text), rules, F.lower(clean_ui_noise(given)))


def category(given: Column, text: Column, rules: Sequence[Rule], aliases: Mapping[str, str], weak: Sequence[str], strong: Sequence[Rule] = (), default: str = "") -> Column:
    """The category of a record: what `strong` rules read in the text, whatever was given; else the given one under its
    usual name, unless that is empty or among the `weak` ones, which say nothing; else what the rules read in the text."""
    plain = F.lower(clean_text(given))
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    usual = F.coalesce(F.try_element_at(names, plain), plain) if aliases else plain
    read = F.coalesce(classified(text, rules), F.nullif(usual, F.lit("")), F.lit(default))
    kept = F.when(usual.isin("", *weak), read).otherwise(usual)
    return F.coalesce(classified(text, strong), kept) if strong else kept

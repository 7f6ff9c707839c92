"""Queries of texts made whole before rules read them, and of which rows a budget of checks goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.budget import allotted
from plumbline.plans.offers import table
from plumbline.plans.queries import query


@query("""WITH t AS (SELECT doc_id, replace(replace(text, 'e', 'e' || chr(769)), 'o', 'o' || chr(770) || chr(803)) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substr(t, 1, 81), '[^\\x{0300}-\\x{036f}][\\x{0300}-\\x{036f}]*$', '') END AS cut FROM t""")
def q_grapheme_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vowels carry one or two marks of their own, cut at 80 code points without tearing a mark off."""
    marked = F.regexp_replace(F.regexp_replace("text", "e", "e\u0301"), "o", "o\u0302\u0323")
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_graphemes(marked, 80).alias("cut"))


@query("SELECT doc_id, replace(replace(replace(text, 'z', chr(65533)), 'x', chr(128512)), 'q', '\\ud83d') AS text FROM documents")
def q_repaired_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as JSON in which one letter is half an escaped pair, one a whole pair and one an escaped backslash before such."""
    payload = F.to_json(F.struct("text"))
    for letter, escape in (("z", r"\\ud83d"), ("x", r"\\uD83D\\ude00"), ("q", r"\\\\ud83d")):
        payload = F.regexp_replace(payload, f"{letter}(?![^\"]*\":)", escape)
    read = F.from_json(text.repair_surrogates(payload), "text string")
    return table(spark, sf_dir, "documents").select("doc_id", read["text"].alias("text"))


@query("SELECT doc_id, replace(trim(regexp_replace(lower(replace(strip_accents(replace(text, 'a', 'A' || chr(8211))), 'ß', 'ss')), '\\s+', ' ', 'g')), chr(8211), '-') AS said FROM documents")
def q_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as date rules read them; letters get dashes and capitals first."""
    return table(spark, sf_dir, "documents").select("doc_id", text.signal(F.regexp_replace("text", "a", "A\u2013")).alias("said"))


@query("""WITH r AS (SELECT doc_id, source, least(n_chars, 10000) AS score FROM documents WHERE n_chars > 0),
w AS (SELECT *, score - 25 * (row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) - 1) AS worth FROM r)
SELECT doc_id, source, n_chars, worth FROM (SELECT * FROM w WHERE worth > 0 ORDER BY worth DESC, source LIMIT 700) JOIN documents USING (doc_id, source)""")
def q_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 700 documents that checks go to, if each check in a source makes the next one there worth 25 less."""
    return allotted(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 700, 25)

"""Queries over the training-data tables, one per operator, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import centroids, chat_format, exact_dedup, html_extract, jaccard, mixing, packing, pii, quality, sharding, simhash, tokens, whitening
from plumbline.llm._common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in two arrivals: a snapshot, then a batch. Both parts are deduplicated, against each other too."""
    docs = read(spark, sf_dir, "documents")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    out = exact_dedup.dedup_batch(docs.where(~late), docs.where(late))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""


#: Code points of a turn from which it also carries its source as a document part, and code points of one of its units.
LONG_TURN, UNIT = 400, 1000


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations; a long turn has a document part (its source, a unit for each UNIT code points begun) besides its text."""
    planted = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    size = F.char_length(F.coalesce("text", F.lit("")))
    source = F.struct(F.lit("document").alias("kind"), F.lit(None).cast("string").alias("text"), F.concat_ws("/", F.lit("conversations"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"), F.ceil(size / UNIT).alias("units"))
    parts = F.when(size >= LONG_TURN, F.concat(chat_format.text_parts(F.col("text")), F.array(source).cast(f"array<{chat_format.PART}>"))).otherwise(chat_format.text_parts(F.col("text")))
    formatted = chat_format.format_chats(turns.withColumn("parts", parts))
    back = chat_format.read_chats(formatted.withColumn("conv_id", F.struct("conv_id", "n_expanded")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    refs = F.flatten(F.transform("turns", lambda t: F.filter(t["parts"]["ref"], lambda r: r.isNotNull())))
    return back.select("conv_id.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", F.size(refs).cast("long").alias("n_attachments"), F.sha2(F.array_join(refs, ",").cast("binary"), 256).alias("refs_sha256"), F.col("conv_id.n_expanded").alias("n_expanded"))


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|(?:ROLE|INST|PART|SYS)\]|(?:IMAGE|AUDIO|DOCUMENT):))', '\1\\\2\3', 'g')"
OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) >= {LONG_TURN} AS is_long FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', false UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', false)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[ROLE]') + length({_ESCAPED.format('role')}) + length('[/ROLE]') + length({_ESCAPED.format('text')}) + CASE WHEN is_long THEN length('[PART][DOCUMENT:1]') ELSE 0 END + length('</s>')) AS BIGINT) AS formatted_chars,
  count(*) FILTER (is_long) AS n_attachments,
  sha256(coalesce(string_agg('conversations/' || conv_id || '/' || turn, ',' ORDER BY turn, role, text) FILTER (is_long), '')) AS refs_sha256,
  CAST(coalesce(sum(512 * ceil(length(text) / {UNIT}.0)) FILTER (is_long), 0) AS BIGINT) AS n_expanded
FROM t GROUP BY conv_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=40)


#: Targets of the registered mix, as multiples of a domain's expected tokens: good text a quarter more, poor text half, toxic text nearly none.
TARGETS = {"good": 1.25, "poor": 0.5, "toxic": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), TARGETS)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), limit=512)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).drop("all_spans")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their eight principal components. A deviation beyond a long is an error."""
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in eight clusters after ten rounds. An inertia beyond a long is an error."""
    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), digest.alias("centroid_sha256"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_html_extract": op5_html_extract,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_jaccard": op13_jaccard,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_chat_format": OP2_SQL}

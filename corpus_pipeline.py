"""A corpus from raw documents to packed sequences: each stage's Parquet output is the next one's documents.

Every row of a stage's input gets a key of its own, from its file and its place there, and decisions come back by that key.
So rows are judged each for itself whatever their doc_id: null ids and repeated rows neither meet nor multiply, null texts
count as empty, ties between equal ids go by place, empty tables give empty tables, and columns beyond those of documents
are left out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, mixing, packing, quality, simhash
from plumbline.llm._common import read
from plumbline.workspace import store

#: The near-duplicate stage: candidates by fingerprints of distinct words that differ in so many bits at most, confirmed by
#: the Jaccard similarity of five-word shingles, in percent.
NEAR_RADIUS, SIMILARITY, SHINGLE_WORDS = 6, 80, 5
#: Targets of the mix, as multiples of each domain's expected tokens. Good text is wanted a tenth more often, so that the rate
#: of a document that is surely good does not fall below 1.
TARGETS = {"good": 1.1, "poor": 1.0, "toxic": 0.0}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame, null_ids: str) -> DataFrame:
    """documents' columns and `row_key`: a string in the order of doc_id, then of file and place. Null ids come "first" or
    "last". It is the same whenever the files are read, however they are split."""
    try:
        placed = docs.select(*COLUMNS, "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not read from files
        placed = store(docs.select(*COLUMNS), "stage-rows").select(*COLUMNS, "_metadata.file_path", "_metadata.row_index")
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    number: Column = F.coalesce(hexed(F.col("doc_id").bitwiseXOR(F.lit(-(2**63)))), F.lit("!" if null_ids == "first" else "~"))
    return placed.select(*COLUMNS, F.concat_ws(":", number, hexed(F.xxhash64("file_path")), hexed("row_index")).alias("row_key"))


def decided(docs: DataFrame, decisions: DataFrame, tag: str, how: str = "left") -> DataFrame:
    """Rows with their decision, by key: a merge join at every size, as the keys grow with the rows."""
    side = store(decisions, tag).withColumnRenamed("row_key", "_key")
    return docs.join(side.hint("merge"), F.col("row_key") == F.col("_key"), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go; the others lose the lines that too many documents of their source share."""
    rows = keyed(docs, "first")
    found = quality.judge(rows, key="row_key").where(~F.col("kept") | (F.size("removed_lines") > 0)).select("row_key", "kept", "removed_lines")
    joined = decided(rows, found, "stage-quality").where(F.coalesce("kept", F.lit(True)))
    lines = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("removed_lines", at))
    text = F.when(F.size("removed_lines") > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))
    return joined.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: that with the largest doc_id, a null one only alone."""
    rows = keyed(docs, "first")
    late = F.pmod(F.xxhash64("row_key"), F.lit(2)) == 1
    marked = exact_dedup.dedup_batch(rows.where(~late), rows.where(late), key="row_key")
    return decided(rows, marked.where(~F.col("kept")).select("row_key"), "stage-exact", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id, a null one only alone."""
    rows = keyed(docs, "last")
    grouped = simhash.similar_groups(rows, radius=NEAR_RADIUS, percent=SIMILARITY, shingle_words=SHINGLE_WORDS, key="row_key")
    return decided(rows, grouped.where("row_key <> component").select("row_key"), "stage-near", "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go into the mix as often as their copies say, with the same id each time: toxic ones not at all."""
    rows = keyed(docs, "first")
    labels = read(spark, sf_dir, "labels")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    by_row = store(rows.select("doc_id", "row_key").join(known, "doc_id").select(F.col("row_key").alias("doc_id"), "toxic", "quality"), "stage-labels")
    mixed = mixing.mix(rows, by_row, TARGETS, key="row_key").where("copies <> 1").select("row_key", "copies")
    times = F.coalesce("copies", F.lit(1))
    repeated = decided(rows, mixed, "stage-mix").where(times > 0).withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 1024 tokens; a document that is in the mix twice is packed twice."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", source_mixing), ("best-fit packing", best_fit_packing)]
#: SQL expresses neither the fitted mixing nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)

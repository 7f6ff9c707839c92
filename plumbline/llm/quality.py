"""Quality rules: per-text measures, and lines that too many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.workspace import store

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_print long, lines array<struct<hash:long,at:int,words:int>>"

#: Distinct documents of a host that make a line frequent whatever their share: a host of any size loses such lines.
MANY_DOCUMENTS = 1000


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """Per document: key, host, the base measures, doc_print and its lines as (hash of the normalised line, place, words).

    A normalised line is lower-case, with single spaces, and each run of digits as one 0. doc_print is the hash of the
    whole text, lower-case and with single spaces: copies count as one document, and no others do, whatever they share.
    """

    def batch_of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        symbols, digits = re.compile(rb"[#*$%&|<>]"), re.compile(rb"[0-9]+")
        signed = lambda x: x - 2**64 if x >= 2**63 else x

        def measure(text: str | None) -> dict:
            raw = (text or "").encode("utf-8")
            words = raw.split()  # of bytes: at ASCII white space only
            seen: dict = {}
            again, starts = set(), []
            for i, window in enumerate(zip(words, words[1:], words[2:])):
                if (first := seen.setdefault(window, i)) != i:
                    again.add(first)
                    starts.append(i)
            repeated, end = 0, 0
            for i in sorted([*again, *starts]):
                repeated += i + 3 - max(i, end)
                end = i + 3
            lines, kept, n_dup = set(), [], 0
            for at, line in enumerate(raw.split(b"\n")):
                own = line.split()
                if own:
                    n_dup += line in lines
                    lines.add(line)
                    kept.append({"hash": signed(xxh3_64_intdigest(digits.sub(b"0", b" ".join(own).decode("utf-8").lower().encode("utf-8")))), "at": at, "words": len(own)})
            whole = xxh3_64_intdigest(b" ".join(words).decode("utf-8").lower().encode("utf-8"))
            return {"n_words": len(words), "word_chars": len(b"".join(words).decode("utf-8")), "n_symbols": len(symbols.findall(raw)), "n_dup_lines": n_dup, "n_repeat_words": repeated, "doc_print": signed(whole), "lines": kept}

        kinds = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "doc_print": pa.int64(), "lines": pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("words", pa.int32())]))}
        for batch in batches:
            rows = [measure(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]], names=[key, host, *kinds])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(host, docs.schema[host].dataType), *T._parse_datatype_string(MEASURES).fields])
    return docs.select(key, host, text).mapInArrow(batch_of, schema)


def frequent_lines(measured: DataFrame, host: str = "source", least_documents: int = 20, share: float = 0.05, many: int = MANY_DOCUMENTS) -> DataFrame:
    """(host, hash, n_documents) of the lines found in more than `share` of a host's distinct documents, and in at least
    `least_documents`; or in at least `many`, whatever their share."""
    seen = measured.select(host, "doc_print", F.explode("lines.hash").alias("hash")).groupBy(host, "hash", "doc_print").agg(F.lit(1).alias("one"))
    counts = seen.groupBy(host, "hash").agg(F.count("one").alias("n_documents")).where(F.col("n_documents") >= least_documents)
    totals = measured.groupBy(host, "doc_print").agg(F.lit(1).alias("one")).groupBy(host).agg(F.count("one").alias("n_host"))
    totals = totals.withColumnRenamed(host, "_host")
    return counts.join(totals, counts[host].eqNullSafe(totals["_host"])).where((F.col("n_documents") > share * F.col("n_host")) | (F.col("n_documents") >= many)).select(host, "hash", "n_documents")


def judge(docs: DataFrame, least_documents: int = 20, share: float = 0.05, depleted: float = 0.3, text: str = "text", key: str = "doc_id", host: str = "source", many: int = MANY_DOCUMENTS) -> DataFrame:
    """Per document: key, the five base measures, base_failed, n_removed_words, removed_lines (places), kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. Lines above the limits of
    frequent_lines are removed; a document that keeps less than `depleted` of its words is rejected. A null or empty
    text has no words and fails the base; a null host is a host of its own; a null key is carried; repeated rows are
    judged each but count as one document; no rows give no rows; other columns are not read.
    """
    measured = store(measures(docs, text, key, host).withColumn("_row", F.expr("uuid()")), "quality")
    # at most lines-of-a-document / share rows a host, and one for each `many` lines of the corpus: Spark broadcasts the stored table while it is small, and shuffles beyond
    frequent = store(frequent_lines(measured, host, least_documents, share, many), "quality-lines").withColumnRenamed(host, "_host")
    lines = measured.select("_row", host, F.explode("lines").alias("line")).select("_row", host, "line.*")
    hits = lines.join(frequent, (lines["hash"] == frequent["hash"]) & lines[host].eqNullSafe(frequent["_host"])).groupBy("_row").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    joined = measured.drop("lines", "doc_print").join(hits, "_row", "left")
    removed = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), removed.cast("long").alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), (~failed & (F.col("n_words") - removed >= depleted * F.col("n_words"))).alias("kept"))

"""Exact dedup against immutable snapshots: a static binary-fuse filter per digest bucket screens what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import ascii_lower
from plumbline.operators.joins import join_unique
from plumbline.workspace import store

#: Digests a bucket holds on average; the number of buckets follows the snapshot.
BUCKET_KEYS = 50_000
DIGEST = ["text_sha256", "n_bytes"]


def _mix(keys, seed: int):
    import numpy as np

    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _places(hashes, segment: int, segments: int):
    """The three slots of each key: in three neighbouring segments of the table, and its one-byte print."""
    import numpy as np

    first = ((hashes >> np.uint64(40)) * np.uint64(segments - 2)) >> np.uint64(24)
    low = np.uint64(segment - 1)
    return [((first + np.uint64(j)) * np.uint64(segment) + ((hashes >> np.uint64(12 * j)) & low)).astype(np.int64) for j in range(3)], (hashes ^ (hashes >> np.uint64(32))).astype(np.uint8)


def build_filter(keys) -> bytes:
    """A binary-fuse filter over distinct unsigned 64-bit keys, about nine bits a key: no key it holds is ever missed,
    one other key in 256 passes. The bytes carry the seed and the segment sizes before the table."""
    import numpy as np

    keys = np.unique(np.asarray(keys, np.uint64))
    segment = 1 << min(12, max(2, int(np.log(max(len(keys), 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(len(keys), 2))) if len(keys) > 1 else 4
    segments = max(3, int(np.ceil(len(keys) * factor / segment)) + 2)
    for seed in range(200):
        slots, prints = _places(_mix(keys, seed), segment, segments)
        size = segment * segments
        degree, xor = np.zeros(size, np.int64), np.zeros(size, np.int64)
        rows = np.arange(len(keys), dtype=np.int64)
        for s in slots:
            np.add.at(degree, s, 1)
            np.bitwise_xor.at(xor, s, rows)
        # peel: a slot that only one key uses decides that key last; a whole layer of such slots goes at once
        layers, alone = [], np.flatnonzero(degree == 1)
        left = len(keys)
        while alone.size:
            owner, at = np.unique(xor[alone], return_index=True)
            layers.append((owner, alone[at]))
            left -= len(owner)
            for s in slots:
                np.subtract.at(degree, s[owner], 1)
                np.bitwise_xor.at(xor, s[owner], owner)
            touched = np.unique(np.concatenate([s[owner] for s in slots]))
            alone = touched[degree[touched] == 1]
        if left:
            if seed % 10 == 9:
                segments += max(1, segments // 10)
            continue
        table = np.zeros(size, np.uint8)
        for owner, at in reversed(layers):
            value = prints[owner]
            for s in slots:
                value = value ^ np.where(s[owner] == at, 0, table[s[owner]]).astype(np.uint8)
            table[at] = value
        return np.asarray([seed, segment, segments], "<i8").tobytes() + table.tobytes()
    raise RuntimeError("no seed peels; are the keys distinct?")


def may_contain(filter_bytes: bytes, keys):
    """A boolean per key: False only if the filter's set surely lacks it."""
    import numpy as np

    seed, segment, segments = np.frombuffer(filter_bytes[:24], "<i8").tolist()
    table = np.frombuffer(filter_bytes[24:], np.uint8)
    slots, prints = _places(_mix(np.asarray(keys, np.uint64), seed), segment, segments)
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text_sha256 (of the text with A-Z in lower case, as UTF-8) and n_bytes."""
    return docs.select(key, *_digest(text))


def _digest(text: str) -> list:
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return [F.sha2(normal.cast("binary"), 256).alias("text_sha256"), F.octet_length(normal).cast("long").alias("n_bytes")]


def groups(digested: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per distinct text: its digest, length, largest key and number of rows. Copies fold before the shuffle."""
    return digested.groupBy("text_sha256", "n_bytes").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    key64 = F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long")
    return df.withColumn("key64", key64).withColumn("bucket", F.pmod(F.xxhash64("key64"), F.lit(buckets)).cast("int"))


def snapshot(grouped: DataFrame, tag: str = "snapshot") -> tuple[DataFrame, DataFrame, int]:
    """Freeze groups of earlier documents: the stored exact table, a filter per bucket, and the number of buckets."""
    frozen = store(grouped, tag)
    buckets = max(1, -(-frozen.count() // BUCKET_KEYS))

    def build(pdf):
        import numpy as np
        import pandas as pd

        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [build_filter(pdf["key64"].to_numpy().view(np.uint64))]})

    filters = _bucketed(frozen, buckets).select("bucket", "key64").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")
    return frozen, store(filters, f"{tag}-filters"), buckets


def sliced(incoming: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """The incoming groups with their bucket and a slice of it, and the number of slices: as many as leave about
    BUCKET_KEYS rows in a slice of a bucket, however small the snapshot is against what comes in."""
    slices = max(1, -(-incoming.count() // (buckets * BUCKET_KEYS)))
    return _bucketed(incoming, buckets).withColumn("slice", F.pmod(F.xxhash64("key64", F.lit(1)), F.lit(slices)).cast("int")), slices


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming groups that the snapshot's filters cannot rule out. A bucket's filter goes to each slice of the bucket:
    about nine bits for each digest that comes in. `incoming` should be stored, as it is counted first."""
    rows, slices = sliced(incoming, buckets)
    extra = ["key64", "bucket", "slice"]

    def test(left, right):
        import numpy as np

        if not len(left) or not len(right):
            return left.iloc[:0].drop(columns=extra)
        return left[may_contain(right["filter"].iloc[0], left["key64"].to_numpy().view(np.uint64))].drop(columns=extra)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in incoming.schema)
    each = filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return rows.groupBy("bucket", "slice").cogroup(each.groupBy("bucket", "slice")).applyInPandas(test, kept)


def dedup_batch(earlier: DataFrame, batch: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Mark the copies among the rows of `earlier` (an immutable snapshot) and of `batch` that comes in after it.

    A row per document of both: key, keep_id, group_size, kept, text_sha256, in_snapshot. Of equal texts the row with
    the largest key stays. Copies within the batch are grouped by digest and length; each new digest is screened by the
    snapshot's filters; those that pass meet the exact table, and where digest and length agree the bytes of the two
    texts are compared before the groups become one. Rows of a text that many share meet their group by broadcast. A null text counts as empty; null keys rank lowest and stay only
    alone (of several null keys one group, all kept false but marked by keep_id null); exactly repeated rows are all
    kept, as they have one key; a key may have several texts; empty tables give no rows; other columns are not read.
    """
    old, new = store(digests(earlier, text, key), "dedup-old"), store(digests(batch, text, key), "dedup-new")
    frozen, filters, buckets = snapshot(groups(old, key))
    incoming = store(groups(new, key), "dedup-incoming")
    positives = screen(incoming, filters, buckets).select(*DIGEST, F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    met = store(positives.join(frozen, DIGEST), "dedup-met")
    # One text of each side is compared byte by byte. It is found by digest and key: a key may have several texts, and
    # several texts may have no key. The merge hint keeps one plan at every size: what was met grows with the input, and a
    # broadcast would only serve small tables.
    found = lambda wanted, docs: met.select(*DIGEST, F.col(wanted).alias("_want")).hint("merge").join(docs.select(*_digest(text), F.col(key).alias("_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).withColumnsRenamed({c: f"_{c}" for c in DIGEST}), F.col("_id").eqNullSafe(F.col("_want")) & (F.col("text_sha256") == F.col("_text_sha256")) & (F.col("n_bytes") == F.col("_n_bytes"))).select(*DIGEST, "_text")
    texts = found("keep_id", earlier).withColumn("_side", F.lit(0)).unionByName(found("new_id", batch).withColumn("_side", F.lit(1)))
    of_side = lambda i: F.max(F.when(F.col("_side") == i, F.col("_text")))
    same = texts.groupBy(*DIGEST).agg(of_side(0).alias("old_text"), of_side(1).alias("new_text")).where("old_text = new_text").select(*DIGEST)
    merged = store(met.join(same, DIGEST).select(*DIGEST, F.greatest("keep_id", "new_id").alias("both_id"), (F.col("n") + F.col("new_n")).alias("both_n")), "dedup-merged")

    def sides(grouped: DataFrame, rows: DataFrame, earlier_side: bool) -> DataFrame:
        final = store(grouped.join(merged, DIGEST, "left").select(*DIGEST, F.coalesce("both_id", "keep_id").alias("keep_id"), F.coalesce("both_n", "n").alias("group_size")), "dedup-final")
        return join_unique(rows, final, DIGEST, grouped).withColumn("in_snapshot", F.lit(earlier_side))

    out = sides(frozen, old, True).unionByName(sides(incoming, new, False))
    return out.select(key, "keep_id", "group_size", F.coalesce(F.col(key) == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256", "in_snapshot")

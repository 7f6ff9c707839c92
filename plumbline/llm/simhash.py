"""SimHash fingerprints, linked by covering locality-sensitive hashing and joined into components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import jaccard
from plumbline.operators.graph import components
from plumbline.operators.joins import join_unique
from plumbline.workspace import store

#: Buckets of up to so many distinct fingerprints are compared inside one row; larger ones in blocks of BLOCK.
SMALL, BLOCK = 48, 4096
#: Multiplier that scatters the bit positions over the codewords (2**64 divided by the golden ratio).
SCATTER = 0x9E3779B97F4A7C15


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks such that any `radius` bit positions are all left out by at least one mask.

    Each position i gets a vector m(i) of radius+1 bits; the mask of a vector v > 0 holds the positions with an odd
    number of ones in m(i) & v. Any `radius` vectors have a common v > 0 with an even number in each, so two
    fingerprints that differ in those positions agree under that mask. Each mask holds about half of the positions: the
    positions take all vectors in turn, or, where there are fewer positions than that, vectors with the highest bit set
    (the first few vectors alone would leave the masks of the higher bits with hardly a position).
    """
    size = 1 << (radius + 1)
    half = size // 2
    order = sorted(range(bits), key=lambda i: (i + 1) * SCATTER % 2**64)
    vector = {i: k % (size - 1) + 1 if bits > half else half + k * (SCATTER % half) % half for k, i in enumerate(order)}
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, repeats: bool = True, text: str = "text", key: str = "doc_id", shingle_words: int = 0) -> DataFrame:
    """key and `fp` (the 64 bits as a signed long) of each whole text. Without `repeats` each shingle counts once.

    With `shingle_words`, also n_shingles and class: how many distinct shingles of so many words it has, and the name of their
    set (null without words).
    """

    def batch_of(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def hashed(split: list, n: int):
            shingles = map(b" ".join, zip(*(split[i:] for i in range(n)))) if len(split) >= n else [b" ".join(split)]
            return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)

        def fingerprint(split: list) -> int:
            if not split:
                return 0
            ones, n, part = np.zeros(64, np.int64), 0, 1 << 16
            hashes = hashed(split, words)
            hashes = hashes if repeats else np.unique(hashes)
            for i in range(0, len(hashes), part):  # a very long text unpacks part by part
                block = hashes[i : i + part].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
                n += len(block)
            return _signed(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))

        for batch in batches:
            texts = batch.column(1).to_pylist()
            splits = [(t or "").encode("utf-8").lower().split() for t in texts]  # bytes: A-Z only, and ASCII white space only
            out = [batch.column(0), pa.array(map(fingerprint, splits), pa.int64())]
            if shingle_words:
                sets = jaccard.shingle_sets(texts, shingle_words)
                out += [pa.array(map(len, sets), pa.int64()), pa.array(map(jaccard.class_of, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())] + ([T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType())] if shingle_words else [])
    names = [f.name for f in fields]
    return docs.select(key, text).mapInArrow(batch_of, T.StructType(fields))


def _forest(fps, radius: int):
    """Links (a, b) of a spanning forest of the graph in which fingerprints within `radius` bits are joined."""
    import numpy as np

    fps, root = fps.view(np.uint64), np.arange(len(fps))
    links = []
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
        for r in np.unique(root[near]).tolist() if near.size else ():
            if r != root[i]:
                j = int(near[root[near] == r][0])
                links.append((i, j))
                root[root == r] = root[i]
    return links


def buckets(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(fp, t, key, mask, n) of the distinct fingerprints `fp` that share a bucket (table t, key) of n, stored.

    Every pair within `radius` bits shares a bucket. A bucket of more than `block` is dealt on: the bits outside its mask
    are cut into radius + 1 parts, one of which any such pair has in common too, and takes a bucket for each part.
    """
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)]))
    # few bytes, but each row becomes one for every mask: dealt over all tasks first
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    # counted along the bucket's own rows: one shuffle, and Spark spills a bucket that is large
    counted = lambda df: df.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "key"))).where("n > 1")
    first = store(counted(spread.select("fp", tables.alias("k")).select("fp", "k.t", "k.mask")), "simhash-buckets")
    if first.where(F.col("n") > block).isEmpty():
        return first
    parts = {}
    for i, m in enumerate(masks):
        free = [b for b in range(64) if not m >> b & 1]
        parts[i] = [_signed(m | sum(1 << b for b in free[k :: radius + 1])) for k in range(radius + 1)]
    finer = F.explode(F.array(*[F.array(*[F.struct(F.lit(len(masks) + i * (radius + 1) + k).alias("t"), F.lit(m).alias("mask")) for k, m in enumerate(parts[i])]) for i in parts])[F.col("t")])
    dealt = counted(first.where(F.col("n") > block).select("fp", finer.alias("k")).select("fp", "k.t", "k.mask"))
    return store(first.where(F.col("n") <= block).unionByName(dealt), "simhash-finer-buckets")


def _units(shared: DataFrame, small: int, block: int, *columns: str) -> DataFrame:
    """Buckets of more than `small` as units (t, key, i, j) for one task each; beyond `block` a unit for each pair of blocks.
    Buckets are that large after a second deal only where thousands of fingerprints agree in most of their bits."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    large = shared.where(F.col("n") > small).withColumn("own", F.pmod(F.xxhash64(*columns), blocks).cast("int"))
    whole = large.where(F.col("n") <= block).select("t", "key", "own", F.col("own").alias("other"), *columns)
    parted = large.where(F.col("n") > block).select("t", "key", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), *columns)
    return whole.union(parted).select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)


def _earlier(radius: int) -> str:
    """SQL: an earlier mask than that of table t joins a and b too. Tables of the second deal come after all masks."""
    return f"exists(slice(array({', '.join(f'{_signed(m)}L' for m in covering_masks(radius))}), 1, t), m -> ((a ^ b) & m) = 0)"


def small_bucket_pairs(shared: DataFrame, radius: int, small: int) -> DataFrame:
    """All pairs (a, b) within `radius` bits of the buckets of up to `small`, where no earlier mask joins them."""
    return (
        shared.where(F.col("n") <= small)
        .groupBy("t", "key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select("t", F.posexplode("fps").alias("i", "a"), "fps")
        .select("a", F.explode(F.expr(f"filter(slice(fps, i + 2, {small}), b -> bit_count(a ^ b) <= {radius} AND (t >= {2 ** (radius + 1) - 1} OR NOT {_earlier(radius)}))")).alias("b"))
    )


def bucket_links(shared: DataFrame, radius: int = 3, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """links() of stored buckets."""

    def compare(pdf):
        import numpy as np
        import pandas as pd

        fps = np.unique(pdf["fp"].to_numpy())
        found = _forest(fps, radius)
        return pd.DataFrame({"a": [fps[i] for i, _ in found], "b": [fps[j] for _, j in found]}, dtype="int64")

    forest = _units(shared, small, block, "fp").groupBy("t", "key", "i", "j").applyInPandas(compare, "a long, b long")
    return small_bucket_pairs(shared, radius, small).union(forest).distinct()


def links(distinct: DataFrame, radius: int = 3, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints `fp`, with the components of all pairs within `radius` bits.

    A bucket of up to `small` fingerprints is compared within a row, and gives a pair only if no earlier mask joins it:
    close pairs share most masks, and each link is needed once. A larger bucket gives a spanning forest instead of all its
    pairs; one beyond `block` is dealt on, and what is still larger is compared block by block. So neither a task nor the
    number of links grows with the square of a bucket.
    """
    return bucket_links(buckets(distinct, radius, block), radius, small, block)


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, repeats: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, fingerprint (16 lowercase hex digits), component_id (smallest key reachable over links of at
    most `radius` differing bits, itself included).

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Fewer words than a
    shingle make one shingle. Repeated rows keep a row each. A null key is carried, but never names a component
    unless it is alone in it (component_id null then). No rows give no rows; other columns are not read.
    """
    prints = store(fingerprints(docs, words, seed, repeats, text, key), "simhash")
    classes = store(prints.groupBy("fp").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = components(links(classes.select("fp"), radius))
    # a component's name is the least fingerprint in it; its least key follows from the classes
    named = store(classes.join(found, classes["fp"] == found["id"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "simhash-named")
    least = store(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    of = store(join_unique(named, least.select("component", "component_id"), ["component"], least).select("fp", "component_id"), "simhash-components")
    return join_unique(prints, of, ["fp"], classes).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, words: int = 1, radius: int = 6, repeats: bool = False, percent: int = 80, shingle_words: int = 5, seed: int = 42, text: str = "text", key: str = "doc_id", small: int = SMALL, block: int = BLOCK, **leaves: int) -> DataFrame:
    """Per document: key and component (least key reachable over links, itself included). Two documents are linked if
    their fingerprints differ in at most `radius` bits and the sets of their `shingle_words`-word shingles share at least
    `percent` of their union. Every link is confirmed on the sets before groups form, and none is passed over.

    Keys must be unique and not null. Documents of equal sets are one class. Only classes without too many shingles of
    their own can have links (jaccard.open_classes); the covering masks link the fingerprints of these, and what that joins is
    an area. Classes of an area that share one of their rarest shingles may be linked: regions of these are joined exactly
    (jaccard.jaccard_links, which takes `leaves`). Texts without words are alike; repeated rows have keys of their own; no
    rows give no rows; other columns are not read.
    """
    prints = store(fingerprints(docs, words, seed, repeats, text, key, shingle_words), "near-prints")
    by_class = store(prints.where("class is not null").groupBy("class").agg(F.min("fp").alias("fp")), "near-classes")

    def areas(opened: DataFrame) -> DataFrame:
        fps = store(opened.join(by_class, F.col("id") == F.col("class")).select("id", "fp"), "near-open")
        found = store(components(links(fps.select("fp").distinct(), radius, small, block)), "near-areas").withColumnRenamed("id", "_fp")
        named = fps.select("fp").distinct().join(found, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("component", "fp").alias("area"))
        return join_unique(fps, store(named, "near-area-names"), ["fp"])

    members = jaccard.regioned(docs, prints, shingle_words, percent, text, areas)
    found = components(jaccard.jaccard_links(members, percent, radius=radius, **leaves))
    return jaccard.grouped(prints, found, key).select(key, F.col("component_id").alias("component"))

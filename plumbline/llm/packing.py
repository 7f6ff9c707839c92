"""Best-fit-decreasing packing of token pieces into sequences of one length, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._common import numbered
from plumbline.workspace import store
from plumbline.llm.tokens import default_vocabulary, encode_whole

PIECES = "piece int, start long, length long, ids_crc32 long"
RUN = "length long, first long, n long, bin long, per_bin long, at long"


class OpenBins:
    """A segment tree over remaining capacities 0..capacity. Bins of equal remaining capacity are kept as ranges of bin numbers."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, capacity: int) -> None:
        i = self.leaves + capacity
        self.tree[i] = int(bool(self.ranges[capacity]))
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def add(self, capacity: int, first: int, n: int) -> None:
        self.ranges[capacity].append((first, n))
        self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        self._mark(capacity)
        return found

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that still holds `length`; in logarithmic time."""
        i = self.leaves + length
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (not self.tree[2 * i])
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts[length]: runs (length, first, n, bin, per_bin, at).

    Of the pieces of that length, numbered from 0, those from `first` on, n in all, go to bins from `bin` on,
    per_bin to each, beginning at offset `at`. A bin that took one piece and still holds another of the same length is
    the tightest for it, so equal pieces are placed together; the result is that of placing them one by one.
    """
    bins, opened, runs = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = bins.tightest(length)
            if room is None:
                room, first, free = capacity, opened, -(-(n - done) // (capacity // length))
                opened += free
            else:
                first, free = bins.pop(room)
            per_bin = min(room // length, n - done)
            used = min(free, (n - done) // per_bin)
            runs.append((length, done, used * per_bin, first, per_bin, capacity - room))
            if per_bin * length < room:
                bins.add(room - per_bin * length, first, used)
            done += used * per_bin
            if used < free:
                bins.add(room, first + used, free - used)
    return runs


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cut each document's ids, followed by end_id, into pieces of `capacity`; of a longer document the first piece takes the remainder."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, number, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode_whole(t or "", path), np.uint32(end_id)).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(i), number.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=[key, "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(PIECES).fields])
    return docs.select(key, text).mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as best-fit decreasing needs.

    Returns a row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    end id alone; repeated rows and null keys are packed like others; no rows give no rows; other columns are not
    read. The driver holds only the count of each length (at most `capacity` rows) and the runs planned from it; the
    pieces, numbered within each length over many tasks, find their run by length and number.
    """
    spark = docs.sparkSession
    cut = store(pieces(docs, vocabulary, capacity, end_id, text, key), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), RUN).withColumnRenamed("length", "_length")
    placed = numbered(cut, ["length"], F.struct(key, "piece"), "pieces")
    # runs are bounded by the lengths and capacities that exist, not by the documents
    joined = placed.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("first") + F.col("n")))
    along = F.col("slot") - F.col("first")
    return joined.select(key, "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(along / F.col("per_bin"))).cast("long").alias("sequence_id"), (F.col("at") + (along % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"))

"""Write, audit, publish: tables are staged as a version, contracts run on what was staged, and one atomic step makes it current."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A contract gets the staged tables by name and returns the rows that break it.
Audit = Callable[[dict[str, DataFrame]], DataFrame]


def _files(spark: SparkSession, path: str):
    """The file context of a path, and a function from text to a path of it."""
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(made(path).toUri(), conf), made


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, in order; those that begin with a dot are not there yet."""
    fc, path = _files(spark, folder)
    if not fc.util().exists(path(folder)):
        return []
    return sorted(n for s in fc.util().listStatus(path(folder)) if not (n := s.getPath().getName()).startswith("."))


def fill_up(spark: SparkSession, empty: str, folder: str, n: int) -> None:
    """Copy the one Parquet file of the folder `empty` into another folder until that has n of them."""
    fc, path = _files(spark, folder)
    held = lambda at: [x for x in names(spark, at) if x.endswith(".parquet")]
    for _ in range(n - len(held(folder))):
        fc.util().copy(path(f"{empty}/{held(empty)[0]}"), path(f"{folder}/empty-{uuid.uuid4().hex}.parquet"))


def claim(spark: SparkSession, folder: str, name: str, text: str = "") -> bool:
    """Make folder/name with this text, whole or not at all; False if it is there already. The text is written beside it and
    renamed, which the file system does atomically and without overwriting."""
    spark_jvm = spark._jvm
    fc, path = _files(spark, folder)
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(folder))
    beside = path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        fc.rename(beside, path(f"{folder}/{name}"), spark._sc._gateway.new_array(spark_jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def pinned(spark: SparkSession, root: str) -> dict:
    """What is current: {"feed": version or None, "reports": version or None, "step": number}. A reader that keeps this reads one
    version of every table, whatever is published meanwhile."""
    found = names(spark, f"{root}/current")
    if not found:
        return {"feed": None, "reports": None, "step": 0}
    return json.loads(spark.read.text(f"{root}/current/{found[-1]}", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, name: str, part: str = "feed", pin: dict | None = None) -> DataFrame:
    """A table of the pinned version, or of the current one."""
    version = (pin or pinned(spark, root))[part]
    if version is None:
        raise LookupError(f"nothing is published at {root}")
    return spark.read.parquet(f"{root}/versions/{version}/{part}/{name}")


def publish(root: str, feed: dict[str, DataFrame], reports: dict[str, DataFrame], audits: dict[str, Audit], apply: bool = True) -> dict:
    """Stage feed and reports as a version, audit what was staged, and make both current in one step.

    Reports become current always, the feed only if `apply` is set and no audit returns a row; else the feed of before
    stays. The breaches (contract, row as JSON) become the report `breaches`. Returns the new pin, with `broken`, the
    names of the audits that failed. Whatever fails before the last step leaves readers with what was current; what was
    staged then is never read. If two publish at once, the later step is built on the earlier one's.
    """
    spark = next(iter([*feed.values(), *reports.values()])).sparkSession
    version = uuid.uuid4().hex
    for part, tables in (("feed", feed), ("reports", reports)):
        for name, rows in tables.items():
            rows.write.parquet(f"{root}/versions/{version}/{part}/{name}")
    staged = {name: spark.read.schema(rows.schema).parquet(f"{root}/versions/{version}/{part}/{name}") for part, tables in (("feed", feed), ("reports", reports)) for name, rows in tables.items()}
    breaches = f"{root}/versions/{version}/reports/breaches"
    spark.createDataFrame([], "contract string, row string").write.parquet(breaches)
    for name, audit in audits.items():
        audit(staged).select(F.lit(name).alias("contract"), F.to_json(F.struct("*")).alias("row")).write.mode("append").parquet(breaches)
    broken = sorted(r["contract"] for r in spark.read.parquet(breaches).select("contract").distinct().collect())
    while True:
        before = pinned(spark, root)
        pin = {"feed": version if apply and not broken else before["feed"], "reports": version, "step": before["step"] + 1}
        if claim(spark, f"{root}/current", f"{pin['step']:012d}", json.dumps(pin)):
            return pin | {"broken": broken}


def landed(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows of the commits that were noted; what a killed batch left behind is not noted."""
    paths = [f"{root}/rows/{name}" for name in names(spark, f"{root}/commits")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def land_once(root: str, key: str, time: str, keep: str = "30 days", reread: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that lands each id once, also if the stream starts again from an older checkpoint or from none.

    A batch's rows are held against the noted rows from `keep` before its first to `keep` after its last (pushed down to the
    files), not against its number, as a replay may cut batches elsewhere. Of rows with one id in a batch the earliest
    stays. Rows are written under a name of their own and noted by one atomic step, so a batch that dies has landed nothing.
    An id that comes again more than `keep` after is a new event. Rows without an id or a time are landed each time: nothing
    tells them apart. One stream writes a root at a time. A batch is kept while it lands, as it is read for its first and
    last times and again for its rows; with `reread`, for streams that only read files, it is read anew from these, of which
    the times alone cost little.
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commit = f"{number:012d}-{uuid.uuid4().hex}"
        path = f"{root}/rows/{commit}"
        if not reread:
            batch.persist()
        known = landed(spark, root, batch.schema)
        first, last = batch.agg(F.min(time), F.max(time)).first() if names(spark, f"{root}/commits") else (None, None)
        if first is not None:
            span = F.expr(f"INTERVAL {keep}")
            known = known.where(F.col(time).between(F.lit(first) - span, F.lit(last) + span))
        told = F.col(key).isNotNull() & F.col(time).isNotNull()
        rest = [c for c in batch.columns if c != key]
        once = batch.where(told).groupBy(key).agg(F.min_by(F.struct(*rest), time).alias("_row")).select(key, "_row.*").select(*batch.columns)
        fresh = once.join(known.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
        fresh.unionByName(batch.where(~told)).write.parquet(path)
        claim(spark, f"{root}/commits", commit)
        if not reread:
            batch.unpersist()

    return land

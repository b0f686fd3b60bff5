"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space and the words between it, in Java regex syntax.
WHITE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filesystem_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where it is unset, a fresh local one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that lineage ends there.

    The table needs the write's shuffle files no more, so Spark drops them as it ends; the session's setting stays as it was.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the folder of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, path = _filesystem_path(spark, folder)
        files.delete(path, True)


def settle(spark: SparkSession) -> None:
    """Collects the driver's heap, so that Spark lets go of what earlier steps left (plans, broadcasts, shuffles) and the heap shrinks."""
    spark.sparkContext._jvm.java.lang.System.gc()


def named(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, leave: str | None = None, **columns: Column) -> DataFrame:
    """``columns`` beside ``row``, a struct of all of ``docs``, so that names of the input can't clash with an operator's own.

    ``leave``: a column that isn't needed again, unless it is the only one.
    """
    kept = [c for c in docs.columns if c != leave] or docs.columns
    return docs.select(F.struct(*map(named, kept)).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, *results: str) -> DataFrame:
    """The input's columns out of ``row``, but for those named like a result, and the results."""
    taken = {r.lower() for r in results}
    return df.select(*[F.col("row").getField(c).alias(c) for c in df.schema["row"].dataType.names if c.lower() not in taken], *results)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, although lambdas in ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value``, marked so that it stays a column of its own.

    The optimizer copies a deterministic expression into filters and lambdas above it, where it would be
    computed again for each use or element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also map other alphabets)."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")

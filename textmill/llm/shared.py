"""Intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship() -> None:
    """Send this package's functions to Python workers by value."""
    import textmill

    cloudpickle.register_pickle_by_value(textmill)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``.

    Where that is unset and the session is local, as in tests, a temporary folder
    is set; on a cluster it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it from there; it outlives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are written.

    Its cleaner goes by the garbage collection of the driver, and the driver holds on to
    the last job until another has run.
    """
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``a > b``."""
    pairs = edges.select("a", "b")
    if large:
        pairs = pairs.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of an edge table ``(a, b)`` of bigints.

    The component is its smallest node. Alternating star steps move every edge to the
    smallest known node; each pass is two groupings, writes a table and about halves
    the depth, so that a few passes do whatever the shape. No group is collected.
    """
    spark = edges.sparkSession
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        edges = written(_star(_star(edges, True), False))
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    return spark.createDataFrame([], out.schema) if before is None else out

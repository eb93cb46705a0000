"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_package() -> None:
    """Send this package's functions to Python workers by value.

    The workers then need no copy of the package on their path.
    """
    import textmill

    cloudpickle.register_pickle_by_value(textmill)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the cluster where the input has too few files to do so.

    A corpus of many files is already well split and is left alone; a handful of
    files (often one row group each) would keep a narrow plan on a few tasks.
    """
    if df.isStreaming:
        return df
    width = df.sparkSession.sparkContext.defaultParallelism
    # Counted in the JVM: the names of a large corpus need not come to Python.
    if len(df._jdf.inputFiles()) >= width:
        return df
    return df.repartition(4 * width, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back.

    For results several later steps need that are far smaller than their input or
    costly to redo. The written table survives the loss of executors, and its file
    size lets Spark decide whether a join may broadcast it.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession) -> str:
    """A new folder for intermediate files in the shared folder the session names.

    Where it names none, a local session, as in tests, sets a folder of this machine;
    on a cluster the folder has to be set, as executors could not read each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"

"""Session helpers: lineage cuts in shared storage and shipping of Python code."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and the master
    is local, as in tests, a temporary folder of this machine is set.
    """
    found = spark.conf.get(_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_CONF} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set(_CONF, found)
    return found


def place(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; ``release`` deletes it with all that was written there."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the
    work before the cut, and a reader that needs few columns reads only those.
    """
    spark = df.sparkSession
    path = place(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Delete the folders that ``place`` named and ``cut`` wrote; call it once the results built on them have been written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)


#: Rows and bytes of one Arrow batch, for every operator, so that no plan depends on which was built last.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches, which bounds a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ship(module) -> None:
    """Pickle a module's functions by value, so that executors need no copy of it."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)


def share(spark: SparkSession, value):
    """Broadcast an object with its class by value; ``received`` reads it in a worker.

    For objects of a bounded size only: models and blocks of a query set.
    """
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    import pickle

    return pickle.loads(shared.value)

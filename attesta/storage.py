"""The folder that all machines share, and tables that operators keep there between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (local mode, tests) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows of a partition at most, where rows are dealt out.
SPREAD = 100_000


def partitions(df: DataFrame, rows: int = SPREAD) -> int:
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, *keys: str, rows: int = SPREAD) -> DataFrame:
    """The rows of a table dealt out by keys: over all cores, and to more partitions as it grows. For rows whose work is long
    however few bytes they have, as Spark deals files out by bytes. Operators that group by these keys need no other shuffle."""
    return df.repartition(partitions(df, rows), *keys)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the table that stored() gave, once nothing reads it any more."""
    folder = {f.rpartition("/")[0] for f in df.inputFiles()}
    for f in folder if len(folder) == 1 else ():
        delete(df.sparkSession, f)

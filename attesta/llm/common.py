"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all contracts here mean it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to Python: long texts and whole sets would else come ten thousand at a time.
BATCH_BYTES, BATCH_DEFAULT, BATCH_CONF = "4m", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, each by its exact name (the first of them when a name occurs twice), and nothing else: extra columns, also ones whose names differ only in case, can't clash with those an operator adds."""
    place = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return place.select(*(F.col(f"_{df.columns.index(n)}").alias(n) for n in names))


def placed(df: DataFrame) -> DataFrame:
    """df with its columns named by position (_0, _1, ...), so that none clashes with what an operator adds."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def place_of(df: DataFrame, name: str) -> Column:
    """The column of placed(df) that df names so."""
    return F.col(f"_{df.columns.index(name)}")


def as_before(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Rows that came from placed(df), with df's columns and nothing else."""
    return rows.select(*(F.col(f"_{i}") for i in range(len(df.columns)))).toDF(*df.columns)


def _released(f: Callable) -> Callable:
    """f, after which a worker gives back what it no longer needs: workers live on, and their memory counts as the executor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def through_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size, by workers that release their memory at the end of a task."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == BATCH_DEFAULT:  # else the session has a limit of its own
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(_released(f), schema)


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


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, in the shared folder, so that no lost executor makes Spark compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def forget(df: DataFrame) -> None:
    """Deletes the table that stored() gave, once nothing reads it any more."""
    folder = {f.rpartition("/")[0] for f in df.inputFiles()}
    for f in folder if len(folder) == 1 else ():
        delete(df.sparkSession, f)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def not_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def vocabulary(name: str) -> str:
    """Where a file of the public tokenizers lies, unless a query is told another path."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)

"""Shared-folder staging of intermediate tables.

Lineage is cut by writing a table below the folder that the cluster names in ``spark.checkpoint.dir``
(all executors share it), never by a local checkpoint. A lost executor therefore costs a re-read, and
columns that a consumer does not need are pruned by the Parquet scan.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages and row groups of long texts stay below what the JVM's collector treats as humongous objects.
SMALL_PAGES = {"compression": "zstd", "parquet.page.size": str(1 << 18), "parquet.block.size": str(16 << 20)}
_STAGED: dict[str, list[str]] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset, a temporary folder in local mode and the
    warehouse (shared as well) on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        chosen = "file://" + tempfile.mkdtemp(prefix="tallyhound-")
    else:
        chosen = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.options(**SMALL_PAGES).parquet(path)
    # Spark removes shuffle files once their plan is collected, else only at spark.cleaner.periodicGC.interval
    spark._jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete a staged table of which all that is still to be read has been written elsewhere."""
    path, spark = _PATHS.pop(staged), staged.sparkSession
    _STAGED[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str = "__row") -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, row: str = "__row") -> DataFrame:
    """``df``, written with a number for each row: the identity of rows whose ids may be null or repeat."""
    return stage(df.withColumn(row, F.monotonically_increasing_id()), name)


def with_class(rows: DataFrame, classes: DataFrame, key: str, size: str, least: int) -> DataFrame:
    """rows joined with their classes. Those of more than ``least`` members (rows / least of them at most, so the
    caller bounds the list) are broadcast, so that no task gets all rows of a hot class."""
    hot, rest = classes.filter(F.col(size) > least), classes.filter(F.col(size) <= least)
    often = rows.join(F.broadcast(hot), key)
    return often.unionByName(rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti").join(rest, key))


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system; other tasks may need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Delete what this application staged; call it once the results are written."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Tables written to cut lineage, in the folder that the session names and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table of more rows isn't broadcast unless it is asked for: its files, by which its size is judged, are many times smaller than its rows.
SMALL_ROWS = 100_000
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that ``spark.checkpoint.dir`` names. A folder is chosen only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = "file://" + tempfile.mkdtemp(prefix="tallyhound-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read back: lineage is cut, all executors can read it again, and it is
    computed once."""
    path = shared_folder(frame.sparkSession)
    counted = Observation()
    frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    kept = frame.sparkSession.read.schema(frame.schema).parquet(path)
    if counted.get["rows"] > SMALL_ROWS:
        kept = kept.hint("merge")
    _PATHS[kept] = path
    return kept


def forget(kept: DataFrame) -> None:
    """Delete a table of ``checkpointed`` of which all that is still to be read has been written elsewhere."""
    spark, path = kept.sparkSession, _PATHS.pop(kept)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Checkpoints of one algorithm, deleted when its ``with`` block ends; only what ``result`` wrote stays."""

    def __enter__(self) -> Scratch:
        self.kept: list[DataFrame] = []
        return self

    def __call__(self, frame: DataFrame) -> DataFrame:
        self.kept.append(checkpointed(frame))
        return self.kept[-1]

    def forget(self, *frames: DataFrame) -> None:
        for f in frames:
            self.kept = [k for k in self.kept if k is not f]
            forget(f)

    result = staticmethod(checkpointed)

    def __exit__(self, *_: object) -> None:
        self.forget(*self.kept)

"""Stored tables that change together or not at all.

Data folders are written first and never change; a version is one small manifest that names the folders of every table. Committing
publishes the next manifest under a name that may not exist yet, so of two writers that began at the same version one wins and
the other raises ``LostRace`` and leaves nothing that anyone reads. Readers see one version throughout.

Keyed tables lie in buckets of their key's hash, and an upsert reads and writes only the buckets that its rows fall into. Rows are counted while
they are written. Publishing is atomic on HDFS and on local disks; an object store needs a rename that fails where the target exists.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhound.checkpoints import Scratch

BUCKETS = 64


class LostRace(RuntimeError):
    """Someone else committed first; begin again from the newest version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = jvm.Path(self.root).getFileSystem(self._conf)
        self._files.mkdirs(jvm.Path(f"{self.root}/versions"))

    def _manifest(self, version: int) -> str:
        return f"{self.root}/versions/{version:012}.json"

    def newest(self) -> int:
        """The number of the newest version; 0 while there is none."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.newest() if version is None else version
        if version == 0:
            return {"version": 0, "note": "", "tables": {}}
        return json.loads(self.spark.read.text(self._manifest(version), wholetext=True).first()[0])

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"].get(table)
        if entry is None:
            raise KeyError(f"no table {table}")
        return self._read(entry)

    def _read(self, entry: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.root}/{p}" for b, parts in entry["parts"].items() if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data folders that none of the ``keep`` newest versions names; how many went. No transaction may be open."""
        newest = self.newest()
        used = {p.split("/_bucket=")[0] for v in range(max(1, newest - keep + 1), newest + 1) for e in self.manifest(v)["tables"].values() for parts in e["parts"].values() for p in parts}
        gone = 0
        data = self._path(f"{self.root}/data")
        for table in self._files.listStatus(data) if self._files.exists(data) else []:
            for folder in self._files.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in used:
                    self._files.delete(folder.getPath(), True)
                    gone += 1
        return gone

    def _publish(self, version: int, manifest: dict) -> None:
        target, draft = self._manifest(version), f"{self.root}/versions/draft-{uuid.uuid4().hex}"
        out = self._files.create(self._path(draft), False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:
            if self._files.getScheme() == "file":
                os.link(self._path(draft).toUri().getPath(), self._path(target).toUri().getPath())
            elif self._files.exists(self._path(target)) or not self._files.rename(self._path(draft), self._path(target)):
                raise FileExistsError(target)
        except FileExistsError as e:
            raise LostRace(f"version {version} is there already") from e
        finally:
            self._files.delete(self._path(draft), False)


class Transaction:
    """Changes to several tables. Each sees the version that the transaction began at and the changes before it."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.tables = json.loads(json.dumps(self.base["tables"]))
        self.counts: dict[str, dict] = {}

    def read(self, table: str) -> DataFrame | None:
        return self.store._read(self.tables[table]) if table in self.tables else None

    def _write(self, table: str, frame: DataFrame, by_bucket: bool, metrics: dict | None = None) -> tuple[str, dict]:
        folder, seen = f"data/{table}/{uuid.uuid4().hex}", Observation()
        watched = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()])
        writer = watched.write.option("compression", "zstd")
        (writer.partitionBy("_bucket") if by_bucket else writer).parquet(f"{self.store.root}/{folder}")
        return folder, dict(seen.get)

    def append(self, table: str, frame: DataFrame, metrics: dict | None = None) -> dict:
        """Adds rows; what there is is neither read nor written. ``metrics``: aggregates over the rows, taken in the write. The counts."""
        entry = self.tables.setdefault(table, {"schema": frame.schema.jsonValue(), "keys": [], "parts": {"": []}, "rows": 0})
        if entry["keys"]:
            raise ValueError(f"{table} has keys: upsert into it")
        wanted = StructType.fromJson(entry["schema"])
        folder, seen = self._write(table, frame.select([F.col(f.name).cast(f.dataType) for f in wanted]), False, metrics)
        entry["parts"][""].append(folder)
        entry["rows"] += seen["rows"]
        self.counts[table] = seen
        return seen

    def upsert(self, table: str, frame: DataFrame, keys: list[str], metrics: dict | None = None) -> dict:
        """Inserts rows, or updates the columns that ``frame`` has in the rows of the same keys. Two rows of one key are an error."""
        entry = self.tables.setdefault(table, {"schema": frame.schema.jsonValue(), "keys": keys, "buckets": BUCKETS, "parts": {}, "rows": 0})
        if entry["keys"] != keys:
            raise ValueError(f"{table} has the keys {entry['keys']}")
        names = [f["name"] for f in entry["schema"]["fields"]]
        if set(frame.columns) - set(names):
            raise ValueError(f"{table} has no {', '.join(sorted(set(frame.columns) - set(names)))}")
        types = {f.name: f.dataType for f in StructType.fromJson(entry["schema"])}
        bucket = lambda key: F.pmod(F.xxhash64(*map(key, keys)), F.lit(entry["buckets"])).cast("int")
        typed = frame.select(*[F.col(c).cast(types[c]).alias(c) for c in frame.columns])
        with Scratch() as keep:
            # computed once: it is checked, dealt and joined
            fresh = keep(typed.withColumn("_bucket", bucket(F.col)))
            twice = fresh.groupBy(*keys).count().filter("count > 1").first()
            if twice:
                raise ValueError(f"{table}: two rows for {[twice[k] for k in keys]}")
            # at most as many rows as there are buckets
            touched = {str(r[0]) for r in fresh.select("_bucket").distinct().collect()}
            old_rows = 0
            if touched & set(entry["parts"]):
                here = self.store._read(entry, touched)
                old_rows = here.count()
                given = fresh["_bucket"].isNotNull()
                value = lambda c: F.when(given, fresh[c]).otherwise(here[c]) if c in frame.columns else here[c]
                every = fresh.join(here, [fresh[k].eqNullSafe(here[k]) for k in keys], "full")
                merged = every.select(*[value(c).alias(c) for c in names], F.coalesce(fresh["_bucket"], bucket(lambda k: here[k])).alias("_bucket"))
            else:
                merged = fresh.select(*[(F.col(c) if c in frame.columns else F.lit(None).cast(types[c])).alias(c) for c in names], "_bucket")
            folder, seen = self._write(table, merged.repartition("_bucket"), True, metrics)
        entry["parts"] |= {b: [f"{folder}/_bucket={b}"] for b in touched}
        entry["rows"] += seen["rows"] - old_rows
        self.counts[table] = seen | {"touched": len(touched)}
        return self.counts[table]

    def commit(self, note: str = "") -> int:
        """Publishes all changes as the next version; ``LostRace`` if another was published since the transaction began."""
        version = self.base["version"] + 1
        self.store._publish(version, {"version": version, "note": note, "tables": self.tables})
        return version

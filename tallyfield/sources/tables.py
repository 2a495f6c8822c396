"""Readers and writers of the domain tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES


def conform(frame: DataFrame, name: str) -> DataFrame:
    """The columns of a table in its order and types; extra columns are dropped."""
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema.fields])


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A typed table from Parquet; filters and the chosen columns reach the scan."""
    return spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}")


def scan_mysql(spark: SparkSession, url: str, name: str, partitions: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A typed table over JDBC, read in ranges of the numeric id when bounds are given; needs a MySQL driver jar."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"`{name}`", **options)
    if bounds:
        reader = reader.options(partitionColumn="id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return conform(reader.load(), name)


def scan_images(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """Image files below a folder: path, modificationTime, length, content (read only where selected)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)


def write_snapshot(frame: DataFrame, path: str) -> None:
    """The latest leaderboard replaces the last."""
    conform(frame, "leaderboard_snapshot").write.mode("overwrite").parquet(path)


def append_ledger(frame: DataFrame, path: str, once: bool = False) -> None:
    """Ledger rows are added, never rewritten; with ``once``, rows whose id is there are left out, so that a retry adds nothing."""
    rows = conform(frame, "point_record")
    if once and _files(frame.sparkSession, path)[2]:
        rows = rows.join(frame.sparkSession.read.parquet(path).select("id"), "id", "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, the path, and whether it exists."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, where, files.exists(where)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below the checkpoints, or a local one for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir()}/season-{uuid.uuid4().hex}"


class VersionedStore:
    """Several tables that change together: a version is written whole, then one pointer file is replaced.

    Readers resolve the pointer once and so never see half a change; a job that dies leaves only an
    unreferenced version behind. One commit runs at a time: a lock file, created only where there is none,
    makes a second writer fail instead of losing the first one's tables; one that died leaves its lock to be
    removed by hand.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> dict[str, str]:
        """Table to folder."""
        _, pointer, there = _files(self.spark, f"{self.root}/CURRENT")
        return json.loads(self.spark.read.text(pointer.toString()).first()[0]) if there else {}

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write the changed tables, then make them current together."""
        files, lock, there = _files(self.spark, f"{self.root}/LOCK")
        if there:
            raise RuntimeError(f"another commit holds {lock.toString()}")
        files.create(lock, False).close()
        try:
            self._commit(tables)
        finally:
            files.delete(lock, False)

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        version = uuid.uuid4().hex
        now = self.current()
        for name, frame in tables.items():
            now[name] = f"{self.root}/{version}/{name}"
            conform(frame, name).write.parquet(now[name])
        files, pointer, _ = _files(self.spark, f"{self.root}/CURRENT")
        jvm = self.spark._jvm
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT-{version}")
        out = files.create(fresh, True)
        out.write(bytearray(json.dumps(now), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration()) if pointer.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, pointer, option)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name].schema).parquet(self.current()[name])


def orphan_files(images: DataFrame, proofs: DataFrame) -> DataFrame:
    """Saved files that no proof refers to, by path."""
    return images.select(F.col("path").alias("image_url")).join(proofs.select("image_url"), "image_url", "left_anti")

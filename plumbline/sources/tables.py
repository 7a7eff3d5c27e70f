"""Versioned tables in a shared folder: rows are written first, and one small file, made only if it is not there yet, adds them.

    root/data/<uuid>/bucket=<k>/part-*.parquet     rows of one run, by a hash of their key
    root/commits/<number>                          the name of a run's data

Any number of runs may write at once, on a file system that lets one of them create a file that is not there (HDFS does;
object stores need conditional writes). A number is taken by creating its file, when all files before it are whole; another
run takes the next. What has no commit is never read, so a run that is lost halfway leaves nothing that counts; a commit
file that stays empty for PATIENCE seconds is a lost driver's and counts as none. Of rows with one key the first
commit's is the table's row, for every reader and for good.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
PATIENCE = 10.0


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; on one machine a temporary one is set where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/plumbline/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """The table, written to the shared folder and read back, so that nothing works it out again."""
    at = scratch_dir(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Files:
    """The few file operations that commits need, on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root, spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file that is not there yet; false if it is."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """Rows (key string, and more columns) of which each key has one, whoever wrote it first."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets
        self.files = Files(spark, self.root)

    def versions(self, patience: float = PATIENCE) -> list[tuple[int, str]]:
        """(number, name of the data) of all commits, in order; waits for one that is being written."""
        found, until = [], time.monotonic() + patience
        for n in (x for x in self.files.names("commits") if x.isdigit()):
            while len(name := self.files.text(f"commits/{n}")) < 32 and time.monotonic() < until:
                time.sleep(0.1)
            if len(name) == 32:
                found.append((int(n), name))
        return found

    def stage(self, rows: DataFrame) -> str:
        """Writes rows, which nobody reads before `commit`; returns the data's name. Of a key's rows in one run the least counts, null keys are left out."""
        name = uuid.uuid4().hex
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema if f.name != "key"]
        once = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct(*columns)).alias("row")).select("key", "row.*")
        bucketed = once.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        bucketed.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        return name

    def commit(self, name: str) -> int:
        """Adds staged rows under the next free number."""
        while True:
            self.versions()
            number = max((int(n) for n in self.files.names("commits") if n.isdigit()), default=-1) + 1
            if self.files.create(f"commits/{number:012d}", name):
                return number

    def append(self, rows: DataFrame) -> int:
        return self.commit(self.stage(rows))

    def read(self) -> DataFrame:
        """(key, ...) of the commits that are there now, the first commit's row of each key."""
        found = self.versions()
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        empty = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        rows = None
        for number, name in found:
            part = self.spark.read.schema(empty.schema).parquet(f"{self.root}/data/{name}").select(*columns, F.lit(number).cast("long").alias("version"))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return empty.select(*columns)
        if len(found) == 1:
            return rows.select(*columns)
        others = [c for c in columns if c != "key"]
        return rows.groupBy("key").agg(F.min_by(F.struct(*others), "version").alias("row")).select("key", "row.*").select(*columns)

    def compact(self) -> int:
        """Writes the table as it is now into one commit and drops the data of those before it; for a time without other writers."""
        before = self.versions()
        number = self.append(self.read())
        for n, name in before:
            self.files.delete(f"commits/{n:012d}")
            self.files.delete(f"data/{name}")
        return number

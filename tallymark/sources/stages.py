"""Tables that several steps of one job read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import count

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a temporary folder, any other raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, path: str | None = None, mode: str = "errorifexists") -> None:
    """A table in buckets of the keys, one file each, sorted by them; path: where its files go, else the warehouse."""
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


#: Rows of one bucket of a store, about.
BUCKET_ROWS = 500_000


def buckets_for(rows: DataFrame, least: int = 8) -> int:
    """How many buckets keep each one near BUCKET_ROWS, however many rows there are."""
    return max(least, -(-rows.count() // BUCKET_ROWS))


class Stages:
    """Written tables of one job. As a context manager it deletes, at the end, all but those that hold the result.

    A written table cuts the lineage: what reads it doesn't plan the steps before it again, and a lost executor costs the
    step that runs, not the job.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self._open, self._tables, self._number = spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", {}, {}, count()

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{next(self._number)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._open[path] = out
        return out

    def write_together(self, *dfs: DataFrame) -> list[DataFrame]:
        """Tables that don't read each other, written at the same time: a short job fills the cores that a long one leaves."""
        return self._together(self.write, dfs)

    def results_together(self, *dfs: DataFrame) -> list[DataFrame]:
        return self._together(self.result, dfs)

    def _together(self, write, dfs) -> list[DataFrame]:
        if len(dfs) < 2:
            return [write(df) for df in dfs]
        with ThreadPoolExecutor(len(dfs)) as pool:
            return [job.result() for job in [pool.submit(inheritable_thread_target(self.spark)(write), df) for df in dfs]]

    def bucketed(self, df: DataFrame, buckets: int, *keys: str) -> DataFrame:
        """Written in buckets of the keys, sorted by them in each: joins, windows and aggregates on them don't shuffle."""
        path, name = f"{self.folder}/{next(self._number)}", f"bucketed_{uuid.uuid4().hex}"
        write_bucketed(df, name, buckets, *keys, path=path)
        self._open[path] = out = self.spark.table(name)
        self._tables[path] = name
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """A table that outlives the job: small, or what the caller asked for."""
        path = f"{self.folder}/result-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more (all of them where none is named)."""
        for path in [p for p, df in self._open.items() if not tables or any(df is t for t in tables)]:
            if self._open[path] is not None:
                if path in self._tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(path)}")
                delete(self.spark, path)
                self._open[path] = None

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.release()

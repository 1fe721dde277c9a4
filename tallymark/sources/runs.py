"""Batches over keys that can be stopped and taken up again: an append-only log and one folder of rows per attempt."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import delete

LOG = "attempt int, key string, status string, n_rows long, elapsed_seconds double, error string"


class Runs:
    """Rows of a folder by key, and the log of how they came.

    An attempt writes its rows to data/attempt=N and then its log to log/attempt=N. It counts once its log is whole (has
    its mark of success); N is the number after the last one that counts. So an attempt that stops before or while its log
    is written leaves nothing that is read: its keys are done again under the same number, over what it left.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder, key

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def last_attempt(self) -> int:
        n = 0
        while self._exists(f"{self.folder}/log/attempt={n + 1}/_SUCCESS"):
            n += 1
        return n

    def log(self) -> DataFrame:
        """attempt, key, status (success, failed, skipped), n_rows, elapsed_seconds (where the work tells it) and error."""
        paths = [f"{self.folder}/log/attempt={n}" for n in range(1, self.last_attempt() + 1)]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _last(self) -> DataFrame:
        """The last attempt of each key that wasn't skipped, and its status."""
        done = self.log().where("status <> 'skipped'")
        return done.groupBy("key").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"))

    def rows(self) -> DataFrame | None:
        """Rows of each key's last attempt, where that succeeded; None before the first attempt."""
        n = self.last_attempt()
        if not n:
            return None
        parts = [self.spark.read.parquet(f"{self.folder}/data/attempt={i}").withColumn("_attempt", F.lit(i)) for i in range(1, n + 1)]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        good = self._last().where("status = 'success'").select(F.col("key").alias("_key"), F.col("attempt").alias("_attempt"))
        return rows.withColumn("_key", F.col(self.key).cast("string")).join(good, ["_key", "_attempt"], "left_semi").drop("_key", "_attempt", "_error", "_seconds")

    def run(self, targets: DataFrame, work: Callable[[DataFrame], DataFrame], retry_failed: bool = True, before_log: Callable[[], None] | None = None) -> dict:
        """One attempt: targets that haven't succeeded (nor, without retry_failed, failed) go through work; counts of it.

        work gives rows of its targets with the key; a column _error marks a row that tells why a key failed, _seconds how
        long it took. A key with an error fails whole; one without rows fails as NO_ROWS. before_log is called between the
        writing of rows and log (for tests).
        """
        began, attempt = time.time(), self.last_attempt() + 1
        keys = targets.select(self.key).distinct().withColumn("key", F.col(self.key).cast("string"))
        before = self._last().where("status = 'success'" if retry_failed else "status IN ('success', 'failed')").select("key", F.lit(True).alias("_done"))
        marked = keys.join(before, "key", "left")
        todo = marked.where("_done IS NULL").select(self.key)
        made = work(targets.join(todo, self.key, "left_semi"))
        for name, kind in (("_error", "string"), ("_seconds", "double")):
            if name not in made.columns:
                made = made.withColumn(name, F.lit(None).cast(kind))
        data, log = f"{self.folder}/data/attempt={attempt}", f"{self.folder}/log/attempt={attempt}"
        made.write.mode("overwrite").parquet(data)
        if before_log:
            before_log()
        written = self.spark.read.schema(made.schema).parquet(data)
        by = written.groupBy(F.col(self.key).cast("string").alias("key")).agg(F.count_if(F.col("_error").isNull()).alias("n"), F.max("_error").alias("e"), F.sum("_seconds").alias("s"))
        status = F.when(F.col("_done"), "skipped").when(F.col("n").isNull() | F.col("e").isNotNull() | (F.col("n") == 0), "failed").otherwise("success")
        error = F.when(status == "failed", F.coalesce("e", F.lit("NO_ROWS")))
        lines = marked.join(by, "key", "left").select(F.lit(attempt).alias("attempt"), "key", status.alias("status"), F.when(status == "success", F.col("n")).otherwise(0).alias("n_rows"), F.col("s").alias("elapsed_seconds"), error.alias("error"))
        if self._exists(log):
            delete(self.spark, log)
        lines.write.parquet(log)
        return self.counts(attempt) | {"elapsed_seconds": round(time.time() - began, 2)}

    def counts(self, attempt: int) -> dict:
        """Targets, those done before, the rest, how these went in the attempt, and what there is in all after it."""
        now = self.log().where(F.col("attempt") == attempt)
        n = {r[0]: r[1] for r in now.groupBy("status").count().collect()}  # three rows
        final = {r[0]: r[1] for r in self.log().where(F.col("attempt") <= attempt).where("status <> 'skipped'").groupBy("key").agg(F.max_by("status", "attempt").alias("status")).groupBy("status").count().collect()}
        skipped, good, bad = (n.get(s, 0) for s in ("skipped", "success", "failed"))
        return {"target_count": skipped + good + bad, "existing_count": skipped, "remaining_count": good + bad, "current_success": good, "current_failure": bad, "final_success_count": final.get("success", 0), "final_error_count": final.get("failed", 0)}

"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a session on one machine (master local) gets a
    temporary one; any other raises, since its executors don't share a local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = vars(df).pop("scratch_path", None) if df is not None else None
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, *columns: str) -> int:
    """UTF-8 bytes of text columns (items of others), summed over all rows."""
    sizes = [F.octet_length(c) if t in ("string", "binary") else F.size(c) for c, t in df.select(*columns).dtypes]
    one = sizes[0] if len(sizes) == 1 else F.aggregate(F.array(*sizes), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return df.agg(F.sum(one.cast("long"))).first()[0] or 0


def groups_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """How many groups keep each one near `each` bytes, however large the data; at least one for every task at a time."""
    return max(-(-n_bytes // each), spark.sparkContext.defaultParallelism)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column | str) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    inner = F.trim(text, F.lit(SPACE))
    return F.when(F.length(F.coalesce(inner, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RE))

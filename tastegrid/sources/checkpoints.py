"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a pass of stash_in_passes deals with, and passes at most: beyond that a pass has its share of the rows.
PASS_ROWS, MOST_PASSES = 4_000_000, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset in a session on one machine, as in tests, a temporary one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tastegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return it read back; lost executors then cost a read."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stashed_at = path
    return back


def stash_in_passes(tables: list[DataFrame], key: str, f: Callable[..., DataFrame], label: str, rows: int) -> DataFrame:
    """Stash f(*tables), where f works on all rows of a `key` alone: some keys at a time, so the shuffle files of one pass are on disk and not those of all.

    The tables are read once for each pass and should be stored; rows: how many they have.
    """
    spark = tables[0].sparkSession
    n = min(MOST_PASSES, max(1, -(-rows // PASS_ROWS)))
    path, schema = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", None
    for i in range(n):
        # Not the hash by which rows are shuffled: that would leave most tasks of a pass without rows.
        own = f(*[t if n == 1 else t.where(F.pmod(F.xxhash64(F.col(key), F.lit(label)), F.lit(n)) == i) for t in tables])
        own.write.mode("append").option("compression", "zstd").parquet(path)
        schema = own.schema
        del own
        release(spark)
    back = spark.read.schema(schema).parquet(path)
    back.stashed_at = path
    return back


def kept_at(df: DataFrame, *stashed: DataFrame) -> DataFrame:
    """df, which reads `stashed` alone and costs little more than that, as a table that goes with them; as it is if one is in no stash."""
    if all(hasattr(t, "stashed_at") for t in stashed):
        df.stashed_at = [path for t in stashed for path in _paths(t)]
    return df


def _paths(stashed: DataFrame) -> list[str]:
    return [stashed.stashed_at] if isinstance(stashed.stashed_at, str) else stashed.stashed_at


def discard(df: DataFrame) -> None:
    """Delete the table that `stash` returned as df.  Only for tables whose every reader has itself been written: a lost executor must find what it reads."""
    spark = df.sparkSession
    for at in _paths(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written: it does so once the driver's garbage, which refers to them, is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

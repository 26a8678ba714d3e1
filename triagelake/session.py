"""Session helpers: table access and lineage cuts in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Where the cluster names none (tests, local runs) a temporary folder is
    made once for the process and set as the checkpoint folder.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if _own_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir = tempfile.mkdtemp(prefix="triagelake-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, dropped when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Drop what this process staged, where the folder is a mounted one;
    object stores expire it by their own rules."""
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)


def together(*steps):
    """Results of independent steps that each run jobs of their own, side by
    side, so that small jobs don't wait for each other."""
    out: list = [None] * len(steps)
    failed: list[BaseException] = []

    def run(k: int) -> None:
        try:
            out[k] = steps[k]()
        except BaseException as e:  # raised where the steps were asked for
            failed.append(e)

    threads = [InheritableThread(target=run, args=(k,)) for k in range(len(steps))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return out


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut.

    The columnar files survive the loss of any executor, are compressed, and
    let later readers prune columns and row groups.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None, salts: int = 16
) -> DataFrame:
    """Join a large ``left`` to ``right`` that has one row per ``key``.

    ``hot`` lists the key values known to hold many rows of ``left``; their
    rows are spread over ``salts`` buckets and the matching right rows are
    repeated once per bucket, so no task receives a whole hot key.  ``hot`` is
    a statistic of bounded size (keys holding more than a fixed share).  Rows
    with a null key match nothing and are spread as well.
    """
    # from the row itself, so a task that runs again sends its rows the same way
    spread_row = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    k = F.col(f"`{key}`")
    is_hot = k.isin(hot) if hot else F.lit(False)
    salted = left.withColumn("_salt", F.when(k.isNull() | is_hot, spread_row).otherwise(F.lit(0)).cast("bigint"))
    if hot:
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        unique = right.withColumn("_salt", F.explode(copies.cast("array<bigint>")))
    else:
        unique = right.withColumn("_salt", F.lit(0).cast("bigint"))
    return salted.join(unique, [key, "_salt"], how).drop("_salt")


def join_split(left: DataFrame, right: DataFrame, key: str, hot: list, salts: int = 16) -> DataFrame:
    """Inner join on ``key`` where both sides may hold many rows of a key.

    Rows of ``left`` with a key in ``hot`` are spread over ``salts`` buckets,
    those of ``right`` are repeated in each, so the pairs of a hot key are
    made by that many tasks.
    """
    k = F.col(f"`{key}`")
    if not hot:
        return left.join(right, key)
    spread_row = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(k.isin(hot), spread_row).otherwise(F.lit(0)))
    copies = F.when(k.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")


def hot_keys(df: DataFrame, key: str | Column, share: float = 0.02) -> list:
    """Values of ``key`` that hold at least about ``share`` of the rows.

    One pass with a summary of fixed size in each task, no shuffle of the
    keys.  At most ``1 / share`` values can qualify, so the result is bounded
    whatever the size of the input; it steers the spreading of rows only.
    """
    col = F.col(key) if isinstance(key, str) else key
    n, top = df.agg(F.count(col), F.call_function("approx_top_k", col, F.lit(int(1 / share)), F.lit(8_192))).first()
    return [x["item"] for x in top or () if x["item"] is not None and x["count"] >= n * share]

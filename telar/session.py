"""What every operator needs from the session: reading, widths and checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Rows that one partition should hold at most, on average, where a scan has to see it whole.
ROWS_PER_PART = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan of few splits (one large file, say) spread over the cores by a hash of the key, for work that is dear per row.

    A scan that has a split for each core is left as it is: at scale nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, key)


def together(spark: SparkSession, *plans: Callable[[], DataFrame]) -> list[DataFrame]:
    """Plans that don't depend on each other: they are made, and their jobs (samples, checkpoints, summaries) run, side by side."""
    own = inheritable_thread_target(spark)
    with ThreadPoolExecutor(8) as pool:
        return [f.result() for f in [pool.submit(own(plan)) for plan in plans]]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``.
    Only where that is unset (tests, a laptop) a folder of this machine is used, which is
    removed at the end. A session that runs many queries should set
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, so that Spark drops checkpoints
    nobody refers to any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="telar-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)

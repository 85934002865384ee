"""Loading new readings as they come, by difference of keys instead of watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telar.operators.ranking import latest_by


def load_new(batch: DataFrame, facts_path: str, key: str, order: str, up_to: int | None = None) -> int:
    """Appends the batch's rows whose key the facts lack, once each; returns how many it appended.

    up_to: greatest key that is taken, so that a run ends whatever arrives meanwhile. Of the
    facts only those between the batch's least and greatest key are read, which Parquet's
    statistics narrow down to few files where keys rise with time; nothing is counted but
    what is written.
    """
    spark = batch.sparkSession
    values = [c for c in batch.columns if c not in (key, order)]
    own = batch.filter(F.col(key).isNotNull() if up_to is None else F.col(key) <= up_to)
    ends = own.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if ends.a is None:
        return 0
    new = latest_by(own, [key], [order], values).select(*batch.columns)
    try:
        new = new.join(spark.read.parquet(facts_path).select(key).filter(F.col(key).between(ends.a, ends.b)), key, "left_anti")
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
            raise
    written = Observation()
    new.select(*batch.columns).observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(facts_path)
    return written.get["n"]


def start(stream: DataFrame, facts_path: str, checkpoint: str, key: str, order: str, up_to: int | None = None) -> StreamingQuery:
    """Takes what is there and stops; late and out-of-order rows are new as long as their key is."""
    return stream.writeStream.foreachBatch(lambda batch, _: load_new(batch, facts_path, key, order, up_to) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

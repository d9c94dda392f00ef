"""Incremental runs: what is done is an output table and a stream's checkpoint, not a list in a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prefix_key


def run_available(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id_col: str = "id") -> None:
    """Apply `step` to all that has arrived, in micro-batches, and append to out. Rows whose id is in out are left out,
    so a batch that is run again after a failure adds nothing twice."""
    spark = stream.sparkSession

    def one(batch: DataFrame, _: int) -> None:
        fresh = batch
        if _exists(spark, out):
            fresh = batch.join(spark.read.parquet(out).select(id_col).distinct(), id_col, "left_anti")
        step(fresh).write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_wins(stream: DataFrame, n: int = 150, text: str = "text") -> DataFrame:
    """Stream of the first row to arrive of each prefix key; the state is the keys seen."""
    return stream.withColumn("_key", prefix_key(F.col(text), n)).dropDuplicates(["_key"]).drop("_key")


def progress(processed: DataFrame, input_price: float = 0.30, output_price: float = 1.20) -> DataFrame:
    """One row of counters over an output table of (id, failed, examples, tokens_in, tokens_out)."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return processed.agg(F.count(F.lit(1)).alias("processed"), s(F.col("failed").cast("int")).alias("failed"), s("examples").alias("examples"), s("tokens_in").alias("tokens_in"), s("tokens_out").alias("tokens_out"),
                         F.round(s("tokens_in") / 1e6 * input_price + s("tokens_out") / 1e6 * output_price, 4).alias("cost_usd"))

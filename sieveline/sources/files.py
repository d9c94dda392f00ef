"""Readers and writers: JSON lines, JSON envelopes, tagged unions, reports."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as S

#: Bytes above which a side is no longer broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` on all cores where its files have parts for less than half of them, as a file of one row group has. Filters
    above it aren't pushed down to that one task. Tables with parts enough are as they were."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() > cores:
        return df
    return df.repartition(cores).where(F.rand(0) >= 0)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a temporary folder of this machine in local mode only. The application's
    checkpoints go when it ends."""
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'sieveline-shared')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    _delete_at_end(spark, sc._jsc.sc().getCheckpointDir().get())  # this application's own folder under it
    return base


def _delete_at_end(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/sieveline-{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)  # only what is there is deleted at the end
    _delete_at_end(spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_bytes(df: DataFrame) -> int:
    """About the bytes that the rows of `df` take, strings and arrays by their length."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 24
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 16 + 24
        return F.lit(48 if isinstance(kind, T.StructType) else 16)

    each = sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(each.cast("bigint")), F.lit(0))).first()[0]


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows hold no more than `most` bytes; beyond that Spark chooses the join. Reads
    `df`, so it should be written or checkpointed."""
    return F.broadcast(df) if held_bytes(df) <= most else df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, messages): blank lines are skipped; what isn't an object with a list of message objects has null
    messages and is kept, so that it is counted. Bytes that aren't UTF-8 don't fail the scan."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line")).where("line <> ''")
    return lines.select("line", F.from_json("line", S.EXAMPLE)["messages"].alias("messages"))


def read_jsonl_strict(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_tagged(spark: SparkSession, paths: Iterable[tuple[str, str]]) -> DataFrame | None:
    """Union of JSONL paths, each with its _source and its rank; missing paths are left out."""
    out = None
    for rank, (path, source) in enumerate(paths):
        if exists(spark, path):
            one = read_jsonl(spark, path).withColumn("_source", F.lit(source)).withColumn("_rank", F.lit(rank))
            out = one if out is None else out.unionByName(one)
    return out


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ENVELOPE).json(path, multiLine=True).select(F.explode("chunks").alias("c")).select("c.*")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SCORE).json(path, multiLine=True)


def write_jsonl(examples: DataFrame, path: str, split: str | None = None) -> None:
    """One {"messages": ...} a line; other columns stay behind. With `split`, a directory for each value."""
    cols = ["messages", *([split] if split else [])]
    w = examples.select(*cols).write.mode("overwrite")
    (w.partitionBy(split) if split else w).json(path)


def write_chunks(chunks: DataFrame, path: str, manifest: DataFrame) -> None:
    """Chunks as JSON lines beside their manifest: an envelope that needs no single writer."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def _pieces(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """(n, a): the rows as arrays of at most `most` of them, with their number."""
    m = F.monotonically_increasing_id()
    numbered = rows.select(*names).withColumn("_m", m).select(F.shiftright("_m", 33).alias("_p"), F.floor(F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) / most).alias("_k"), F.struct(*names).alias("_c"))
    return numbered.groupBy("_p", "_k").agg(F.count(F.lit(1)).alias("n"), F.collect_list("_c").alias("a")).select("n", "a")


def _write_values(values: DataFrame, path: str) -> None:
    """One value a file: a reader of whole files takes the first value of each and leaves out what follows it."""
    values.write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def write_envelopes(chunks: DataFrame, path: str, rows: int = 10_000) -> None:
    """Chunks as envelopes of at most `rows` of them, one a file, as read_envelope() takes them."""
    whole = _pieces(chunks, [f.name for f in S.CHUNK], rows)
    _write_values(whole.select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("n").alias("sampled_count"), F.col("a").alias("chunks"))).alias("value")), path)


def write_scores(scores: DataFrame, path: str, rows: int = 100_000) -> None:
    """Scores as JSON arrays of at most `rows` of them, one a file, as read_scores() takes them."""
    _write_values(_pieces(scores, [f.name for f in S.SCORE], rows).select(F.to_json("a").alias("value")), path)


def write_report(report: DataFrame, output_dir: str, input_dir: str | None = None, dry_run: bool = False, name: str = "cleanup_report") -> str:
    """The report as JSON lines under output_dir; a dry run, which writes nothing else, leaves it beside the input.
    Returns the folder."""
    path = f"{input_dir if dry_run and input_dir else output_dir}/{name}"
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def append_tier(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("arena").parquet(path)

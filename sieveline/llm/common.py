"""Helpers that the training-data operators share: written tables, document counts, keyed hashes and cumulative hash
thresholds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import BROADCAST_BYTES, bounded, cut, held_bytes, scratch_path, spread, table  # noqa: F401 - for the operators

def scratch_table(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as compressed Parquet in the shared folder and read it back. Smaller on disk than a
    checkpoint and column-prunable; the folder goes when the application ends."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_counts(docs: DataFrame, text_col: str, n_terms: int, numberer: Callable) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each of n_terms terms), over all of docs. numberer() is called once a task and
    gives a function from texts to the numbers of the terms of each, once a text. Each task sends one count per term it
    met."""

    def count(batches):
        numbers, n, seen = numberer(), 0, np.zeros(n_terms, np.int64)
        for pdf in batches:
            n += len(pdf)
            texts = [t for t in pdf["t"] if t]
            for a in range(0, len(texts), 256):
                seen += np.bincount(numbers(texts[a : a + 256]), minlength=n_terms)
        held = np.flatnonzero(seen)
        yield pd.DataFrame({"term": np.r_[-1, held], "n": np.r_[n, seen[held]]})

    total = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(n_terms + 1, np.int64)
    seen[total["term"].to_numpy()] = total["n"].to_numpy()
    return int(seen[-1]), seen[:-1]


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that don't clash with those of `df`, ignoring case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_sv_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replace_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """`df` with these columns; an input column of the same name (in any case) gives way."""
    names = {c.lower() for c in cols}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[v.alias(k) for k, v in cols.items()])


def key_hash(col: Column, seed: str = "") -> Column:
    """60 bits of md5, as a bigint: the same number in any engine. A null key hashes like ''."""
    text = F.concat(F.lit(seed), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cumulative_thresholds(rows: DataFrame, group: str, h: str, weight: str, targets: DataFrame, bits: int = 60,
                          steps: tuple[int, ...] = (12, 24, 24), reach: bool = False) -> DataFrame:
    """Hash thresholds at which running weights reach targets, found without sorting the rows.

    rows: (group, h in [0, 2^bits), weight >= 0). targets: (group, target_id, target). Returns
    (group, target_id, target, threshold): the rows with h < threshold are the longest prefix by h whose weight
    is <= target; equal hashes stay together, and threshold is 2^bits where the whole group fits. reach: they are the
    shortest prefix whose weight is >= target.

    Level 0 sums weights per (group, top 12 bits). Only the bucket that a target falls into is summed again by the
    next bits, and so on; the shuffles carry partial sums. `steps` must add up to `bits`.
    """
    assert sum(steps) == bits
    shift = bits
    # lo: left edge of the open bucket; done: weight of all that lies before it.
    open_ = targets.select(F.col(group).alias("g"), "target_id", "target", F.lit(0).cast("bigint").alias("lo"),
                           F.lit(0).cast("bigint").alias("done"), F.lit(None).cast("bigint").alias("threshold"))
    base = rows.select(F.col(group).alias("g"), F.col(h).alias("h"), F.col(weight).cast("bigint").alias("w"))
    width = 1 << bits
    for take in steps:
        shift -= take
        bucket = F.shiftright("h", shift)
        if width == 1 << bits:
            cells = base.groupBy("g", bucket.alias("b")).agg(F.sum("w").alias("w"))
        else:
            edges = open_.where("threshold is null").select(F.col("g").alias("eg"), F.col("lo").alias("elo")).distinct()
            inside = base.join(bounded(edges), base.g.eqNullSafe(F.col("eg")) & (F.col("h") - F.pmod("h", F.lit(width)) == F.col("elo")), "left_semi")
            cells = inside.groupBy("g", bucket.alias("b")).agg(F.sum("w").alias("w"))
        cells = cut(cells)
        fits = Window.partitionBy("g", "parent").orderBy("b")
        run = cells.withColumn("parent", F.col("b") * (1 << shift) - F.pmod(F.col("b") * F.lit(1 << shift), F.lit(width)) if width < 1 << bits else F.lit(0).cast("bigint"))
        run = run.withColumn("upto", F.sum("w").over(fits)).select(F.col("g").alias("cg"), F.col("parent"), F.col("b"), F.col("w"), F.col("upto"))
        live, settled = open_.where("threshold is null"), open_.where("threshold is not null")
        # The first cell whose running weight exceeds (reaches) the target; none: the whole open range fits.
        upto = F.col("done") + F.col("upto")
        hit = (live.join(run, live.g.eqNullSafe(F.col("cg")) & (F.col("parent") == F.col("lo")) & (upto >= F.col("target") if reach else upto > F.col("target")), "left")
               .groupBy("g", "target_id", "target", "lo", "done").agg(F.min_by(F.struct("b", "w", "upto"), "b").alias("x")))
        nlo = F.col("x.b") * F.lit(1 << shift)
        moved = hit.select("g", "target_id", "target",
                           F.coalesce(nlo, F.col("lo")).alias("lo"),
                           F.when(F.col("x").isNull(), F.col("done")).otherwise(F.col("done") + F.col("x.upto") - F.col("x.w")).alias("done"),
                           F.when(F.col("x").isNull(), F.col("lo") + F.lit(width)).when(F.lit(shift == 0), nlo + int(reach)).alias("threshold"))
        open_ = cut(moved.unionByName(settled))
        width = 1 << shift
        if not open_.where("threshold is null").take(1):
            break
    return open_.select(F.col("g").alias(group), "target_id", "target", "threshold")

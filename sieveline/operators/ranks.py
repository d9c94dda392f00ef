"""Rows of given ranks within groups, found by histograms of a hexadecimal key: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import bounded, cut

#: Digits of the key that the first and the second histogram count by.
FIRST, SECOND = 3, 4


def group_key(groups: list[str]) -> Column:
    """One string for the values of the group columns, nulls included."""
    return F.to_json(F.struct(*groups)) if groups else F.lit("")


def thresholds(df: DataFrame, groups: list[str], key: Column, id_col: str, wanted: dict[str, Column]) -> DataFrame:
    """(_g, one struct(k, i, m, c) per name): for each group and name of `wanted` the key and id of the row whose rank, from
    1 by (key, id), that expression of _n (rows of the group) and the group columns gives; the last row beyond n, null
    below 1. Of c rows with that key and id, m are at or below the rank. _g is group_key(groups).

    Counts by the first digits of the key find the cell that holds a rank, counts by the next ones a cell within it, and
    only the rows of that are ranked. `df` is read once."""
    rows = cut(df.select(group_key(groups).alias("_g"), *groups, key.alias("_k"), F.col(id_col).alias("_i")))
    whole, cell = F.substring("_k", 1, FIRST), F.substring("_k", FIRST + 1, SECOND)
    counts = rows.groupBy("_g", *groups, whole.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g")
    run = counts.withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).withColumn("_n", F.sum("_c").over(w))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(rank.cast("bigint"), F.col("_n")).alias("r")) for name, rank in wanted.items()]))
    at = cut(run.select("_g", "_b", "_before", "_c", asked.alias("_x")).where("_x.r > _before and _x.r <= _before + _c").select("_g", "_b", "_x.name", (F.col("_x.r") - F.col("_before")).alias("_r")))
    inside = rows.select("_g", "_k", "_i", whole.alias("_b")).join(bounded(at.select("_g", "_b").distinct()), ["_g", "_b"]).withColumn("_d", cell)
    run = inside.groupBy("_g", "_b", "_d").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.sum("_c").over(Window.partitionBy("_g", "_b").orderBy("_d")) - F.col("_c"))
    last = run.join(at, ["_g", "_b"]).where("_r > _before and _r <= _before + _c").select("_g", "_b", "_d", "name", (F.col("_r") - F.col("_before")).alias("_r"))
    ranked = inside.join(last.select("_g", "_b", "_d").distinct(), ["_g", "_b", "_d"])
    by = Window.partitionBy("_g", "_b", "_d").orderBy("_k", "_i")
    ranked = ranked.withColumns({"_r": F.row_number().over(by).cast("bigint"), "_m": F.rank().over(by), "_c": F.count(F.lit(1)).over(Window.partitionBy("_g", "_b", "_d", "_k", "_i"))}).withColumn("_m", F.col("_r") - F.col("_m") + 1)
    found = ranked.join(last, ["_g", "_b", "_d", "_r"])
    return found.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, F.struct(F.col("_k").alias("k"), F.col("_i").alias("i"), F.col("_m").alias("m"), F.col("_c").alias("c")))).alias(name) for name in wanted])


def with_thresholds(df: DataFrame, found: DataFrame, groups: list[str], key: Column, id_col: str, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with the thresholds of each row's group, and by name whether the row is at or below them. Drop
    helpers(names) in the end. Of rows with the key and id of a threshold that a rank parts, as many as it says are below;
    they alone are numbered in a window."""
    small = cut(found.select("_g", *[F.col(n).alias(f"_t_{n}") for n in names]))
    both = df.withColumn("_g", group_key(groups)).join(bounded(small), "_g", "left")
    me, limit = F.struct(key.alias("k"), F.col(id_col).alias("i")), {n: F.struct(F.col(f"_t_{n}.k").alias("k"), F.col(f"_t_{n}.i").alias("i")) for n in names}
    parted = {n: F.coalesce(F.col(f"_t_{n}.m") < F.col(f"_t_{n}.c"), F.lit(False)) for n in names}
    below = {n: F.col(f"_t_{n}").isNotNull() & (me <= limit[n]) for n in names}
    if small.where(any_of(parted.values())).take(1):
        tied = any_of(parted[n] & me.eqNullSafe(limit[n]) for n in names)
        number = F.row_number().over(Window.partitionBy("_g", key, id_col).orderBy(F.lit(1)))
        both = both.where(~tied).withColumn("_no", F.lit(0)).unionByName(both.where(tied).withColumn("_no", number))
        below = {n: below[n] & ((me != limit[n]) | (F.col("_no") <= F.col(f"_t_{n}.m"))) for n in names}
    return both, {n: F.coalesce(c, F.lit(False)) for n, c in below.items()}


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def helpers(names: list[str]) -> list[str]:
    return ["_g", "_no", *[f"_t_{n}" for n in names]]

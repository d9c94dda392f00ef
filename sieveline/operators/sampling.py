"""Seeded samples, caps and splits of exact size. Random orders are md5('seed:key'), so any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Classifier
from ..functions.text import prefix_key, seeded
from ..sources.files import bounded, cut
from .ranks import helpers, thresholds, with_thresholds


def quotas(c: Classifier, total: int) -> dict[str, int]:
    return {s.name: int(total * s.share + 1e-9) for s in c.strata}


def _per(values: dict[str, int], key: Column) -> Column:
    """A small map from configuration, as an expression: no join."""
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def picks(df: DataFrame, targets: dict[str, int], seed: int, id_col: str = "id", source: str = "source", stratum: str = "stratum", visits: int = 10) -> DataFrame:
    """(id, stratum, pick) of round_robin(). Only rows that may be picked reach a window over a stratum: the first
    visits * target of a source, and of the rest the first target in seeded order, both cut before the shuffle."""
    most = max(targets.values(), default=0)
    rows = cut(df.select(F.col(id_col).alias("_i"), F.col(stratum).alias("_s"), F.coalesce(F.col(source), F.lit("unknown")).alias("_src")).where(F.col(stratum).isin(*targets)))
    # A row per stratum and source.
    per = Window.partitionBy("_s")
    pairs = rows.groupBy("_s", "_src").agg(F.lit(1).alias("_one")).drop("_one")
    pairs = pairs.withColumn("_pos", F.dense_rank().over(per.orderBy(seeded(seed, F.col("_src")), "_src")) - 1).withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_target", _per(targets, F.col("_s")))
    pairs = cut(pairs.withColumn("_rounds", F.greatest(F.lit(0), F.ceil((visits * F.col("_target") - F.col("_pos")) / F.col("_n")))))
    first = rows.withColumn("_round", F.row_number().over(Window.partitionBy("_s", "_src").orderBy("_i"))).where(f"_round <= {visits * most}")
    near = cut(first.join(bounded(pairs), ["_s", "_src"]).where("_round <= _rounds").select("_i", "_s", "_src", "_target", ((F.col("_round") - 1) * F.col("_n") + F.col("_pos")).alias("_visit")))
    # Strata that the visits leave short take from the rest of their rows.
    short = near.groupBy("_s").agg(F.count(F.lit(1)).alias("_c"), F.max("_target").alias("_t")).where("_c < _t").select("_s")
    last = pairs.join(near.groupBy("_s", "_src").agg(F.max("_i").alias("_last")), ["_s", "_src"], "left").join(F.broadcast(short), "_s", "left_semi").select("_s", "_src", "_target", "_last")
    rest = rows.join(bounded(cut(last)), ["_s", "_src"]).where("_last is null or _i > _last").withColumn("_key", seeded(seed, F.col("_i")))
    rest = rest.withColumn("_rn", F.row_number().over(per.orderBy("_key", "_i"))).where(f"_rn <= {most}")
    both = near.select("_i", "_s", "_target", "_visit", F.lit(None).cast("string").alias("_key")).unionByName(rest.select("_i", "_s", "_target", F.lit(None).cast("bigint").alias("_visit"), "_key"))
    ranked = both.withColumn("pick", F.row_number().over(per.orderBy(F.col("_key").isNotNull(), "_visit", "_key", "_i"))).where(f"pick <= {most} and pick <= _target")
    return ranked.select(F.col("_i").alias("id"), F.col("_s").alias("stratum"), "pick")


def round_robin(df: DataFrame, targets: dict[str, int], seed: int, id_col: str = "id", source: str = "source", stratum: str = "stratum", visits: int = 10) -> DataFrame:
    """Per stratum, up to its target: sources in seeded order are visited in turn, each giving its next row by id, for
    at most visits * target visits; what is then missing comes from the rest in seeded order. Adds `pick`, the rank.
    A stratum without rows or target gives none. Ids are unique. The picked rows, of bounded number, are joined back, so
    the others' columns aren't moved."""
    found = cut(picks(df, targets, seed, id_col, source, stratum, visits)).toDF("_i", "_s", "pick")
    return df.join(bounded(found), df[id_col].eqNullSafe(F.col("_i")) & (df[stratum] == F.col("_s"))).drop("_i", "_s")


def chunk_picks(chunks: DataFrame, c: Classifier, total: int, seed: int, id_col: str = "id", short: int = 100, long: int = 150) -> DataFrame:
    """(id, stratum, pick) of stratified_chunk_sample(), from ids and keys alone."""
    keys = cut(chunks.select(F.col(id_col).alias("id"), "stratum", "source", prefix_key(F.col("text"), short).alias("k"), prefix_key(F.col("text"), long).alias("kk")))
    first = F.row_number().over(Window.partitionBy("stratum", "k").orderBy("id"))
    unique = keys.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    picked = cut(round_robin(unique, quotas(c, total), seed))
    rank = _per({s.name: k for k, s in enumerate(c.strata)}, F.col("stratum"))
    return picked.withColumn("_rn", F.row_number().over(Window.partitionBy("kk").orderBy(rank, "pick"))).where("_rn = 1").select("id", "stratum", "pick")


def stratified_chunk_sample(chunks: DataFrame, c: Classifier, total: int, seed: int, id_col: str = "id", short: int = 100, long: int = 150) -> DataFrame:
    """Dedup by short prefix within strata, round-robin sample to the strata's shares of total, dedup by long prefix
    across strata in order of the strata. Ids are unique; the texts of what isn't picked aren't moved."""
    found = cut(chunk_picks(chunks, c, total, seed, id_col, short, long)).select(F.col("id").alias("_i"), "pick")
    return chunks.join(bounded(found), chunks[id_col].eqNullSafe(F.col("_i"))).drop("_i")


def stratified_fraction(df: DataFrame, fraction: float, seed: int, id_col: str = "id", stratum: str = "stratum") -> DataFrame:
    """max(1, floor(n * fraction)) rows of each stratum, the first in seeded order: those up to a threshold of the key."""
    key = seeded(seed, F.col(id_col))
    found = thresholds(df, [stratum], key, id_col, {"kept": F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))})
    both, at = with_thresholds(df, found, [stratum], key, id_col, ["kept"])
    return both.where(at["kept"]).drop(*helpers(["kept"]))


def balance_counts(counts: dict[str, int], share: float = 0.40, rounds: int = 10) -> dict[str, int]:
    """The counts that repeated capping at int(total * share) leaves. It may stop short of the share after `rounds`,
    and with two strata or fewer it never gets there."""
    now = dict(counts)
    for _ in range(rounds):
        cap = int(sum(now.values()) * share)
        if all(n <= cap for n in now.values()):
            break
        now = {k: min(n, cap) for k, n in now.items()}
    return now


def balance(df: DataFrame, seed: int, share: float = 0.40, rounds: int = 10, id_col: str = "id", stratum: str = "stratum") -> DataFrame:
    """Rows that the capped counts leave of each stratum, in seeded order. Nested samples of one order collapse to a
    single threshold of the key per stratum; the driver sees one count per stratum."""
    counts = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count(F.lit(1))).collect()}
    caps = balance_counts(counts, share, rounds)
    capped = {k: v for k, v in caps.items() if v < counts[k] and k is not None}
    if not capped:
        return df
    over, key = F.coalesce(F.col(stratum).isin(*capped), F.lit(False)), seeded(seed, F.col(id_col))
    found = thresholds(df.where(over), [stratum], key, id_col, {"kept": _per(capped, F.col(stratum))})
    both, at = with_thresholds(df, found, [stratum], key, id_col, ["kept"])
    return both.where(~over | at["kept"]).drop(*helpers(["kept"]))


def stratified_split(df: DataFrame, seed: int, keys: list[str], train: float = 0.90, valid: float = 0.05, id_col: str = "id") -> DataFrame:
    """Adds split: by group floor(n * train) but 1 at least to train, then valid, the rest test; when these leave
    nothing, valid gives way."""
    n = F.col("_n")
    nt, nv = F.greatest(F.lit(1), F.floor(n * train)), F.floor(n * valid)
    nv = F.when(nt + nv >= n, F.greatest(F.lit(0), n - nt - 1)).otherwise(nv)
    return _split(df, keys, seed, id_col, nt, nt + nv)


def _split(df: DataFrame, keys: list[str], seed: int, id_col: str, train: Column, both: Column) -> DataFrame:
    """Adds split by thresholds of the seeded key; train and both are ranks, expressions of _n. Rows aren't moved."""
    key, names = seeded(seed, F.col(id_col)), ["train", "valid"]
    found = thresholds(df, keys, key, id_col, {"train": train, "valid": both})
    rows, at = with_thresholds(df, found, keys, key, id_col, names)
    return rows.withColumn("split", F.when(at["train"], "train").when(at["valid"], "valid").otherwise("test")).drop(*helpers(names))


def global_rank(df: DataFrame, key: Column, ties: str, bucket_chars: int = 4) -> DataFrame:
    """Adds _rank (from 1, by the hex key) and _total without a one-partition window: ranks within prefixes of the key
    plus the counts of the prefixes before."""
    a = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, bucket_chars))
    counts = a.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    # At most 16^bucket_chars rows from here on.
    offsets = counts.select("_bucket", (F.sum("_c").over(Window.orderBy("_bucket")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_total"))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", ties))
    return a.withColumn("_in", inner).join(F.broadcast(offsets), "_bucket").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_bucket", "_key")


def global_split(df: DataFrame, seed: int, train: int = 80, valid: int = 10, id_col: str = "id") -> DataFrame:
    """Adds split: floor(n * train / 100) rows in seeded order, then valid, the rest test."""
    nt, nv = F.floor(F.col("_n") * train / 100), F.floor(F.col("_n") * valid / 100)
    return _split(df, [], seed, id_col, nt, nt + nv)


def halves(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds batch: 1 for the first n div 2 rows by id, 2 for the rest; null ids come first, and rows of one id stay
    together. Ids of any ordered type are sorted in ranges, not in one partition."""
    rows = df.select(F.col(id_col).alias("i")).repartitionByRange("i").sortWithinPartitions("i").select("i", F.monotonically_increasing_id().alias("m"))
    rows = cut(rows).withColumns({"p": F.shiftright("m", 33), "k": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))})
    # A row per partition.
    counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    last = rows.join(F.broadcast(offsets), "p").where(F.col("before") + F.col("k") + 1 == F.floor(F.col("n") / 2)).first()
    i = F.col(id_col)
    first = F.lit(False) if last is None else i.isNull() if last["i"] is None else i.isNull() | (i <= F.lit(last["i"]))
    return df.withColumn("batch", F.when(first, 1).otherwise(2))


def fixed_sample(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows in seeded order: a top-k, without a full sort."""
    return df.orderBy(seeded(seed, F.col(id_col)), id_col).limit(n)


def letters(df: DataFrame, seed: int, case: str = "case_id", item: str = "tier") -> DataFrame:
    """Adds letter: a seeded permutation of A, B, ... within each case."""
    w = Window.partitionBy(case).orderBy(seeded(seed, F.col(case), F.col(item)), item)
    return df.withColumn("letter", F.char(F.row_number().over(w) + 64))

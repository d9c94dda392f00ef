"""Counts, histograms and length statistics of a curated set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Classifier, GenerationConfig


def histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n), most frequent first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def count_by_source(df: DataFrame, source: str = "source", valid=None) -> DataFrame:
    tag = F.coalesce(F.col(source), F.lit("unknown"))
    if valid is not None:
        tag = F.when(valid, tag).otherwise(F.lit("invalid"))
    return df.groupBy(tag.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """(score, n, mean): the mean of all scores, to 2 places, on every row."""
    h = scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per score
    return h.withColumn("mean", F.round(F.sum(F.col(score) * F.col("n")).over(w) / F.sum("n").over(w), 2))


def length_stats(df: DataFrame, length) -> DataFrame:
    """(n, min, max, mean to 1 place, upper median): the median is element n div 2 from 0 of the sorted lengths, found
    from the histogram of lengths, not by sorting rows."""
    h = df.select(length.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    # A row per distinct length.
    ranked = h.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("total", F.sum("c").over(Window.partitionBy(F.lit(1))))
    return ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("v").alias("min_len"), F.max("v").alias("max_len"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 1).alias("mean_len"),
                      F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("v"))).alias("median_len"))


def fractions(before: DataFrame, after: DataFrame, key: str = "stratum") -> DataFrame:
    """(stratum, count_before, fraction_before, count_after, fraction_after), shares to 4 places."""
    both = before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(key, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return _shares(both.groupBy(key).agg(F.sum("b").alias("count_before"), F.sum("a").alias("count_after")), key)


def _shares(g: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(F.lit(1))  # one row per stratum
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(c), F.sum(c).over(w)), 4), F.lit(0.0))
    return g.select(key, "count_before", share("count_before").alias("fraction_before"), "count_after", share("count_after").alias("fraction_after"))


def kept_fractions(df: DataFrame, kept, key: str = "stratum") -> DataFrame:
    """fractions() of the rows of df and of those that are kept (a condition), from one pass over df."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("count_before"), F.count(F.when(kept, 1)).alias("count_after"))
    return _shares(g, key)


def retention(initial: DataFrame, final: DataFrame, source: str = "source") -> DataFrame:
    """(source, initial, final, retained_pct) of each source."""
    both = initial.select(source, F.lit(1).alias("i"), F.lit(0).alias("f")).unionByName(final.select(source, F.lit(0).alias("i"), F.lit(1).alias("f")))
    g = both.groupBy(source).agg(F.sum("i").alias("initial"), F.sum("f").alias("final"))
    return g.select(source, "initial", "final", F.round(F.try_divide(F.col("final") * 100.0, "initial"), 1).alias("retained_pct"))


def availability(chunks: DataFrame, c: Classifier, total: int) -> DataFrame:
    """(stratum, available, target) of every configured stratum, sources and strata that are missing as 0."""
    have = chunks.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    want = chunks.sparkSession.createDataFrame([(s.name, int(total * s.share + 1e-9)) for s in c.strata], "stratum string, target int")
    return want.join(have, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("available"), "target")


def reject_by_stratum(scored: DataFrame, passed, stratum: str = "stratum") -> DataFrame:
    g = scored.groupBy(stratum).agg(F.count(F.lit(1)).alias("scored"), F.sum((~passed).cast("int")).alias("rejected"))
    return g.withColumn("rate", F.round(F.col("rejected") / F.col("scored"), 4))


def generation_cost(chunks: DataFrame, c: GenerationConfig) -> DataFrame:
    """One row: tokens, dollars, pairs and minutes that generating from all chunks would take."""
    n = F.count(F.lit(1))
    tin, tout = n * c.input_tokens, n * c.output_tokens
    return chunks.agg(n.alias("chunks"), tin.alias("input_tokens"), tout.alias("output_tokens"), F.round(tin / 1e6 * c.input_price + tout / 1e6 * c.output_price, 2).alias("cost_usd"),
                      (n * c.pairs_per_chunk).alias("examples"), F.round(n * c.seconds_per_chunk / 60, 1).alias("minutes"))


def token_cost(usage: DataFrame, input_price: float = 0.30, output_price: float = 1.20) -> DataFrame:
    i, o = F.coalesce(F.sum("tokens_in"), F.lit(0)), F.coalesce(F.sum("tokens_out"), F.lit(0))
    return usage.agg(i.alias("tokens_in"), o.alias("tokens_out"), F.round(i / 1e6 * input_price, 4).alias("cost_in"), F.round(o / 1e6 * output_price, 4).alias("cost_out"),
                     F.round(i / 1e6 * input_price + o / 1e6 * output_price, 4).alias("cost_total"))

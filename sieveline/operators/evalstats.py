"""Statistics of judged model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CRITERIA = ("dx", "guide", "complete", "utility")
WEIGHTS = dict(zip(CRITERIA, (0.25, 0.30, 0.25, 0.20)))


def composite() -> Column:
    return sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))


def band(score: Column) -> Column:
    """Five bands by their lower bounds, so that no score falls between two."""
    out = F.when(score >= 4.5, "excellent")
    for least, name in ((3.5, "good"), (2.5, "acceptable"), (1.5, "insufficient")):
        out = out.when(score >= least, name)
    return out.when(score.isNotNull(), "unacceptable")


def tier_means(scores: DataFrame, value: str = "composite") -> DataFrame:
    """(tier, complexity, mean, n): by complexity, and overall with complexity 'all', in one pass."""
    g = scores.rollup("tier", "complexity").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("g"))
    return g.where("g < 3").select("tier", F.when(F.col("g") == 1, "all").otherwise(F.col("complexity")).alias("complexity"), F.round("mean", 4).alias("mean"), "n")


def criterion_pivot(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tier").agg(*[F.round(F.avg(c), 4).alias(c) for c in CRITERIA])


def strategy_delta(scores: DataFrame) -> DataFrame:
    """(model, base, rag, ft, rag_delta, ft_delta, best, ratio) from (model, strategy, composite)."""
    m = lambda s: F.max(F.when(F.col("strategy") == s, F.col("composite")))
    g = scores.groupBy("model").agg(m("base").alias("base"), m("rag").alias("rag"), m("ft").alias("ft"), F.max_by("strategy", F.struct("composite", "strategy")).alias("best"), F.max("composite").alias("top"))
    return g.select("model", "base", "rag", "ft", F.round(F.col("rag") - F.col("base"), 4).alias("rag_delta"), F.round(F.col("ft") - F.col("base"), 4).alias("ft_delta"), "best",
                    F.round(F.try_divide("top", "base"), 4).alias("ratio"))


def bootstrap(scores: DataFrame, key: str, value: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(tier, mean, lo, hi): percentile interval of the mean over resamples whose draws are hashes of (seed, tier,
    replicate, draw). Draw k of a replicate takes the row of rank hash % n; the work is spread over replicates."""
    w = Window.partitionBy(key)
    ranked = scores.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    draws = ranked.select("k", "n", "r", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "k", F.col("b").cast("string"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("bigint")
    pick = draws.select("k", "b", F.pmod(digest, F.col("n")).alias("p"))
    means = pick.join(ranked.select("k", F.col("r").cast("bigint").alias("p"), "v"), ["k", "p"]).groupBy("k", "b").agg(F.avg("v").alias("m"))
    tail = (1 - level) / 2
    ci = means.groupBy("k").agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    mean = ranked.groupBy("k").agg(F.avg("v").alias("mean"))
    return mean.join(ci, "k").select(F.col("k").alias(key), F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman); ranks of ties are averaged. Ranks come from the histogram of values."""
    data = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranks(c: str) -> DataFrame:
        h = data.groupBy(c).agg(F.count(F.lit(1)).alias("c"))
        return h.select(c, (F.sum("c").over(Window.orderBy(c)) - (F.col("c") - 1) / 2).alias(f"r{c}"))

    r = data.join(ranks("x"), "x").join(ranks("y"), "y")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def bland_altman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    d = F.col(x) - F.col(y)
    return pairs.agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("bias"), F.round(F.avg(d) - 1.96 * F.stddev_samp(d), 6).alias("lower"), F.round(F.avg(d) + 1.96 * F.stddev_samp(d), 6).alias("upper"))


def krippendorff(ratings: DataFrame, unit: list[str], value: str) -> DataFrame:
    """(n, alpha): interval metric. Units with one rating don't count. Sums of values and squares per unit replace
    the self-join of coincidences."""
    u = ratings.where(F.col(value).isNotNull()).groupBy(*unit).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.pow(F.col(value).cast("double"), F.lit(2))).alias("q")).where("m > 1")
    # Sum over ordered pairs of (a - b)^2 is 2 (m q - s^2).
    t = u.agg(F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"))
    observed, expected = F.col("within") / F.col("n"), 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return t.select("n", F.round(1 - F.try_divide(observed, expected), 6).alias("alpha"))


def agreement_band(alpha: Column) -> Column:
    return F.when(alpha >= 0.80, "reliable").when(alpha >= 0.67, "tentative").otherwise("unreliable")


def discrepancies(pairs: DataFrame, x: str, y: str, more_than: float = 1.0) -> DataFrame:
    return pairs.where(F.abs(F.col(x) - F.col(y)) > more_than)


def human_mean(ratings: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    return ratings.groupBy(*keys).agg(F.round(F.avg(value), 4).alias("human_mean"), (F.max(value) - F.min(value)).alias("rater_range"), F.count(value).alias("raters"))


def cost_benefit(tiers: DataFrame) -> DataFrame:
    """Adds score_per_usd; null for a tier without cost."""
    return tiers.withColumn("score_per_usd", F.round(F.try_divide("composite", F.nullif("cost_usd", F.lit(0.0))), 4))


def rank_agreement(scores: DataFrame, judge: str = "judge", human: str = "human") -> DataFrame:
    """Adds judge_rank and human_rank of tiers in each case, and same."""
    w = Window.partitionBy("case_id")
    r = scores.withColumn("judge_rank", F.rank().over(w.orderBy(F.desc(judge)))).withColumn("human_rank", F.rank().over(w.orderBy(F.desc(human))))
    return r.withColumn("same", F.col("judge_rank") == F.col("human_rank"))


def best_checkpoint(log: DataFrame, by: str = "model", step: str = "iter", loss: str = "val_loss") -> DataFrame:
    """(model, best_iter, best_loss): least loss, the earliest at ties."""
    return log.groupBy(by).agg(F.min(F.struct(loss, step)).alias("b")).select(by, F.col(f"b.{step}").alias("best_iter"), F.col(f"b.{loss}").alias("best_loss"))

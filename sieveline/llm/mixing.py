"""Mixing sources to target weights with hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cumulative_thresholds, cut, fresh, key_hash

#: Production parameters. ALPHA: without explicit weights a source weighs tokens^ALPHA. BUDGET: without an explicit
#: budget the whole mixture has this share of all tokens. TIERS: nested budgets, as shares of the whole one.
ALPHA, BUDGET = 0.7, 0.8
TIERS = (0.25, 0.5, 1.0)


def token_count(text):
    """Tokens are runs of other than white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def mixture_thresholds(rows: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
                       tiers=TIERS, budget: int | None = None) -> DataFrame:
    """rows: (source, h, tokens). Returns (source, target_id = tier number from 1, target = its token budget,
    threshold).

    A tier's budget is spread over the sources by weight: each gives level * weight tokens, at most what it has, with
    the level at which the budget is met. So no source is repeated, none sets the others' share, and what a small one
    falls short of comes from the rest. A source ends with the document that reaches its share. Beside the rows only one
    row per source exists here."""
    totals = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    if weights is None:
        weighed = totals.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(alpha))))
    else:
        given = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "wsource string, weight double")
        weighed = totals.join(F.broadcast(given), totals.source.eqNullSafe(F.col("wsource")), "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    live = weighed.where("weight > 0 and tokens > 0").withColumn("ratio", F.col("tokens") / F.col("weight"))
    # level >= (budget - before) / rest for every source, where before is what the sources of less ratio have and rest
    # the weight of the others; at the source where the sources of full use end they are equal.
    up, down = Window.orderBy("ratio", "source"), Window.orderBy(F.desc("ratio"), F.desc("source"))
    ranked = live.withColumns({"before": F.sum("tokens").over(up) - F.col("tokens"), "rest": F.sum("weight").over(down)})
    everything = Window.partitionBy()
    ranked = ranked.withColumn("budget", F.lit(float(budget)) if budget is not None else F.sum("tokens").over(everything) * F.lit(BUDGET))
    level = lambda share: F.max((F.lit(float(share)) * F.col("budget") - F.col("before")) / F.col("rest")).over(everything)
    levelled = ranked.withColumn("levels", F.array(*[F.struct(F.lit(k + 1).alias("target_id"), level(s).alias("level")) for k, s in enumerate(tiers)]))
    targets = (levelled.select("source", "tokens", "weight", "ratio", F.explode("levels").alias("l")).select("source", "tokens", "l.target_id",
               F.when(F.col("ratio") <= F.col("l.level") * (1 + 1e-12), F.col("tokens")).otherwise(F.floor(F.col("l.level") * F.col("weight") + F.lit(1e-6)).cast("bigint")).alias("target")))
    targets = cut(targets.where("target > 0"))
    found = cumulative_thresholds(rows, "source", "h", "tokens", targets.where("target < tokens").drop("tokens"), reach=True)
    return found.unionByName(targets.where("target >= tokens").select("source", "target_id", "target", F.lit(1 << 60).alias("threshold")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, tiers=TIERS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix:", budget: int | None = None) -> DataFrame:
    """Rows (doc_id, source, tokens, tier) of the documents in the mixture; tier is the smallest nested budget that
    holds the document, so tier <= k is the mixture of budget k.

    A null source is a source of its own; a source without tokens or weight gives nothing; documents without
    tokens of a mixed source are kept where their hash is below the threshold. Repeated ids share a hash and stay
    or go together. A document longer than what is left of its source's share still counts, as the last. An empty table
    gives no rows; other columns are ignored."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key_hash(F.col(id_col), seed).alias("h"), token_count(F.col(text_col)).alias("tokens")))
    return _tiered(rows, mixture_thresholds(rows, weights, alpha, tiers, budget)).select("doc_id", "source", "tokens", "tier")


def _tiered(rows: DataFrame, thresholds: DataFrame, source: str = "source", h: str = "h") -> DataFrame:
    ladder = thresholds.groupBy(F.col("source").alias("tsource")).agg(F.array_sort(F.collect_list(F.struct("target_id", "threshold"))).alias("ladder"))
    # One row per source: small; Spark broadcasts it under its own threshold, else it shuffles.
    found = rows.join(ladder, rows[source].eqNullSafe(F.col("tsource")), "inner")
    first = F.array_min(F.transform(F.filter("ladder", lambda x: F.col(h) < x["threshold"]), lambda x: x["target_id"]))
    return found.withColumn("tier", first).where("tier is not null").drop("tsource", "ladder")


def mix_filter(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix:", budget: int | None = None) -> DataFrame:
    """`docs`, all columns, less what the whole budget leaves out. Sums go over narrow rows; the documents
    themselves are only filtered by threshold, not shuffled or sorted. Cases as in mix()."""
    rows = cut(docs.select(F.col(source_col).alias("source"), key_hash(F.col(id_col), seed).alias("h"), token_count(F.col(text_col)).alias("tokens")))
    limits = mixture_thresholds(rows, weights, alpha, (1.0,), budget).select(F.col("source").alias("_sv_source"), F.col("threshold").alias("_sv_threshold"))
    src, thr = fresh(docs, "source", "threshold")
    limits = limits.toDF(src, thr)
    kept = docs.join(bounded(limits), docs[source_col].eqNullSafe(limits[src]) & (key_hash(docs[id_col], seed) < limits[thr]), "left_semi")
    return kept


ORACLE = """
WITH r AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
         CAST(coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS BIGINT) AS tokens FROM documents),
s AS (SELECT source, pow(CAST(sum(tokens) AS DOUBLE), 0.7) AS weight, sum(tokens) AS tokens FROM r GROUP BY source HAVING sum(tokens) > 0),
o AS (SELECT *, tokens / weight AS ratio, sum(tokens) OVER () AS total,
             sum(tokens) OVER (ORDER BY tokens / weight, source ROWS UNBOUNDED PRECEDING) - tokens AS before,
             sum(weight) OVER (ORDER BY tokens / weight DESC, source DESC ROWS UNBOUNDED PRECEDING) AS rest FROM s),
l AS (SELECT k AS tier, max((share * total * 0.8::DOUBLE - before) / rest) AS level FROM o, (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)) v(k, share) GROUP BY k),
b AS (SELECT source, tier, CASE WHEN ratio > level * (1 + 1e-12::DOUBLE) THEN floor(level * weight + 1e-6) END AS target FROM o, l),
c AS (SELECT doc_id, source, tokens, h, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY source, h) AS before FROM r)
SELECT c.doc_id, c.source, c.tokens, CAST(min(b.tier) AS INTEGER) AS tier
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND (b.target IS NULL OR c.before < b.target)
GROUP BY c.doc_id, c.source, c.tokens, c.h
"""

"""Quality funnel over chat examples, its one-pass report, and chunk stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FunnelConfig
from ..functions import text as X
from ..functions.classify import stratum

STAGES = ("format", "response_length", "evasive", "question_length")


def by_role(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def canonical(examples: DataFrame) -> DataFrame:
    """Adds system, user, assistant by role and fail_format: not three messages, or no user or assistant text."""
    m = F.col("messages")
    out = examples.withColumns({r: by_role(m, r) for r in ("system", "user", "assistant")})
    ok = (F.size(m) >= 3) & (F.col("user") != "") & (F.col("assistant") != "")
    return out.withColumn("fail_format", ~F.coalesce(ok, F.lit(False)))


def failures(c: FunnelConfig) -> dict[str, Column]:
    """Reject tests of the row-local stages, cheapest first; later ones see only what earlier ones pass."""
    return {
        "format": F.col("fail_format"),
        "response_length": F.length("assistant") < c.min_response,
        "evasive": X.is_evasive(F.col("assistant"), c.evasive),
        "question_length": F.length("user") < c.min_question,
    }


def with_rejection(examples: DataFrame, c: FunnelConfig) -> DataFrame:
    """Adds rejected_at: number of the first stage (from 1) that rejects the row, null if none does. Stages in c.skip
    aren't built into the plan."""
    out = F.when(F.lit(False), F.lit(0))
    for k, (name, test) in enumerate(failures(c).items(), 1):
        if name not in c.skip:
            out = out.when(test, F.lit(k))
    return canonical(examples).withColumn("rejected_at", out)


def passing(examples: DataFrame, c: FunnelConfig) -> DataFrame:
    kept = with_rejection(examples, c).where("rejected_at is null")
    both = F.lower(F.concat_ws(" ", "user", "assistant"))
    return kept.withColumn("stratum", stratum(c.classifier, both)).drop("rejected_at", "fail_format")


@dataclass(frozen=True)
class StageResult:
    name: str
    kept: DataFrame


def run_funnel(examples: DataFrame, c: FunnelConfig) -> list[StageResult]:
    """The row-local stages as lazily nested DataFrames; a skipped stage passes its input on."""
    df, out = canonical(examples), []
    for name, test in failures(c).items():
        if name not in c.skip:
            df = df.where(~F.coalesce(test, F.lit(False)))
        out.append(StageResult(name, df))
    return out


def funnel_report(rejected: DataFrame, c: FunnelConfig, source: str = "source", names: tuple[str, ...] = STAGES, skip: frozenset[str] | None = None) -> DataFrame:
    """(stage_no, stage, source, before, rejected, remaining, rate, skipped) of all stages and sources from one
    aggregation by (source, rejected_at). Null sources count as 'unknown', unparsable rows as 'invalid'."""
    skip = c.skip if skip is None else skip
    tag = F.when(F.col("messages").isNull(), F.lit("invalid")).otherwise(F.coalesce(F.col(source), F.lit("unknown")))
    cells = rejected.groupBy(tag.alias("source"), "rejected_at").agg(F.count(F.lit(1)).alias("n"))
    stages = F.explode(F.array(*[F.struct(F.lit(k).alias("stage_no"), F.lit(s).alias("stage"), F.lit(s in skip).alias("skipped")) for k, s in enumerate(names, 1)]))
    at = F.coalesce(F.col("rejected_at"), F.lit(len(names) + 1))
    long = cells.select("source", "n", at.alias("at"), stages.alias("s")).select("source", "n", "at", "s.*")
    sums = long.groupBy("stage_no", "stage", "source", "skipped").agg(
        F.coalesce(F.sum(F.when(F.col("at") >= F.col("stage_no"), F.col("n"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(F.col("at") == F.col("stage_no"), F.col("n"))), F.lit(0)).alias("rejected"))
    rate = F.coalesce(F.round(F.try_divide("rejected", "before"), 4), F.lit(0.0))
    return sums.select("stage_no", "stage", "source", "before", "rejected", (F.col("before") - F.col("rejected")).alias("remaining"), rate.alias("rate"), "skipped")

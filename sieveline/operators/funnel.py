"""The whole funnel: eight stages, balance, split and report, over examples in memory or in files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FunnelConfig
from ..functions.classify import stratum
from ..sources import files
from ..sources.files import bounded, cut
from . import dedup, quality, report, sampling, stages

ALL_STAGES = (*stages.STAGES, "semantic_dedup", "cross_source_dedup", "llm_score", "extrapolation")
log = logging.getLogger("sieveline.funnel")


@dataclass(frozen=True)
class Funnel:
    """rows: every example with rejected_at (1 to 8, null if it passes) and stratum; kept: those that pass and the
    balance leaves, with split; report: per stage and source; balance: fractions per stratum before and after."""

    rows: DataFrame
    kept: DataFrame
    report: DataFrame
    balance: DataFrame


def run(examples: DataFrame, c: FunnelConfig, vectors: DataFrame | None = None, scores: DataFrame | None = None, sources: tuple[str, str] = ("sonnet", "minimax")) -> Funnel:
    """examples: (id, source, messages), ids unique. vectors: (id, embedding), of questions, for stages 5 and 6. scores:
    (id, score) for stages 7 and 8. A stage in c.skip, or without its input, is skipped and says so in the report; the
    extrapolation also where the scores have one class.

    Examples are judged and classified once, and written; later stages see narrow rows of what is left and add the ids
    that they reject."""
    skip = set(c.skip) | ({"semantic_dedup", "cross_source_dedup"} if vectors is None else set()) | ({"llm_score", "extrapolation"} if scores is None else set())
    both = F.lower(F.concat_ws(" ", "user", "assistant"))
    judged = cut(stages.with_rejection(examples, c).withColumn("stratum", F.when(F.col("rejected_at").isNull(), stratum(c.classifier, both))).drop("fail_format", "system"))
    live, gone = judged.where("rejected_at is null").select("id", "source", "user", "assistant", "stratum"), None

    def reject(ids: DataFrame, stage: str) -> None:
        nonlocal live, gone
        ids = cut(ids.select("id").distinct())
        live = live.join(bounded(ids), "id", "left_anti")
        k = ids.select(F.col("id").alias("_id"), F.lit(ALL_STAGES.index(stage) + 1).alias("_k"))
        gone = k if gone is None else gone.unionByName(k)
        log.info("stage %s planned", stage)

    def placed() -> DataFrame:
        return live.select("id", "source", F.length("assistant").alias("length")).join(vectors.select("id", "embedding"), "id")

    if "semantic_dedup" not in skip:
        reject(dedup.semantic_rejects(placed(), c.similarity, "id"), "semantic_dedup")
    if "cross_source_dedup" not in skip:
        reject(dedup.cross_source_rejects(placed(), c.similarity, *sources, id_col="id"), "cross_source_dedup")
    scored = None if scores is None else scores.select("id", "score").where("score is not null")
    before = live
    if "llm_score" not in skip:
        reject(live.join(scored.where(F.col("score") < c.min_score), "id", "left_semi"), "llm_score")
    if "extrapolation" not in skip:
        found = extrapolated(before, live, scored, c, sources[0])
        if found is None:
            skip.add("extrapolation")
        else:
            reject(found, "extrapolation")
    rows = judged
    if gone is not None:
        rows = judged.join(bounded(cut(gone)), judged["id"] == F.col("_id"), "left").withColumn("rejected_at", F.coalesce("rejected_at", "_k")).drop("_id", "_k")
    rows = cut(rows)
    passed = rows.where("rejected_at is null").drop("rejected_at")
    kept = sampling.balance(passed, c.seed, c.max_share, c.balance_rounds)
    return Funnel(rows, sampling.stratified_split(kept, c.seed, ["source", "stratum"]), stages.funnel_report(rows, c, names=ALL_STAGES, skip=frozenset(skip)), report.fractions(passed, kept))


def extrapolated(rows: DataFrame, live: DataFrame, scored: DataFrame, c: FunnelConfig, main_source: str) -> DataFrame | None:
    """Ids of unscored live rows that trees trained on the scored ones reject; rows whose text is that of a passing one
    are left alone. None where the scores have one class."""
    featured, names = quality.with_features(rows, "user", "assistant", c.classifier, main_source)
    featured = cut(featured.select("id", "user", "assistant", *names).join(scored, "id", "left"))
    labelled = featured.where("score is not null").withColumn("passes", (F.col("score") >= c.min_score).cast("int"))
    model = quality.train(labelled, names, "passes", c.trees, c.seed)
    if model is None:
        return None
    rest = featured.where("score is null").join(live.select("id"), "id", "left_semi")
    rest = quality.content_anti(rest, labelled.where("passes = 1"), "user", "assistant")
    return quality.predict(model, rest, names).where("predicted = 0").select("id")


def run_files(spark: SparkSession, c: FunnelConfig, vectors: DataFrame | None = None) -> Funnel | None:
    """run() over the JSON lines in c.input_dir (c.inputs: file and source, missing ones are left out) and the scores in
    c.scores_file, with its results under c.output_dir: a folder of JSON lines a split, and the report. A dry run writes
    the report alone, beside the input. None without any input file."""
    lines = files.read_tagged(spark, [(f"{c.input_dir}/{name}", source) for name, source in c.inputs])
    if lines is None:
        log.warning("no input under %s", c.input_dir)
        return None
    examples = lines.select(F.xxhash64("_rank", "line").alias("id"), F.col("_source").alias("source"), "messages")
    # Equal lines of a file are one example each, so ids take their number too.
    examples = cut(examples.withColumn("_no", F.row_number().over(sampling.Window.partitionBy("id").orderBy("id"))).withColumn("id", F.xxhash64("id", "_no")).drop("_no"))
    scores = None
    if c.scores_file and files.exists(spark, c.scores_file):
        scores = files.read_scores(spark, c.scores_file).select(F.col("index").alias("id"), "score")
    done = run(examples, c, vectors, scores, tuple(dict.fromkeys(s for _, s in c.inputs))[:2])
    files.write_report(done.report, c.output_dir, c.input_dir, c.dry_run)
    if not c.dry_run:
        files.write_jsonl(done.kept, f"{c.output_dir}/examples", "split")
    return done

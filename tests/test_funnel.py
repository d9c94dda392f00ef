"""The whole funnel, samples with repeated rows, and external calls."""

import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.operators import funnel, generation, sampling
from sieveline.sources import files, schema

TURNS = "array<struct<role:string,content:string>>"


def examples(spark, n=40, source=lambda i: "main" if i % 4 else "other"):
    rows = [(i, source(i), [("system", "s"), ("user", f"Question {i}: what is known of the tides near harbour {i % 7}?"), ("assistant", f"Answer {i}. " + ("Dosis y tratamiento de apoyo. " if i % 2 else "Seguimiento y control. ") * 15)]) for i in range(n)]
    rows += [(1000, "main", [("user", "x")]), (1001, "main", None), (1002, None, [("system", "s"), ("user", "q" * 40), ("assistant", "short")])]
    return spark.createDataFrame(rows, f"id bigint, source string, messages {TURNS}")


def vectors(spark, n=40, same=((0, 1), (3, 5))):
    v = {i: np.eye(64)[i] for i in range(n)}
    for a, b in same:
        v[b] = v[a] + 0.01 * np.eye(64)[63]
    return spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id bigint, embedding array<double>")


def test_the_whole_funnel(spark):
    c = C.FunnelConfig(trees=3)
    scores = spark.createDataFrame([(i, None if i == 20 else 1 if i % 2 else 4) for i in range(10, 21)] + [(2, 0)], "id bigint, score int")
    done = funnel.run(examples(spark), c, vectors(spark), scores, ("main", "other"))
    at = {r["id"]: r["rejected_at"] for r in done.rows.collect()}
    # 0 and 1, of the same question, and 3 and 5: the longer answer stays, or the earlier.
    assert {i for i, k in at.items() if k == 1} == {1000, 1001} and at[1002] == 2
    lengths = {r["id"]: len(r["assistant"] or "") for r in done.rows.select("id", "assistant").collect()}
    assert {i for i, k in at.items() if k == 5} == {b if lengths[a] >= lengths[b] else a for a, b in ((0, 1), (3, 5))}
    assert {i for i, k in at.items() if k == 7} == {2, 11, 13, 15, 17, 19} and not {i for i, k in at.items() if k == 6}
    # The trees see that odd answers fail, of rows without a score.
    assert {i for i, k in at.items() if k == 8} <= {i for i in at if i < 1000} - set(range(10, 20))
    rep = {(r["stage"], r["source"]): r for r in done.report.collect()}
    assert sum(r["rejected"] for (s, _), r in rep.items() if s == "llm_score") == 6 and not any(r["skipped"] for r in rep.values())
    assert sum(r["remaining"] for (s, _), r in rep.items() if s == "extrapolation") == sum(k is None for k in at.values())
    kept = done.kept.select("id", "split").collect()
    assert {r["id"] for r in kept} <= {i for i, k in at.items() if k is None} and {r["split"] for r in kept} <= {"train", "valid", "test"}


def test_stages_without_their_input_are_skipped(spark):
    done = funnel.run(examples(spark), C.FunnelConfig(skip=frozenset({"response_length"})))
    skipped = {r["stage"] for r in done.report.where("skipped").collect()}
    assert skipped == {"response_length", "semantic_dedup", "cross_source_dedup", "llm_score", "extrapolation"}
    assert done.rows.where("rejected_at is null").count() == 41
    one_class = spark.createDataFrame([(i, 5) for i in range(9)], "id bigint, score int")
    done = funnel.run(examples(spark), C.FunnelConfig(trees=2), scores=one_class)
    assert {r["stage"] for r in done.report.where("skipped").collect()} == {"semantic_dedup", "cross_source_dedup", "extrapolation"}


def test_the_funnel_of_nothing(spark):
    empty = spark.createDataFrame([], f"id bigint, source string, messages {TURNS}")
    done = funnel.run(empty, C.FunnelConfig(), vectors(spark), spark.createDataFrame([], "id bigint, score int"))
    assert done.rows.count() == done.kept.count() == done.report.count() == 0


def test_a_dry_run_leaves_a_report_only(spark, tmp_path):
    rows = examples(spark).where("id < 1000")
    files.write_jsonl(rows, f"file://{tmp_path}/in/a.jsonl")
    c = C.FunnelConfig(input_dir=f"file://{tmp_path}/in", output_dir=f"file://{tmp_path}/out", inputs=(("a.jsonl", "main"), ("none.jsonl", "other")), dry_run=True, max_share=1.0)
    assert funnel.run_files(spark, c).rows.count() == 40
    assert not (tmp_path / "out").exists() and (tmp_path / "in" / "cleanup_report").exists()
    kept = funnel.run_files(spark, replace(c, dry_run=False)).kept.count()
    back = spark.read.schema(schema.EXAMPLE).json(f"file://{tmp_path}/out/examples")
    assert back.count() == kept > 0
    assert funnel.run_files(spark, replace(c, inputs=(("none.jsonl", "other"),))) is None


# --- Samples of exact size


def test_repeated_rows_are_parted_exactly(spark):
    """Many rows of one id, of one group: sizes are those of the counts all the same."""
    rows = [(1, "a")] * 50 + [(i % 5, "b") for i in range(47)] + [(None, "b")] * 13 + [(i, None) for i in range(30)] + [(7, "c")]
    df = spark.createDataFrame(rows, "id int, k string")
    n = Counter(k for _, k in rows)
    split = Counter((r["k"], r["split"]) for r in sampling.stratified_split(df, 3, ["k"]).collect())
    for k, count in n.items():
        nt, nv = max(1, int(count * 0.9)), int(count * 0.05)
        nv = max(0, count - nt - 1) if nt + nv >= count else nv
        assert [split[k, s] for s in ("train", "valid", "test")] == [nt, nv, count - nt - nv]
    some = Counter(r["k"] for r in sampling.stratified_fraction(df, 0.3, 3, stratum="k").collect())
    assert some == {k: max(1, int(c * 0.3)) for k, c in n.items()}
    left = Counter(r["k"] for r in sampling.balance(df, 3, share=0.3, stratum="k").collect())
    assert left == {k: c for k, c in (sampling.balance_counts(n, 0.3) | {None: n[None]}).items() if c}


def test_halves_of_any_ids(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("d",), ("c",), (None,)], "id string")
    assert sorted((r["id"] or "", r["batch"]) for r in sampling.halves(df).collect()) == [("", 1), ("", 1), ("a", 1), ("b", 2), ("c", 2), ("d", 2)]


# --- External calls


@pytest.mark.parametrize(("said", "score"), [('{"score": 3}', 3), ('{"score": "4"}', 4), ('{"score": 3.9}', 3), ("{}", 0), ('why</think>```json\n{"score": 1}\n```', 1), ("[3]", None), ("three", None), ('{"score": null}', None), ('{"score": "x"}', None), ("", None)])
def test_scores_of_replies(said, score):
    if score is None:
        with pytest.raises((ValueError, TypeError)):
            generation.parsed_score(said)
    else:
        assert generation.parsed_score(said)[0] == score


def test_a_call_that_hangs_is_left_behind(spark):
    def provider():
        def call(prompt):
            if prompt == "hang":
                time.sleep(30)
            if prompt == "fail":
                raise RuntimeError("no")
            return prompt

        return call

    df = spark.createDataFrame([(1, "hang"), (2, "fail"), (3, "fine")], "id int, prompt string")
    began = time.monotonic()
    got = {r["id"]: (r["response"], r["failed"], r["attempts"]) for r in generation.generate(df, provider, partitions=1, retries=2, timeout=0.2, marks=True).collect()}
    assert got == {1: ("(TIMEOUT)", True, 2), 2: ("(ERROR: no)", True, 2), 3: ("fine", False, 1)} and time.monotonic() - began < 25


def test_calls_that_hang_do_not_hold_up_the_others(spark):
    def provider():
        return lambda prompt: time.sleep(1.5) if prompt == "hang" else prompt

    df = spark.range(160).select("id", F.when(F.col("id") % 2 == 0, "hang").otherwise("fine").alias("prompt"))
    began = time.monotonic()
    got = generation.generate(df, provider, partitions=1, retries=1, timeout=0.5, marks=True, calls=40).collect()
    assert {r["id"]: r["response"] for r in got} == {i: "fine" if i % 2 else "(TIMEOUT)" for i in range(160)}
    assert time.monotonic() - began < 20  # one after another: 40 s


def test_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: [round(x, 3) for x in r["embedding"]] for r in generation.embeddings(df, lambda: lambda texts: [[len(t), 0] for t in texts]).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_chunks_of_a_run(spark):
    chunks, done = spark.range(10), spark.range(3)
    ids = lambda c: sorted(r["id"] for r in generation.to_generate(chunks, done, c).collect())
    assert ids(C.GenerationConfig()) == list(range(3, 10)) and ids(C.GenerationConfig(limit=5)) == [3, 4] and ids(C.GenerationConfig(limit=2, resume=False)) == [0, 1]

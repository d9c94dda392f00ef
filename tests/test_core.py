"""Operators on hand-written edge rows and against naive models."""

import json
import threading

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import text as X
from sieveline.functions.classify import chunk_text, extract_text, stratum
from sieveline.operators import components, dedup, evalstats, generation, quality, report, sampling, stages
from sieveline.plans import registry
from sieveline.sources import files, schema
from sieveline.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


# --- Text


@pytest.mark.parametrize(("text", "expect"), [("\t\n a b  ", "a b"), ("", ""), (" 　", ""), (None, None)])
def test_strip(spark, text, expect):
    assert one(spark, text, X.strip) == expect


@pytest.mark.parametrize(("text", "expect"), [("ab12", 0.5), ("", 0.0), ("é😀", 0.5), ("ñß", 1.0)])
def test_alpha_ratio(spark, text, expect):
    assert one(spark, text, X.alpha_ratio) == expect


@pytest.mark.parametrize(("text", "expect"), [("<think>a</think> b </think>c", "b </think>c"), ("```json\n[1]\n```", "[1]"), ("x</think>\n```\n[2]\n``` end", "[2]"), (" plain ", "plain"), ("```json\nopen", "open"), ("```a\nx ``` y\n```\nz", "x ``` y"), (None, None)])
def test_strip_reasoning(spark, text, expect):
    assert one(spark, text, X.strip_reasoning) == expect


@pytest.mark.parametrize(("pattern", "text", "expect"), [(X.LIST, "a\n - b", 1), (X.LIST, "a\r- b", 0), (X.LIST, "2) b", 1), (X.LIST, "a 2) b", 0), (X.HEADERS, "## T", 1), (X.HEADERS, "Título largo: \nx", 1), (X.HEADERS, "título largo:", 0),
                                                     (X.DOSING, "5 MG", 1), (X.EVIDENCE, "CLASE iv", 1), (X.CITATION, "smith ET AL", 1), (X.CITATION, "none", 0)])
def test_patterns(spark, pattern, text, expect):
    assert one(spark, text, lambda c: X.has(c, pattern)) == expect


@pytest.mark.parametrize(("text", "expect"), [("NO PUEDO DAR UN DIAGNÓSTICO", True), ("as an airway", True), ("as a AI", False), ("consultar a médico", True), ("consulta profesional", True), ("Consulte con su especialista", True), ("all is well", False), ("I'm not able to", True), ("no sustituye el consejo", True)])
def test_evasive(spark, text, expect):
    assert one(spark, text, lambda c: X.is_evasive(c, C.EVASIVE)) is expect


def test_overlap_chunks(spark):
    assert one(spark, "", X.overlap_chunks) == [""]
    t = "".join(chr(97 + i % 26) for i in range(1000))
    assert one(spark, t, X.overlap_chunks) == [t[0:500], t[400:900], t[800:1000]]


def test_features_of_nothing(spark):
    f = X.features(F.col("q"), F.col("a"))
    r = spark.createDataFrame([("", ""), ("ab", "A a  b. ¿c?!")], "q string, a string").select(*[v.alias(k) for k, v in f.items()]).collect()
    assert (r[0]["ratio_aq"], r[0]["ttr"], r[0]["word_count"], r[0]["sentence_count"]) == (0, 0, 0, 0)
    assert (r[1]["word_count"], r[1]["sentence_count"], r[1]["ttr"]) == (4, 2, 0.75)


@pytest.mark.parametrize(("row", "sampler", "extractor"), [
    (("Breast", "", "", "", "x"), "tratamiento", "tratamiento"), (("s", "PHARMA", "", "", "pain"), "farmacologia", "farmacologia"), (("s", "", "farmacia", "", ""), "farmacologia", "farmacologia"),
    (("survivorship", "", "", "", "pain"), "soporte", "soporte"), (("s", "", "", "Staging", "TNM biopsia"), "diagnostico", "diagnostico"), (("s", "", "", "", "x" * 499 + " pain"), "tratamiento", "tratamiento"), (("s", "", "", "", "dose dosing"), "farmacologia", "tratamiento")])
def test_chunk_classifiers(spark, row, sampler, extractor):
    df = spark.createDataFrame([row], "source string, society string, category string, section_path string, text string")
    c = [F.col(x) for x in ("source", "section_path", "text")]
    got = df.select(stratum(C.SAMPLER, chunk_text(*c), F.lower("source"), F.col("society"), F.col("category")), stratum(C.EXTRACTOR, extract_text(*c), None, F.col("society"), F.col("category"))).first()
    assert tuple(got) == (sampler, extractor)


@pytest.mark.parametrize(("text", "expect"), [("temporal", "farmacologia"), ("quimioterapia", "tratamiento"), ("nada aquí", "otros"), ("HER2 y PD-L1".lower(), "diagnostico"), ("dolor control", "soporte")])
def test_example_classifier(spark, text, expect):
    assert one(spark, text, lambda c: stratum(C.EXAMPLES, c)) == expect


# --- Funnel


def turns(*said):
    return json.dumps({"messages": [dict(zip(("role", "content"), x)) for x in said]})


def example(user, assistant, system="s"):
    return turns(("system", system), ("user", user), ("assistant", assistant))


def test_jsonl_edges_and_funnel(spark, tmp_path):
    q, a = "q" * 30, "a" * 300
    lines = ["", "   ", "{broken", "17", "[1]", '{"messages": "no"}', '{"messages": [1, 2, 3]}', example(q, a)[:-3], example(q, a), example("q" * 29, a), example(q, "a" * 299), example(q, "é" * 300), example(q, "no es posible " + a), example(q, "No estoy capacitado " + a), example(q, ""),
             turns(("user", q), ("assistant", a)), turns(("assistant", "x"), ("user", q), ("assistant", a)), turns(("user", q), (None, a), (None, a))]
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.jsonl").write_bytes("\n".join(lines).encode() + b"\n\xff\xfe{bad bytes\n")
    df = files.read_tagged(spark, [(f"file://{path}", "src"), (f"file://{tmp_path}/none", "none")])
    assert df.count() == len(lines) - 2 + 1
    c = C.FunnelConfig()
    got = stages.with_rejection(df, c)
    n = {r["rejected_at"]: r["n"] for r in got.groupBy("rejected_at").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {1: 10, 2: 1, 3: 1, 4: 1, None: 4}
    rep = {(r["stage"], r["source"]): (r["before"], r["rejected"], r["remaining"]) for r in stages.funnel_report(got, c, "_source").collect()}
    assert rep["question_length", "src"] == (5, 1, 4)
    assert stages.run_funnel(df, c)[-1].kept.count() == 4
    skipped = C.FunnelConfig(skip=frozenset({"evasive"}))
    assert stages.run_funnel(df, skipped)[-1].kept.count() == 5
    assert {r["skipped"] for r in stages.funnel_report(stages.with_rejection(df, skipped), skipped, "_source").where("stage = 'evasive'").collect()} == {True}
    assert files.read_tagged(spark, [(f"file://{tmp_path}/none", "none")]) is None


def test_published_funnel_arithmetic():
    n = 292_862
    for rejected, left in zip((28_225, 36, 1, 3_543, 0, 4_823, 30_469), (264_637, 264_601, 264_600, 261_057, 261_057, 256_234, 225_765)):
        n -= rejected
        assert n == left


# --- Generation


def test_parse_pairs(spark):
    said = [("a", '[{"pregunta": "P", "respuesta": "R"}, {"question": "", "pregunta": "p", "answer": "A", "type": "decision"}]'), ("b", "[]"), ("c", "no"), ("d", '{"question": "x"}'), ("e", '<think>x</think>```json\n[{"question": "Q", "answer": "W", "tipo": "caso_clinico"}]\n```'), ("f", None)]
    rows = generation.parse_pairs(spark.createDataFrame(said, "id string, r string"), "r").orderBy("id", "pair_no").collect()
    assert [(r["id"], r["type"], r["question"], r["answer"]) for r in rows if r["id"] != "d"] == [("a", "conocimiento", "P", "R"), ("a", "decision", "p", "A"), ("e", "caso_clinico", "Q", "W")]


@pytest.mark.parametrize(("answer", "source", "society", "expect"), [("Text. \n", "Guide", "", "Text.\n\n[Fuente: Guide]"), ("by GUIDE", "guide", "S", "by GUIDE"), ("x", "G", "S", "x\n\n[Fuente: G, S]"), ("x", "", "S", "x"), ("x", None, None, "x")])
def test_cite(spark, answer, source, society, expect):
    df = spark.createDataFrame([(answer, source, society)], "a string, s string, o string")
    assert df.select(generation.cite(F.col("a"), F.col("s"), F.col("o"))).first()[0] == expect


def test_prompt_defaults(spark):
    df = spark.createDataFrame([("t", None, "S", "sec", "soporte"), ("t", "src", None, None, "?")], "text string, source string, society string, section_path string, stratum string")
    a, b = (r[0] for r in df.select(generation.prompt(C.HINTS)).collect())
    assert a.startswith("FUENTE: [S] Guía clínica > sec\nTIPO DE CONTENIDO: soporte\n\nFRAGMENTO:\nt\n\n") and C.HINTS["soporte"] in a
    assert b.startswith("FUENTE: src\nTIPO DE CONTENIDO: ?\n") and "fragmento. \nResponde" in b


def test_provider_retries_and_records_failures(spark):
    def failing():
        calls = {"n": 0}

        def call(p):
            calls["n"] += 1
            if p == "never" or (p == "later" and calls["n"] < 3):
                raise RuntimeError
            return p.upper()

        return call

    df = spark.createDataFrame([("1", "never"), ("2", "later")], "id string, prompt string")
    got = {r["id"]: (r["response"], r["failed"], r["attempts"]) for r in generation.generate(df.where("id = '2'"), failing, partitions=1).union(generation.generate(df.where("id = '1'"), failing, partitions=1)).collect()}
    assert got == {"2": ("LATER", False, 3), "1": (None, True, 3)}


# --- Dedup


def dense_rule(n, near, length):
    """The tile loop over all cells, as it would run on one machine."""
    alive = [True] * n
    for i in range(n):
        for j in range(i + 1, n):
            if alive[i] and alive[j] and (i, j) in near:
                if length[i] >= length[j]:
                    alive[j] = False
                else:
                    alive[i] = False
                    break
    return {i for i in range(n) if not alive[i]}


@settings(deadline=None, max_examples=200)
@given(st.data())
def test_greedy_equals_the_dense_loop(data):
    n = data.draw(st.integers(1, 9))
    near = data.draw(st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] < p[1]), max_size=14))
    length = dict(enumerate(data.draw(st.lists(st.integers(0, 3), min_size=n, max_size=n))))
    assert dedup.greedy_self(list(near), length) == dense_rule(n, near, length)


@pytest.mark.parametrize("lengths", [(1, 1, 1), (1, 2, 3), (3, 2, 1), (1, 3, 2), (2, 1, 3)])
def test_chain_of_similar_rows(spark, lengths):
    """A~B~C without A~C."""
    v = [np.cos(x) for x in (0, 0.3, 0.6)], [np.sin(x) for x in (0, 0.3, 0.6)]
    df = spark.createDataFrame([(i, [float(v[0][i]), float(v[1][i])], n) for i, n in enumerate(lengths)], "vec_id bigint, embedding array<float>, length int")
    kept = {r["vec_id"] for r in dedup.semantic_dedup(df, 0.95).collect()}
    assert kept == {0, 1, 2} - dedup.greedy_self([(0, 1), (1, 2)], dict(enumerate(lengths)))


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_similar_pairs_against_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(99, None), (100, [0.0] * 5)], "vec_id bigint, embedding array<double>")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expect = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.6}
    assert {(r["i"], r["j"]) for r in dedup.similar_pairs(df, 0.6, blocks=blocks).collect()} == expect


def test_similar_pairs_hold_no_whole_group(spark):
    df = spark.createDataFrame([(i, [1.0, i / 3000], 1, "a") for i in range(3000)], "vec_id bigint, embedding array<float>, length int, source string")
    assert "FlatMapGroups" not in dedup.similar_pairs(df, 0.5)._jdf.queryExecution().toString()
    assert dedup.similar_pairs(df, 0.5, blocks=2).count() == 3000 * 2999 // 2
    packed = list(dedup._packed([pa.record_batch({"id": pa.array(range(3000)), "v": pa.array([[1.0, i / 3000] for i in range(3000)], pa.list_(pa.float32())), "b": pa.array([0] * 3000, pa.int32())})]))
    met = (pa.record_batch({"x": p["b"], "y": p["b"], "b": p["b"], "ids": p["ids"], "vs": p["vs"]}) for p in packed)
    sizes = [b.num_rows for b in dedup._pairs(met, 0.5)]
    assert sum(sizes) == 3000 * 2999 // 2 and max(sizes) <= dedup.FOUND + dedup.PACK * dedup.TILE


def test_greedy_reads_pairs_one_by_one(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(50)], "vec_id bigint, embedding array<float>, length int")
    gone = dedup.semantic_rejects(df, 0.9)
    assert "FlatMapGroups" not in gone._jdf.queryExecution().toString() and sorted(r["id"] for r in gone.collect()) == list(range(1, 50))
    seen = []
    dropped = dedup._drop_self((seen.append(k), (0, k, True))[1] for k in range(1, 1000))
    assert next(dropped) == 1 and seen == [1]


def test_cross_source(spark):
    rows = [(0, [1.0, 0.0], 5, "s"), (1, [1.0, 0.0], 9, "m"), (2, [1.0, 0.01], 1, "m"), (3, [0.0, 1.0], 1, "s"), (4, [1.0, 0.0], 1, "s")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, length int, source string")
    # Row 0 loses to 1 but goes on to meet 2; row 4 then loses to 1 only.
    assert dedup.greedy_cross([(0, 1), (0, 2), (4, 1), (4, 2)], {0: 5, 1: 9, 2: 1, 4: 1}) == {0, 2, 4}
    assert {r["vec_id"] for r in dedup.cross_source_dedup(df, 0.95, "s", "m").collect()} == {1, 3}
    assert dedup.cross_source_dedup(df.where("source = 's'"), 0.95, "s", "m").count() == 3


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    parent = list(range(31))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for n in range(31) if find(n) != n}


def test_prefix_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "abcX"), (1, "abcY"), (2, "abd"), (4, None), (5, None)], "id int, text string")
    assert sorted(r["id"] for r in dedup.prefix_dedup(df, 3, [F.col("id")]).collect()) == [1, 2, 4]


# --- Samples


@pytest.mark.parametrize(("counts", "top", "total"), [((45922, 15824, 131079, 4079, 13984, 14877), 63130, 157816), ((47706, 15923, 142249, 4353, 15064, 15775), 65888, 164709), ((1000,), 0, 0), ((500, 500), 52, 104), ((10, 10, 10), 10, 30)])
def test_published_balance(counts, top, total):
    got = sampling.balance_counts({str(k): n for k, n in enumerate(counts)})
    assert max(got.values()) == top and sum(got.values()) == total


@pytest.mark.parametrize(("n", "expect"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (10, (9, 0, 1)), (20, (18, 1, 1)), (100, (90, 5, 5))])
def test_split_sizes(spark, n, expect):
    df = spark.range(n).select("id", F.lit("a").alias("k"))
    got = {r["split"]: r["n"] for r in sampling.stratified_split(df, 42, ["k"]).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert tuple(got.get(s, 0) for s in ("train", "valid", "test")) == expect


def test_global_splits_and_halves(spark):
    df = spark.range(101)
    g = {r["split"]: r["n"] for r in sampling.global_split(df, 1).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert g == {"train": 80, "valid": 10, "test": 11}
    h = {r["id"]: r["batch"] for r in sampling.halves(df.union(df.limit(0))).collect()}
    assert [h[i] for i in range(101)] == [1] * 50 + [2] * 51
    assert sampling.halves(df.limit(0)).count() == 0 == sampling.global_split(df.limit(0), 1).count()


def test_round_robin_against_a_loop(spark):
    import hashlib

    rows = [(i, f"s{(i * i) % 7 if i % 3 else 0}", "a" if i % 2 else "b") for i in range(60)]
    targets = {"a": 9, "b": 25, "c": 5}
    got = {}
    for r in sampling.round_robin(spark.createDataFrame(rows, "id int, source string, stratum string"), targets, 42).orderBy("stratum", "pick").collect():
        got.setdefault(r["stratum"], []).append(r["id"])
    key = lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest()
    for s in "ab":
        mine = [r for r in rows if r[2] == s]
        by = {}
        for i, src, _ in mine:
            by.setdefault(src, []).append(i)
        order, picked, visit = sorted(by, key=key), [], 0
        while len(picked) < targets[s] and visit < targets[s] * 10:
            rnd, pos = divmod(visit, len(order))
            if rnd < len(by[order[pos]]):
                picked.append(by[order[pos]][rnd])
            visit += 1
        picked += sorted((i for i, *_ in mine if i not in picked), key=key)[: targets[s] - len(picked)]
        assert got[s] == picked
    assert "c" not in got


# --- Reports and statistics


@pytest.mark.parametrize(("values", "median"), [([1, 2, 3, 4], 3), ([5], 5), ([1, 1, 9], 1), ([2, 1], 2), ([], None)])
def test_upper_median(spark, values, median):
    df = spark.createDataFrame([("x" * v,) for v in values], "t string")
    r = report.length_stats(df, F.length("t")).first()
    assert r["median_len"] == median and r["n"] == len(values)


def test_bands_have_no_gaps(spark):
    v = [4.5, 4.45, 3.5, 3.49, 2.5, 1.5, 1.49, 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "s double").select(evalstats.band(F.col("s"))).collect()]
    assert got == ["excellent", "good", "good", "acceptable", "acceptable", "insufficient", "unacceptable", "unacceptable", None]


def test_krippendorff_of_known_data(spark):
    same = spark.createDataFrame([(u, r, float(u)) for u in range(5) for r in (1, 2)], "u int, r int, v double")
    assert evalstats.krippendorff(same, ["u"], "v").first()["alpha"] == 1.0
    one_rater = same.where("r = 1")
    assert evalstats.krippendorff(one_rater, ["u"], "v").first()["alpha"] is None


def test_score_filter_keeps_unscored(spark):
    df, s = spark.range(4), spark.createDataFrame([(0, 2), (0, 5), (1, 3), (9, 0)], "id bigint, score int")
    assert sorted(r["id"] for r in quality.score_filter(df, s, 3, "id").collect()) == [1, 2, 3]


def test_classifier_needs_two_classes(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "f double, y int")
    assert quality.train(df, ["f"], "y") is None


def test_folds_are_trained_at_once_on_few_partitions(spark, monkeypatch):
    df = spark.range(200, numPartitions=16).select("id", (F.col("id") % 17).cast("double").alias("f"), (F.col("id") % 17 > 8).cast("int").alias("y"))
    real, met, parts = quality.GBTClassifier, threading.Barrier(5), []

    class Spy:
        def __init__(self, **parameters):
            self.parameters = parameters

        def fit(self, data):
            parts.append(data.rdd.getNumPartitions())
            met.wait(100)  # until all five are here
            return real(**self.parameters).fit(data)

    monkeypatch.setattr(quality, "GBTClassifier", Spy)
    got = quality.cv_f1(df, ["f"], "y", "id", max_iter=1)
    assert sorted(map(tuple, got.collect())) == [(k, 1.0) for k in range(1, 6)] and parts == [1] * 5


# --- Streams and files


def test_stream_takes_up_where_it_left(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    df = spark.range(10).select(F.col("id").cast("string").alias("id"))
    seen = []
    for part in (df.where("id < 5"), df):  # ids below 5 arrive twice
        part.write.mode("append").parquet(src)
        incremental.run_available(spark.readStream.schema(df.schema).parquet(src), lambda b: b.withColumn("done", F.lit(True)), out, state)
        seen.append(spark.read.parquet(out).count())
    assert seen == [5, 10]


def test_first_wins_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("abc1",), ("abc2",), ("x",)], "text string").coalesce(1).write.parquet(src)
    q = incremental.first_wins(spark.readStream.schema("text string").parquet(src), 3).writeStream.format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["text"][:3] for r in spark.table("wins").collect()) == ["abc", "x"]


def test_scratch_folder_is_the_shared_one(spark):
    assert files.scratch_path(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_score_files_of_many_parts_lose_no_row(spark, tmp_path):
    df = spark.range(100, numPartitions=16).select(F.col("id").alias("index"), F.lit(1).alias("score"), F.lit("q").alias("reason"), F.lit(None).cast("string").alias("stratum"))
    files.write_scores(df, f"file://{tmp_path}/a", 3)
    got = files.read_scores(spark, f"file://{tmp_path}/a").collect()
    assert sorted(got) == sorted(df.collect())
    df.select(F.col("index").alias("doc_id"), F.col("score").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert sorted(r["index"] for r in registry.QUERIES["s5_s6_score_files"](spark, f"file://{tmp_path}").collect()) == list(range(100))

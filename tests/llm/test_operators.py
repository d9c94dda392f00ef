"""Small and brute-force tests of the training-data operators."""

import datetime
import math
import os
import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from sieveline.llm import avi, decontam, mixing, pii, quality, resharding, simhash, styletree, toxicity, trainorder
from sieveline.llm.common import cumulative_thresholds, key_hash, table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for themselves or add.
CLASHES = ["score", "h", "threshold", "target", "old_shard", "NEW_SHARD", "moved", "n_pii", "kinds", "quality_score", "w", "id", "root", "fp", "th", "key", "label", "tier", "lo", "hi", "_sv_source", "_sv_threshold", "_sv_id", "_sv_th", "_sv_pii"]
LONG = "alpha beta gamma delta " * 40_000


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a mossy oak"
    return [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, "", "en", "b", 0), (4, "   \n", "en", "b", 4), (5, None, None, None, None), (None, base, "en", None, 5), (None, None, None, None, None),
            (6, LONG, "en", "b", len(LONG)), (7, LONG, "en", "c", len(LONG)), (8, "entirely different words about harbour cranes, tides and slow freight", "en", "c", 2), (9, "!!! ???", "en", "c", 7), (9, "another text of the same id that is not like the other one at all", "en", "c", 7)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def bag(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


# --- Shared


def test_cumulative_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[int(rng.integers(2))] if i % 9 else None, int(h), int(rng.integers(0, 20))) for i, h in enumerate(np.r_[rng.integers(0, 1 << 60, 300), [5] * 4, [(1 << 60) - 1] * 3])]
    df = spark.createDataFrame(rows, "g string, h bigint, w bigint")
    targets = [(g, f"{g}{t}", t) for g in ("a", "b", None) for t in (0, 1, 57, 300, 10**6)]
    got = {r["target_id"]: r["threshold"] for r in cumulative_thresholds(df, "g", "h", "w", spark.createDataFrame(targets, "g string, target_id string, target bigint")).collect()}
    for g, name, t in targets:
        mine = [(h, w) for x, h, w in rows if x == g]
        expect = 1 << 60
        for h in sorted({h for h, _ in mine}):
            if sum(w for k, w in mine if k <= h) > t:
                expect = h
                break
        assert got[name] == expect, name


# --- 1 Quality


def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    test = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").toPandas()
    s = model.scores(list(test["text"]))
    good = test["quality"].to_numpy() == 1
    assert (s[good] >= quality.THRESHOLD).mean() > 0.99 and (s[~good] >= quality.THRESHOLD).mean() < 0.15  # about 300 examples are bad


def test_quality_vote_is_exact():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 6)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = rng.integers(0, 2, 90).astype(float)
    m = quality.Model({}, np.zeros((0, 6), np.float32), v, y, np.ones(90))
    x = v[:40] + 0.1
    got = m.vote(x)
    for i in range(40):
        sims = sorted(((round(float(x[i] @ v[j]), 5), j) for j in range(90)), reverse=True)
        kth = sims[quality.NEIGHBOURS - 1][0]
        near = [(s, j) for s, j in sims if s >= kth and s > 0]
        assert math.isclose(got[i], sum(s**4 * y[j] for s, j in near) / sum(s**4 for s, _ in near), rel_tol=2e-3)


def test_quality_edges(spark, edge, empty):
    labels = labels_of(spark, [(1, 1, 0), (8, 0, 0), (8, 0, 0), (None, 1, 1), (4, None, None)])
    kept = quality.quality_filter(edge, edge, labels)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {1, 2}
    assert not kept.where("text is null or trim(text) = ''").count()
    assert quality.quality_filter(edge, edge, labels_of(spark)).count() == 0
    assert quality.quality_filter(empty, empty, labels).count() == 0
    assert "quality_score" in quality.quality_filter(edge, edge, labels, score_col="quality_score").columns
    one_class = [(i, 1, 0) for i in (1, 2, 8)]
    assert {r["doc_id"] for r in quality.quality_filter(edge, edge, labels_of(spark, one_class)).collect()} >= {1, 2, 8}
    assert quality.quality_filter(edge, edge, labels_of(spark, [(i, 0, k) for i, _, k in one_class])).count() == 0


def test_quality_vocabulary_is_all_shared_terms(spark):
    """Every term that two examples share is in the model, with its count over all documents."""
    texts = [f"shared{i // 2} common word{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, "shared3 shared3 elsewhere")], "doc_id bigint, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"))
    have = set().union(*map(quality.terms, texts))
    assert set(model.vocabulary) == {t for t in have if sum(t in quality.terms(x) for x in texts) > 1}


# --- 2 Decontamination


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i] + [0] * len(t)
        for j, b in enumerate(t, 1):
            now[j] = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a != b))
        row = now
    return min(row)


@given(st.text("abc ", min_size=1, max_size=14), st.text("abc ", max_size=30))
def test_myers_is_edit_distance(p, t):
    d = edits(p, t)
    assert decontam.myers(p, t, len(p)) == d
    assert (decontam.myers(p, t, d - 1) is None) if d else True


@settings(deadline=None)
@given(st.data())
def test_matcher_against_brute_force(data):
    items = [(i, t) for i, t in enumerate(data.draw(st.lists(st.text("ab", min_size=12, max_size=30), min_size=1, max_size=4)))]
    text = data.draw(st.text("ab", max_size=40))
    got = {i: d for i, d, _ in decontam.Matcher(items, 0.2)(text)}
    for i, item in items:
        d = edits(item, text)
        assert got.get(i) == (d if d <= int(0.2 * len(item)) else None)


def test_contamination_edges(spark, edge, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wise"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "the"), (5, "The QUICK, brown fax jumps over the lazy dog while seven wise!")], "item_id bigint, text string")
    hits = bag(decontam.contamination(edge, bench), "doc_id", "item_id", "distance")
    assert hits == sorted([(d, i, k) for d in (1, 2, 2, None) for i, k in ((1, 0), (1, 0), (5, 1))], key=repr)
    clean = decontam.decontaminate(edge, bench)
    assert clean.columns == edge.columns and clean.count() == edge.count() - 4
    assert bag(decontam.contamination(edge, bench, block_chars=10), "doc_id", "item_id", "distance") == hits
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(edge, bench.limit(0)).count() == 0
    assert decontam.decontaminate(edge, bench.limit(0)).count() == edge.count()
    assert bag(decontam.decontaminate(edge, bench, block_chars=10), "doc_id", "text") == bag(clean, "doc_id", "text")


def test_contamination_of_short_items_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d0", "Why?\nHow high is it"), ("d1", "tell me how high is it, please"), ("d2", "多少钱这件衣服现在多少钱呢？请告诉我吧"), (None, "HOW HIGH, is it")], "doc_id string, text string")
    bench = spark.createDataFrame([("mmlu/1", "How high is it?"), ("zh", "这件衣服现在多少钱呢")], "item_id string, text string")
    # An item too short to be told from chance counts as a whole line; ten Chinese characters are long enough anywhere.
    assert bag(decontam.contamination(docs, bench), "doc_id", "item_id", "distance") == sorted([("d0", "mmlu/1", 0), (None, "mmlu/1", 0), ("d2", "zh", 0)], key=repr)
    assert {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()} == {"d1"}


# --- 3 Mixing


def test_mixing_edges(spark, edge, empty):
    got = mixing.mix(edge)
    kept = mixing.mix_filter(edge)
    assert kept.columns == edge.columns and kept.count() == got.count()
    assert mixing.mix(empty).count() == mixing.mix_filter(empty).count() == 0
    only = mixing.mix(edge, weights={"a": 1.0, "c": 0.0, "nowhere": 2.0})
    assert {r["source"] for r in only.collect()} == {"a"} and only.count() == 3


def filled(have, weight, budget):
    """Tokens of each source at the level that meets the budget, by bisection."""
    lo, hi = 0.0, max(have[s] / weight[s] for s in have)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(have[s], mid * weight[s]) for s in have) < budget else (lo, mid)
    return {s: min(have[s], hi * weight[s]) for s in have}


def test_mixing_budgets_are_nested_and_met(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = mixing.mix(docs, tiers=(0.3, 1.0)).toPandas()
    tokens = docs.select("source", mixing.token_count(F.col("text")).alias("t")).groupBy("source").agg(F.sum("t").alias("t"), F.max("t").alias("longest")).toPandas().set_index("source")
    have = tokens["t"].to_dict()
    for tier, share in ((1, 0.3), (2, 1.0)):
        used = got[got["tier"] <= tier].groupby("source")["tokens"].sum()
        for s, target in filled(have, {s: t**mixing.ALPHA for s, t in have.items()}, share * mixing.BUDGET * sum(have.values())).items():
            # A source ends with the document that reaches its share.
            assert target - 1 <= used[s] < target + tokens["longest"][s]


def test_mixing_with_a_budget_is_not_set_by_the_smallest_source(spark):
    rows = [(i, "word " * 10, "ab"[i % 2]) for i in range(200)] + [(999, "a straggler", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    used = {r["source"]: r["t"] for r in mixing.mix(docs, tiers=(1.0,), budget=1002).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert used == {"a": 500, "b": 500, None: 2}
    assert mixing.mix_filter(docs, budget=10**9).count() == len(rows)
    # Nor without a budget: the mixture has its share of all tokens, and the source of one document gives it.
    used = {r["source"]: r["t"] for r in mixing.mix(docs, tiers=(1.0,)).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert used == {"a": 800, "b": 800, None: 2}


def test_a_very_long_document_does_not_end_its_source_early(spark):
    """Wherever its hash lies, the source gives its share at least."""
    rows = [(i, "word " * 10, "a") for i in range(100)] + [(1000 + i, "word " * 10, "b") for i in range(100)] + [(5000, "long " * 700, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in ("x:", "y:", "z:"):
        used = {r["source"]: r["t"] for r in mixing.mix(docs, tiers=(1.0,), budget=1000, weights={"a": 1.0, "b": 1.0}, seed=seed).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        assert used["b"] == 500 and 500 <= used["a"] < 1200


# --- 4 AVI


@pytest.mark.parametrize("restart", [0, 1, 5])
@pytest.mark.parametrize("tables", [False, True])
def test_jpeg_round_trip(restart, tables):
    rng = np.random.default_rng(restart)
    for planes, s in (([rng.integers(0, 256, (32, 48))], 1), ([rng.integers(0, 256, (32, 48)), rng.integers(0, 256, (16, 24)), rng.integers(0, 256, (16, 24))], 2), ([rng.integers(0, 256, (16, 24))] * 3, 1)):
        out = avi.decode_jpeg(avi.encode_jpeg(planes, 2, s, restart, tables))
        assert all(np.abs(a.astype(int) - b).max() <= 4 for a, b in zip(out, planes, strict=True))


def test_jpeg_agrees_with_the_jvm(spark):
    """The decoder and ImageIO see the same grey pixels."""
    x = np.add.outer(np.arange(24) * 5, np.arange(40) * 3) % 256
    data = avi.encode_jpeg([x], 3, 1, 0, True)
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    raster, ours = image.getRaster(), avi.decode_jpeg(data)[0]
    assert (image.getHeight(), image.getWidth()) == ours.shape
    assert max(abs(raster.getSample(c, r, 0) - int(ours[r, c])) for r in range(24) for c in range(40)) <= 1


@pytest.mark.parametrize("restart", [0, 3])
def test_frames_decoded_together_agree_with_one_by_one(restart, monkeypatch):
    """Frames of several sizes and samplings, cut and broken ones among them, in windows of few blocks."""
    rng, frames = np.random.default_rng(restart), []
    for k in range(12):
        side = 32 if k % 2 else 16
        planes = [rng.integers(0, 256, (side, side)).astype(float)] + [rng.integers(0, 256, (side // 2, side // 2)).astype(float) for _ in range(2 * (k % 3 > 0))]
        frames.append(avi.encode_jpeg(planes, q=1 + 3 * k, restart=restart, tables=k % 4 == 0))
    frames += [frames[0][: len(frames[0]) // 2], b"", b"no picture", frames[1].replace(b"\xff\xda", b"\xff\xdb", 1)]
    monkeypatch.setattr(avi, "WINDOW_BLOCKS", 7)
    for data, got in zip(frames, avi.histograms(frames), strict=True):
        try:
            planes = avi.decode_jpeg(data)
        except (avi.MediaError, IndexError, ValueError):
            assert got is None
            continue
        assert got[1] == planes[0].shape and np.allclose(got[0], avi.histogram(planes))


@pytest.mark.parametrize("index", ["idx1", "absolute", "odml", "none"])
def test_avi_indexes(index):
    frames = [avi.encode_jpeg([np.full((16, 16), v)]) for v in (10, 12, 200, 201, 90, 91, 92)]
    data = avi.write_avi(frames, 16, 16, 40_000, index)
    film = avi.Avi(data)
    assert [data[a : a + n] for a, n in film.frames()] == frames
    assert bool(film._odml()) == (index == "odml") and bool(film._idx1()) == (index in ("idx1", "absolute"))
    assert [(r["start_frame"], r["n_frames"], r["start_s"]) for r in avi.clip_rows(data)] == [(0, 2, 0.0), (2, 2, 0.08), (4, 3, 0.16)]


def test_avi_edges(spark):
    good = avi.render(1, np.linspace(-1, 1, 64))
    broken = good.replace(b"\xff\xc0", b"\xff\xc2")
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, good[:200]), (5, broken), (None, good), (6, b"RIFF" + b"\0" * 40), (7, avi.write_avi([], 8, 8, 40_000))]
    df = spark.createDataFrame(rows, "id bigint, media binary").select("*", F.lit(1).alias("clip"), F.lit(2).alias("error"))
    got = bag(avi.clips(df, "id", "media"), "id", "clip", "error")
    assert [g for g in got if g[0] == 1] == [(1, 0, None)] * 2 + [(1, 1, None)] * 2
    assert not [g for g in got if g[0] == 2]
    assert all(g[1] is None and g[2] for g in got if g[0] in (3, 4, 5, 6, 7)) and {g[0] for g in got} >= {3, 4, 5, 6, 7, None}
    assert avi.clips(df.where("false"), "id", "media").count() == 0


def test_slow_drift_is_no_cut():
    ramp = [avi.histogram([np.full((16, 16), v)]) for v in range(20, 40)]
    assert avi.cuts(ramp) == [0]
    assert avi.cuts(ramp + [avi.histogram([np.full((16, 16), 240)])] * 3) == [0, 20]
    assert avi.cuts([]) == []


# --- 5 Training order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_slot_permutation(n):
    p = trainorder.SlotPermutation(n, 7)
    x = p(np.arange(n))
    assert sorted(x.tolist()) == list(range(n)) and (p.inverse(x) == np.arange(n)).all()
    assert n < 100 or (x != trainorder.SlotPermutation(n, 8)(np.arange(n))).any()


def test_training_order_round_trip(spark, edge, tmp_path):
    got = trainorder.training_order(edge, sequence=64, shard_slots=100).toPandas()
    assert sorted(got["slot"]) == list(range(len(got))) and (got["shard"] == got["slot"] // 100).all() and (got["byte_offset"] == got["slot"] % 100 * 128).all()
    stream = np.concatenate([np.frombuffer(b, "<u2") for b in got.sort_values("seq")["tokens"]])
    said = [trainorder.encode(t).tolist() for _, t, *_ in edge_rows() if t is not None]
    docs, now = [], []
    for x in stream.tolist():
        now.append(x)
        if x == trainorder.EOT:
            docs.append(now)
            now = []
    assert sorted(docs[: len(said)]) == sorted(said) and all(d == [trainorder.EOT] for d in docs[len(said) :]) and not now
    records = trainorder.training_order(edge, sequence=64, shard_slots=100)
    uri = f"file://{tmp_path}/shards"
    written = trainorder.write_shards(records, uri)
    assert written.agg(F.sum("slots")).first()[0] == len(got)
    assert not [f for f in os.listdir(tmp_path / "shards") if f.startswith(".")]
    by_slot = got.sort_values("slot")["tokens"].tolist()
    for start in (0, 99, 100, 250):
        assert [a.tobytes() for a in trainorder.read_slots(uri, start, 64, 100)] == by_slot[start:]


def test_training_order_is_that_of_the_keys(spark, edge):
    """The same rows give the same slots however they lie, and the query agrees with a model on plain data."""
    docs = edge.select("doc_id", "text")
    ways = [docs.coalesce(1), docs.repartition(5), docs.orderBy(F.rand(3)).repartition(3)]
    got = [bag(trainorder.training_order(d, sequence=32, shard_slots=50), "slot", "seq", "tokens") for d in ways]
    assert got[0] == got[1] == got[2]
    keyed = docs.where("text is not null").select(key_hash(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")), "order:").alias("h"), "text").collect()
    stream = np.concatenate([trainorder.encode(r["text"]) for r in sorted(keyed, key=lambda r: r["h"])])
    stream = np.append(stream, np.full(-len(stream) % 32, trainorder.EOT, "<u2"))
    n = len(stream) // 32
    slots = trainorder.SlotPermutation(n, trainorder.KEY)(np.arange(n))
    assert got[0] == sorted(((int(s), k, bytearray(stream[32 * k : 32 * k + 32].tobytes())) for k, s in enumerate(slots)), key=repr)


def test_training_order_of_string_ids(spark):
    docs = spark.createDataFrame([("d1", "one two"), (None, "three"), ("d1", "one two"), ("d2", "")], "doc_id string, text string")
    got = trainorder.training_order(docs, sequence=4, shard_slots=2).collect()
    assert sorted({i for r in got for i in r["doc_ids"]}, key=repr) == sorted(["d1", "d2", None], key=repr)


def test_training_order_shuffles_little_beside_the_tokens(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(4)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    docs = spark.createDataFrame(docs.toPandas()).cache()
    docs.count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    got = trainorder.training_order(docs, shard_slots=64).toPandas()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    size = got["tokens"].map(len).sum()
    assert written() - before < 0.72 * size, f"{(written() - before) / size:.2f}"
    ids = np.concatenate([np.frombuffer(t, "<u2") for t in got.sort_values("seq")["tokens"]])
    said = np.concatenate([trainorder.encode(r["text"]) for r in docs.where("text is not null").collect()])
    assert (np.bincount(ids[: len(said)], minlength=1 << 16) == np.bincount(said, minlength=1 << 16)).all()


@pytest.mark.parametrize("common", [[], [7], list(range(100, 355))])
def test_pieces_come_back_whole(common):
    code, rng = trainorder.PieceCode(common), np.random.default_rng(3)
    for ids in ([], [7], [65535, 0, 100, 354, 355], rng.integers(0, 1 << 16, 1000), rng.integers(90, 360, 1024), np.full(1024, 7)):
        ids = np.array(ids, "<u2")
        assert code.unpack(pa.py_buffer(code.pack(ids)), len(ids)) == ids.tobytes()


def test_training_order_empty(spark, empty):
    assert trainorder.training_order(empty).count() == 0


# --- 6 Style tree


def page(k, host="h.example.com"):
    return (k, f"https://{host}/p{k}", f"<html><body><nav><a href='/'>Home</a><a href='/x'>News</a></nav><article><h1>Title {k}</h1><p>Body {k} one.<p>Body {k} two &amp; <b>bold {k}</b>.</article><footer>All rights &copy; us</footer></body></html>")


def test_styletree_removes_templates(spark):
    df = spark.createDataFrame([page(k) for k in range(20)] + [page(99, "solo.example.com")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in styletree.extract_pages(df).collect()}
    assert got[3] == "Title 3\nBody 3 one.\nBody 3 two & bold 3 ."
    assert "Home" in got[99] and "All rights" in got[99]
    joined = {r["page_id"]: r["text"] for r in styletree.extract_pages(df, broadcast_rows=0).collect()}
    assert joined == got


def test_styletree_importances_against_brute_force(spark):
    pages = [page(k) for k in range(7)] + [page(k, "other.example.com") for k in range(3)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    seen = {}
    for _, url, html in pages:
        for key, value in styletree.observations(styletree.parse(html)):
            seen.setdefault((url.split("/")[2], key), []).append(value)
    got = {(r["host"], r["key"]): (r["seen"], r["importance"]) for r in styletree.importances(df).collect()}
    assert got.keys() == seen.keys()
    for k, values in seen.items():
        m = len(values)
        h = -sum(n / m * math.log(n / m) for n in pd.Series(values).value_counts()) / math.log(m) if m > 1 else 1
        assert got[k][0] == m and math.isclose(got[k][1], h, abs_tol=1e-9)


def test_styletree_edges(spark):
    odd = ["", None, "plain", "<p>open <b>bold", "</div></p>stray", "<!-- never closed <p>x", "<script>if (a < b) {</script>after<style>p{}</style>", "<a title='x > y'>q</a>", "<ul><li>1<li>2</ul>", "<table><tr><td>a<td>b<tr><td>c</table>", "x" * 300_000, "<div>" * 3000 + "deep", "&lt;p&gt;", "\ud800".encode("utf-8", "replace").decode()]
    rows = [(i, u, h) for i, (h, u) in enumerate(zip(odd, ["http://a.b/c", None, "", "nonsense", "//HOST:80/x", "https://u@c.d", *["http://a.b"] * 20]))] + [(None, None, None), (0, "http://a.b/c", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("nodes"), F.lit(3).alias("h"))
    got = {r["page_id"]: r["text"] for r in styletree.extract_pages(df).collect()}
    assert got[1] is None and got[0] == "" and got[2] == "plain" and got[3] == "open bold" and got[6] == "after" and got[8] == "1\n2" and got[9] == "a\nb\nc" and got[11] == "deep" and got[12] == "<p>"
    assert styletree.extract_pages(df).count() == len(rows) and styletree.extract_pages(df.where("false")).count() == 0
    hosts = {r[0]: r[1] for r in df.select("page_id", styletree.host_of(F.col("url"))).collect()}
    assert hosts[4] == "host" and hosts[5] == "c.d" and hosts[1] == ""


def test_styletree_by_groups_of_pages_equals_the_broadcast(spark, monkeypatch):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    whole = bag(styletree.extract_pages(pages), "page_id", "text", "nodes", "removed")
    monkeypatch.setattr(styletree, "GROUP_PAGES", 7)
    assert bag(styletree.extract_pages(pages, broadcast_rows=0), "page_id", "text", "nodes", "removed") == whole


def test_styletree_keeps_unique_texts_beside_repeated_ones(spark):
    """A shared notice goes and the paragraphs of its style stay; one page that repeats a line, or copies of one page, take
    nothing from their host."""
    notice = [(k, f"http://n.example.com/{k}", f"<body><p>Own {k} one.<p>Shared notice.<p>Own {k} two.</body>") for k in range(30)]
    repeats = [(100 + k, f"http://r.example.com/{k}", f"<body><p>Own {k}." + "<p>Again." * (100 if k == 0 else 0) + "</body>") for k in range(10)]
    copies = [(200 + k, f"http://c.example.com/{k}", "<body><p>Copied.</body>" if k < 30 else f"<body><p>Own {k}.</body>") for k in range(33)]
    df = spark.createDataFrame(notice + repeats + copies, "page_id bigint, url string, html string")
    for rows in (styletree.BROADCAST_ROWS, 0):
        got = {r["page_id"]: r["text"] for r in styletree.extract_pages(df, broadcast_rows=rows).collect()}
        assert all(got[k] == f"Own {k} one.\nOwn {k} two." for k in range(30))
        assert got[100].split("\n") == ["Own 0."] + ["Again."] * 100 and all(got[100 + k] == f"Own {k}." for k in range(1, 10))
        assert all(got[200 + k] == ("Copied." if k < 30 else f"Own {k}.") for k in range(33))


# --- 7 Resharding


def brute_cost(sizes, caps):
    """Least moved units by trying every assignment of units."""
    best = [math.inf]

    def go(i, left, cost):
        if cost >= best[0]:
            return
        if i == len(sizes):
            best[0] = cost
            return

        def spread(j, units, left, cost):
            if j == len(caps):
                if not units:
                    go(i + 1, left, cost)
                return
            for x in range(min(units, left[j]) + 1):
                now = list(left)
                now[j] -= x
                spread(j + 1, units - x, now, cost + (x if j != i else 0))

        spread(0, sizes[i], left, cost)

    go(0, list(caps), 0)
    return best[0]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=3), st.lists(st.integers(0, 6), min_size=1, max_size=4))
def test_flow_moves_the_fewest_bytes(sizes, caps):
    if sum(caps) < sum(sizes):
        with pytest.raises(ValueError):
            resharding.plan_transfers(sizes, caps)
        return
    for costs in (None, {}):
        plan = resharding.plan_transfers(sizes, caps, costs)
        assert [sum(x for i, _, x in plan if i == k) for k in range(len(sizes))] == sizes
        assert all(sum(x for _, j, x in plan if j == k) <= c for k, c in enumerate(caps))
        assert sum(x for i, j, x in plan if i != j) == brute_cost(sizes, caps)


def test_reshard_keeps_all_rows_and_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = resharding.reshard(docs, n_new=7).withColumn("b", resharding.document_bytes(F.col("text"))).toPandas()
    assert len(got) == docs.count() and set(got["doc_id"]) == {r[0] for r in docs.select("doc_id").collect()}
    names = sorted(got["source"].unique(), key=resharding.natural)
    sizes = [int(got.loc[got["source"] == s, "b"].sum()) for s in names]
    cap = math.ceil(sum(sizes) * 1.05 / 7)
    plan = resharding.plan_transfers(sizes, [cap] * 7)
    biggest = got["b"].max()
    for i, j, x in plan:
        moved = got.loc[(got["old_shard"] == i) & (got["new_shard"] == j), "b"].sum()
        assert abs(moved - x) <= biggest
    for k in range(7):
        stay = got.loc[(got["old_shard"] == k) & (got["new_shard"] == k), "b"].sum()
        assert stay <= cap


def test_reshard_edges(spark, edge, empty, tmp_path):
    got = resharding.reshard(edge, n_new=3)
    assert bag(got, "doc_id", "text") == bag(edge, "doc_id", "text")
    assert got.columns[-3:] == ["old_shard", "new_shard", "moved"] and "NEW_SHARD" not in got.columns
    assert resharding.reshard(empty).count() == 0
    same = resharding.reshard(edge.where("source = 'a'"), n_new=1)
    assert not same.where("moved").count()
    touched = resharding.rewrite_shards(got, f"{tmp_path}/out")
    on_disk = {int(d.split("=")[1]) for d in os.listdir(tmp_path / "out") if d.startswith("new_shard=")}
    present = {r[0] for r in got.select("new_shard").distinct().collect()}
    assert on_disk == set(touched) & present
    assert resharding.reshard(edge.where("text is null or text = ''"), n_new=2).count() == 3


def test_rewrite_keeps_untouched_shards(spark, tmp_path):
    rows = [(0, "a", 0, 0, False), (1, "b", 1, 2, True), (2, "c", 2, 2, False)]
    placed = spark.createDataFrame(rows, "doc_id int, text string, old_shard int, new_shard int, moved boolean")
    placed.withColumn("new_shard", F.col("old_shard")).write.partitionBy("new_shard").parquet(f"{tmp_path}/out")
    assert resharding.rewrite_shards(placed, f"{tmp_path}/out") == [1, 2]
    assert sorted((r["doc_id"], r["new_shard"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 0), (1, 2), (2, 2)]


def test_queries_write_their_shards(spark, sf_dir, tmp_path, monkeypatch):
    from sieveline.llm import registry

    monkeypatch.setattr(registry, "scratch_path", lambda _, what: f"file://{tmp_path}/{what}")
    docs = table(spark, sf_dir, "documents")
    assert bag(registry.op7_resharding(spark, sf_dir), "doc_id", "text", "new_shard") == bag(spark.read.parquet(f"{tmp_path}/reshard"), "doc_id", "text", "new_shard") == bag(resharding.reshard(docs), "doc_id", "text", "new_shard")
    records = registry.op5_training_order(spark, sf_dir).toPandas().sort_values("slot")
    assert [a.tobytes() for a in trainorder.read_slots(f"file://{tmp_path}/shards")] == records["tokens"].tolist()


# --- 8 SimHash


def groups_by_brute_force(texts):
    prints = np.array([np.frombuffer(simhash.simhash(t), ">u8") for t in texts]).astype(np.uint64)
    c = simhash.Components(len(texts))
    for i in range(len(texts)):
        a = np.bitwise_count(prints[i, :2] ^ prints[i + 1 :, :2]).sum(1)
        b = np.bitwise_count(prints[i] ^ prints[i + 1 :]).sum(1)
        j = np.flatnonzero((a <= simhash.BUDGET) & (b <= simhash.WIDE_BUDGET)) + i + 1
        c.add(np.full(len(j), i), j)
    return c.label


def test_near_duplicates_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pdf = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    label, ids = groups_by_brute_force(list(pdf["text"])), pdf["doc_id"].to_numpy()
    expect = sorted((int(ids[i]), int(ids[k])) for i, k in enumerate(label) if i != k)
    assert bag(simhash.near_duplicates(docs), "doc_id", "kept_doc_id") == sorted(expect, key=repr) and expect
    assert simhash.dedup_filter(docs).count() == len(ids) - len(expect)
    # The same with large sub-tries parted by their nodes, and by some of them.
    for split in (1, 12):
        assert bag(simhash.near_duplicates(docs, split_rows=split), "doc_id", "kept_doc_id") == sorted(expect, key=repr)


def test_trie_join_is_exact_near_the_budget():
    """Random pairs at every distance around the budget, and a dense cluster, in the sub-tries as Spark builds them."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 1 << 64, 4, dtype=np.uint64) for _ in range(40)]
    for w in list(words):
        for d in (1, 8, 16, 17, 18, 25):
            x = w.copy()
            for b in rng.choice(128, d, replace=False):
                x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            words.append(x)
    words += [words[0] ^ np.uint64(k) for k in range(300)]
    words = np.unique(np.array(words), axis=0)
    n = len(words)
    expect = simhash.Components(n)
    for i in range(n):
        a = np.bitwise_count(words[i, :2] ^ words[i + 1 :, :2]).sum(1)
        b = np.bitwise_count(words[i] ^ words[i + 1 :]).sum(1)
        j = np.flatnonzero((a <= 17) & (b <= 36)) + i + 1
        expect.add(np.full(len(j), i), j)
    key, rot, first, at = [], [], [], []
    for k, (o, length, r, rest) in enumerate(simhash.subtries()):
        hi, _ = simhash.rotate(words[:, 0], words[:, 1], np.full(n, o))
        key.append((k << 16) | (hi >> np.uint64(64 - length)).astype(np.int64))
        rot.append(np.full(n, r))
        first.append(np.full(n, rest))
        at.append(np.arange(n))
    at = np.concatenate(at)
    got = simhash.trie_self_join(np.concatenate(key), np.concatenate(rot), np.concatenate(first), words[at]).label
    merged = simhash.Components(n)
    merged.add(at, at[got])
    assert (merged.label == expect.label).all()


def test_parted_subtries_find_the_same_pairs(spark):
    """Pairs that need the other half's bit in their block, through Spark, whole and parted."""
    rng = np.random.default_rng(6)
    words = []
    for _ in range(60):
        w = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
        x = w.copy()
        for o, n in simhash.BLOCKS:  # 17 bits: one block differs in one bit, the others in two
            for b in o + rng.choice(n, 1 if o == 0 else 2, replace=False):
                x[b // 64] ^= np.uint64(1) << np.uint64(63 - b % 64)
        words += [w, x]
    prints = spark.createDataFrame([(bytearray(w.astype(">u8").tobytes()),) for w in words], "fp binary")
    for rows, split in ((120, 1000), (120, 1), (120, 2)):
        found = {frozenset((bytes(r["u"]), bytes(r["v"]))) for r in simhash.match_edges(prints, rows, split).collect()}
        assert found == {frozenset((words[k].astype(">u8").tobytes(), words[k + 1].astype(">u8").tobytes())) for k in range(0, 120, 2)}


def dense_prints(n, seed):
    """Fingerprints whose bits lean to one side, as those of one language do, so that few pairs are pruned early."""
    rng = np.random.default_rng(seed)
    bits = rng.random((n, 256)) < np.clip(rng.normal(0.5, 0.35, 256), 0.02, 0.98)
    return np.unique(np.packbits(bits, axis=1).view(">u8").astype(np.uint64), axis=0)


def test_memory_of_the_join_does_not_grow_with_the_pairs(monkeypatch):
    words = dense_prints(6000, 8)
    words = np.r_[words[:5400], words[:600] ^ np.array([1, 0, 0, 0], np.uint64)]
    one, (_, _, r, rest) = np.ones(len(words), np.int64), simhash.subtries()[0]
    tracemalloc.start()
    got = simhash.trie_self_join(one, r * one, rest * one, words).label
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, f"{peak / 1e6:.0f} MB"
    for name, most in (("FRONTIER", 7), ("CHUNK_PAIRS", 100), ("LEAF_PAIRS", 3)):
        monkeypatch.setattr(simhash, name, most)
    small = np.r_[0:300, 5400:5700]
    few = simhash.trie_self_join(one[small], r * one[small], rest * one[small], words[small]).label
    monkeypatch.undo()
    assert (few == simhash.trie_self_join(one[small], r * one[small], rest * one[small], words[small]).label).all()
    assert len(set(got)) == 5400


def test_subtries_of_a_task_are_joined_as_they_come(monkeypatch):
    words = dense_prints(400, 9)
    words = np.unique(np.r_[words, words ^ np.array([1, 0, 0, 0], np.uint64)], axis=0)
    key = np.repeat([5, 6, 7, 40], [300, 1, 150, 349])[: len(words)]
    order = np.random.default_rng(1).permutation(len(words))
    batches = [pa.record_batch([key[a : a + 50], np.full(len(key[a : a + 50]), -1), *words[order][a : a + 50].view(np.int64).T], names=["key", "side", "w0", "w1", "w2", "w3"]) for a in range(0, len(key), 50)]
    asked, links = [], []

    def coming():
        for k, b in enumerate(batches):
            asked.append(k)
            yield b

    whole = [(u.as_py(), v.as_py()) for b in simhash._join_partition(iter(batches)) for u, v in zip(*b.columns)]
    monkeypatch.setattr(simhash, "GATHER", 120)
    for b in simhash._join_partition(coming()):
        links.append((len(asked), [(u.as_py(), v.as_py()) for u, v in zip(*b.columns)]))
    assert links[0][0] < len(batches) and len(links) == 3
    assert components([x for _, some in links for x in some]) == components(whole) and whole


def components(links):
    of = {}
    for u, v in links:
        a, b = of.setdefault(u, {u}), of.setdefault(v, {v})
        if a is not b:
            a |= b
            of.update(dict.fromkeys(b, a))
    return {frozenset(g) for g in of.values()}


def test_dedup_edges(spark, edge, empty):
    pairs = bag(simhash.near_duplicates(edge), "doc_id", "kept_doc_id")
    assert pairs == sorted([(2, 1), (2, 1), (None, 1), (4, 3), (7, 6)], key=repr)
    kept = simhash.dedup_filter(edge)
    assert kept.columns == edge.columns
    assert bag(kept, "doc_id") == sorted([(1,), (3,), (5,), (None,), (6,), (8,), (9,), (9,)], key=repr)
    twice = edge.where("doc_id = 2")
    assert simhash.dedup_filter(twice).count() == 1 and bag(simhash.near_duplicates(twice), "doc_id", "kept_doc_id") == [(2, 2)]
    assert simhash.near_duplicates(empty).count() == simhash.dedup_filter(empty).count() == 0


def test_of_repeated_rows_the_least_stays(spark):
    rows = [(1, "the same text in all of these rows", k) for k in range(6)] + [(2, None, 0), (2, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    kept = [bag(simhash.dedup_filter(d), "doc_id", "extra") for d in (docs.coalesce(1), docs.repartition(4), docs.orderBy(F.desc("extra")).coalesce(1))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3


def test_near_copies_match_and_others_do_not():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(3000)]
    common = words[:60]
    hits = total = 0
    for _ in range(40):
        a = [str(rng.choice(common if rng.random() < 0.4 else words)) for _ in range(300)]
        b = [w if rng.random() > 0.05 else str(rng.choice(words)) for w in a]
        c = [str(rng.choice(common if rng.random() < 0.4 else words)) for _ in range(300)]
        label = groups_by_brute_force([" ".join(x) for x in (a, b, c)])
        hits, total = hits + (label[1] == 0), total + 1
        assert label[2] == 2
    assert hits / total >= 0.9


# --- 9 Pseudonyms


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000, 73049])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel("k", n, "t")
    x = [f(i) for i in range(n)]
    assert sorted(x) == list(range(n)) and all(f.inverse(v) == i for i, v in enumerate(x[:500]))


def test_pseudonyms_stay_valid_and_linked():
    p = pii.Pseudonymiser("key")
    t = "card 4041894974608795 or 4041-8949-7460-8795, call +1 (456) 555-2186, from 118.78.65.158 on 2024-02-29, id 123-45-6789, mail jo.do_7@mail8.example.com DE89 3704 0044 0532 0130 00 token = \"269b18c07fa0e5d1\""
    out, n, kinds = p.text(t)
    assert n == 9 and kinds == ["card", "date", "email", "iban", "ip", "phone", "secret", "ssn"]
    assert [re.sub(r"[0-9]", "9", re.sub(r"[0-9a-f]{16}", "H", re.sub(r"\d+\.\d+\.\d+\.\d+|\S+@", "X", x))) for x in (t, out)].count(re.sub(r"[0-9]", "9", re.sub(r"[0-9a-f]{16}", "H", re.sub(r"\d+\.\d+\.\d+\.\d+|\S+@", "X", t)))) == 2
    a, b = re.findall(r"\d{16}", out)[0], re.search(r"(?:\d{4}-){3}\d{4}", out).group().replace("-", "")
    assert a == b and pii.luhn_digit(a[:-1]) == a[-1] and a != "4041894974608795"
    datetime.date.fromisoformat(re.search(r"\d{4}-\d{2}-\d{2}", out).group())
    assert pii._mod97(re.search(r"DE[\d ]+\d", out).group().replace(" ", "")) == 1
    assert p.text(t)[0] == out and pii.Pseudonymiser("other").text(t)[0] != out


def test_invalid_values_stay():
    p = pii.Pseudonymiser()
    for t in ("4041894974608796", "2023-02-29", "31/04/2020", "256.1.1.1", "000-12-3456", "666-12-3456", "1.2.3.4.5", "CC BY-NC 4.0", "0000000000000000", "1111111111111111", "DE88 3704 0044 0532 0130 00", "deadbeefdeadbeef", "", "a" * 100_000):
        assert p.text(t)[0] == t


def test_dates_month_first_and_of_one_digit():
    p = pii.Pseudonymiser("key")
    day = lambda v, order: datetime.date(*(int(v.split("/")[k]) for k in order))
    got = {v: p._date(v) for v in ("25/12/1980", "12/25/1980", "3/4/1980", "03/04/1980", "31/31/1980")}
    assert got["31/31/1980"] is None
    assert day(got["25/12/1980"], (2, 1, 0)) == day(got["12/25/1980"], (2, 0, 1)) != datetime.date(1980, 12, 25)
    assert day(got["3/4/1980"], (2, 1, 0)) == day(got["03/04/1980"], (2, 1, 0)) != datetime.date(1980, 4, 3)
    assert all(pii.PATTERN.search(f"born {v}.").group("date") == v for v in got)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 10**15 - 1), min_size=2, max_size=20, unique=True))
def test_cards_have_distinct_pseudonyms(bodies):
    p = pii.Pseudonymiser()
    cards = [f"{b:015d}" + pii.luhn_digit(f"{b:015d}") for b in bodies if len(set(f"{b:015d}")) > 1]
    made = [p._card(c) for c in cards if p._card(c)]
    assert len(set(made)) == len(made) and all(pii.luhn_digit(m[:-1]) == m[-1] for m in made)


def test_no_value_stays_as_it_is():
    """All dates, all mail names of one and two characters, in permutations: distinct pseudonyms, never the value."""
    p = pii.Pseudonymiser("k")
    days = [datetime.date.fromordinal(pii.DAY0 + k).isoformat() for k in range(0, pii.DAYS)]
    new = [p.replace("date", d) for d in days]
    assert all(a != b for a, b in zip(days, new)) and len(set(new)) == len(days)
    names = [*pii.ALPHANUMERIC, *[a + b for a in pii.ALPHANUMERIC for b in pii.ALPHANUMERIC]]
    mails = [p.replace("email", f"{n}@x.com") for n in names]
    assert all(m and m != f"{n}@x.com" for m, n in zip(mails, names)) and len(set(mails)) == len(names)
    spanish = p.replace("email", "ñandú@x.com")
    assert spanish != "ñandú@x.com" and not set("ñú") & {a for a, b in zip(spanish, "ñandú@x.com") if a == b}


def test_only_changed_values_count():
    assert pii.Pseudonymiser("k").text("mail __@x.com and 2@x.com on 1957-05-14")[1:] == (2, ["date", "email"])


def test_pii_edges(spark, edge, empty):
    got = pii.pseudonymise(edge)
    assert bag(got, "doc_id", "text") == bag(edge, "doc_id", "text") and {r[0] for r in got.select("n_pii").distinct().collect()} == {0}
    assert pii.pseudonymise(empty).count() == 0
    one = spark.createDataFrame([(1, "ip 9.8.7.6"), (2, "x 9.8.7.6"), (2, "x 9.8.7.6")], "doc_id bigint, text string")
    texts = [r["text"].split()[1] for r in pii.pseudonymise(one).collect()]
    assert len(set(texts)) == 1 and texts[0] != "9.8.7.6"


# --- 10 Toxicity


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)

    def vector():
        t = rng.choice(12, int(rng.integers(0, 6)), replace=False)
        x = rng.random(len(t)) + 0.1
        x /= np.linalg.norm(x) if len(x) else 1
        return {int(k): float(v) for k, v in zip(t, x)}

    vectors = [vector() for _ in range(int(rng.integers(0, 60)))]
    vectors += vectors[:5]
    index = toxicity.BlockMaxIndex(vectors, 12, block=4)
    query, k = vector(), int(rng.integers(1, 8))
    ids, sims = index.search(query, k)
    every = sorted(((round(sum(query[t] * v[t] for t in query.keys() & v.keys()), 6), -i) for i, v in enumerate(vectors)), reverse=True)
    every = [(s, -i) for s, i in every if s > 0]
    expect = [(i, s) for s, i in every if len(every) < k or s >= every[k - 1][0]]
    assert list(ids) == [i for i, _ in expect] and np.allclose(sims, [s for _, s in expect])


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), st.integers(1, 3)), min_size=1, max_size=30))
def test_isotonic_rises_and_keeps_the_mean(rows):
    x, y, w = (np.array(c, float) for c in zip(*rows))
    edges, prob = toxicity.isotonic(x, y, w)
    assert (np.diff(edges) > 0).all() and (np.diff(prob) >= -1e-12).all()
    fitted = prob[np.searchsorted(edges, x)]
    assert math.isclose((fitted * w).sum(), (y * w).sum(), abs_tol=1e-6)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    test = toxicity.toxicity(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    toxic, flagged = test["toxic"] == 1, test["score"] >= toxicity.THRESHOLD
    # Only some 230 toxic examples here, and one label in ten on texts without a toxic word.
    assert flagged[toxic].mean() > 0.85 and flagged[~toxic].mean() < 0.01
    assert (test.loc[flagged, "evidence"].str.len() > 0).all()


def test_toxicity_edges(spark, edge, empty):
    labels = labels_of(spark, [(1, 1, 1), (8, 1, 0), (None, 1, 1), (3, None, None)])
    for ls in (labels, labels_of(spark), labels_of(spark, [(1, 1, 1)])):
        got = toxicity.toxicity(edge, toxicity.train(edge, ls))
        assert got.count() == edge.count() and got.columns == ["doc_id", "score", "vote", "evidence"]
        assert not got.where("score is null or score < 0 or score > 1").count()
    assert toxicity.toxicity(empty, toxicity.train(empty, labels)).count() == 0


def test_toxicity_scores_against_brute_force(spark):
    """train() and toxicity() repeated with plain dicts over all terms, ids being strings."""
    rows = [(f"d{i}", f"{'vile grim' if i % 3 == 0 else 'calm kind'} talk{i % 7} of harbour{i % 5} cranes number{i}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [("x", "vile talk3 of nothing"), ("y", "calm harbour2"), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id string, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.ids) <= {i for i, _, _ in rows} and len(model.ids) > 10
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    of = {i: set(toxicity.words(texts[i] or "")) for i in texts}
    y = {i: k for i, _, k in rows}
    known = sorted(set().union(*[of[i] for i in model.ids]))
    pos, neg = (sum(y[i] == c for i in model.ids) for c in (1, 0))
    df = {w: sum(w in s for s in of.values()) for w in known}
    ev = toxicity.evidence(np.array([sum(w in of[i] for i in model.ids if y[i]) for w in known], float), np.array([sum(w in of[i] for i in model.ids if not y[i]) for w in known], float), pos, neg)
    weight = {w: math.log(1 + len(texts) / df[w]) * e for w, e in zip(known, ev)}

    def vector(i):
        v = {w: weight[w] for w in of[i] if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    for r in toxicity.toxicity(docs, model).collect():
        v = vector(r["doc_id"])
        sims = sorted(((round(sum(x * u.get(w, 0) for w, x in v.items()), 6), i) for i in model.ids for u in [vector(i)]), reverse=True)
        near = [(s, i) for s, i in sims if s > 0 and s >= (sims[toxicity.NEIGHBOURS - 1][0] if len(sims) > toxicity.NEIGHBOURS else 0) - 2e-6]
        w = [1 / (1 - s + 0.05) for s, _ in near]
        vote = sum(a * y[i] for a, (_, i) in zip(w, near)) / (sum(w) + toxicity.PRIOR) if near else 0
        assert math.isclose(r["vote"], vote, abs_tol=1e-3), r
        assert [e["similarity"] for e in r["evidence"]] == pytest.approx([s for s, _ in near[: toxicity.EVIDENCE]], abs=2e-6)


def test_toxicity_counts_rare_words(spark):
    """Examples without any word of statistical weight vote too: a document that is word for word one of them finds it."""
    clean = [(i, f"ordinary report {i} on harbour traffic, tides and weather number{i}", 0) for i in range(60)]
    toxic = [(100 + i, f"grumfle{i} zanty{i} brool{i} quaxid{i} snorvel{i}", 1) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in clean + toxic] + [(999, toxic[7][1]), (1000, "nothing known")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + toxic], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["evidence"] for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert [(e["doc_id"], e["toxic"], round(e["similarity"], 4)) for e in got[999]] == [(107, 1, 1.0)]
    assert all(got[i] for i, _, _ in clean + toxic) and not got[1000]


# --- Pipeline and queries


def test_pipeline_against_its_stages_by_brute_force(spark, sf_dir):
    """run() on sf0.001: each stage's decision is repeated apart, on plain Python data."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir)
    docs, labels, bench = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    rows = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    model = quality.train(docs, labels)
    rows = rows[model.scores(list(rows["text"])) >= quality.THRESHOLD].reset_index(drop=True)
    rows = rows[groups_by_brute_force(list(rows["text"])) == np.arange(len(rows))].reset_index(drop=True)
    items = [decontam.normalise(t) for t in bench.toPandas()["text"]]
    items = [t for t in items if len(t) >= decontam.MIN_ITEM_CHARS]
    leak = rows["text"].map(lambda t: any(i in decontam.normalise(t) or edits_within(i, decontam.normalise(t)) for i in items))
    rows = rows[~leak].reset_index(drop=True)
    c = duckdb.connect()
    c.register("documents", rows)
    kept = set(c.sql(mixing.ORACLE).df()["doc_id"])
    assert {r[0] for r in got.select("doc_id").collect()} == kept
    assert got.columns == [*docs.columns, "old_shard", "new_shard", "moved"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["classify", "dedup", "decontaminate", "mix", "reshard"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_pipeline_stages_on_edges(spark, edge, empty, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows and clashing columns, on its predecessor's rows, and on
    an empty table."""
    import corpus_pipeline

    item = "the quick brown fox jumps over the lazy dog while seven wise"
    labels_of(spark, [(1, 1, 0), (2, 1, 0), (8, 1, 0), (7, 0, 0), (None, 1, None)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {n: f(spark, edge, str(tmp_path)) for n, f in corpus_pipeline.STAGES}
    assert not rows["classify"].where("text is null or trim(text) = ''").count()
    assert bag(rows["dedup"], "doc_id", "source") == sorted([(1, "a"), (3, "b"), (5, None), (None, None), (6, "b"), (8, "c"), (9, "c"), (9, "c")], key=repr)
    assert rows["decontaminate"].count() == edge.count() - 4
    assert rows["mix"].count() and bag(rows["reshard"], "doc_id", "text") == bag(edge, "doc_id", "text")
    now = edge
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.schema(now.schema).parquet(f"{tmp_path}/{name}")
        assert name == "reshard" or now.columns == edge.columns, name


def edits_within(item, text):
    """Whether the item occurs within its budget, by distance over all of the text."""
    k = int(decontam.ERROR_RATE * len(item))
    return decontam.myers(item, text, k) is not None


@pytest.mark.parametrize("name", ["op3_mixing", "op4_avi_clips", "op7_resharding"])
def test_queries_match_their_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    expect = c.sql(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns[:2])
    a, b = (d.sort_values(key).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None) for d in (got, expect))
    assert len(a) and a.equals(b.astype(a.dtypes.to_dict()))


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names

"""Queries by operator, over whole tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import text as X
from ..functions.classify import chunk_text, extract_text, stratum
from ..operators import dedup, evalstats, funnel, generation, metrics, quality, report, sampling, stages
from ..sources import files, schema
from ..sources.files import table
from ..streaming import incremental
from . import fixtures as FX

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FUNNEL = C.FunnelConfig(evasive=C.EVASIVE_FIXTURE, classifier=C.FIXTURE)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql.strip()
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_score(c: C.Stratum, text: str, source: str | None = None) -> str:
    parts = [f"contains({text}, {q(k.lower())})::INT" for k in c.keywords]
    parts += [f"2 * contains({source}, {q(k)})::INT" for k in c.sources] if source else []
    return " + ".join(parts) or "0"


def sql_stratum(c: C.Classifier, text: str, source: str | None = None, boost: bool = False) -> str:
    names = [f"s{k}" for k in range(len(c.strata))]
    best = f"greatest({', '.join(names)})"
    case = f"CASE WHEN {best} < 1 THEN {q(c.fallback)} " + " ".join(f"WHEN {n} = {best} THEN {q(s.name)}" for n, s in zip(names, c.strata)) + " END"
    case = f"CASE WHEN society = {q(c.society)} OR category = {q(c.category)} THEN {q(c.boosted)} ELSE {case} END" if boost else case
    return ", ".join(f"{sql_score(s, text, source)} AS {n}" for n, s in zip(names, c.strata)), case


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
QUALITY = (f"length({STRIP.format('text')}) >= 80 AND " + " AND ".join(f"NOT contains(lower(text), {q(x)})" for x in C.BOILERPLATE)
           + r" AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) >= 0.4")
_cols, _case = sql_stratum(C.FIXTURE, "t", "lower(source)", True)
#: qc: chunks of quality with their stratum by the sampler's classifier.
STRATA = f"{FX.CHUNKS}, qs AS (SELECT *, lower(source) || ' ' || lower(section_path) || ' ' || substr(lower(text), 1, 500) AS t FROM ch WHERE {QUALITY}), qk AS (SELECT *, {_cols} FROM qs), qc AS (SELECT id, text, source, society, category, {_case} AS stratum FROM qk)"


def quality_chunks(spark, sf_dir):
    return FX.chunks(spark, sf_dir).where(X.is_quality_chunk(F.col("text"), FUNNEL.min_chunk, FUNNEL.min_alpha, C.BOILERPLATE))


def classified(spark, sf_dir):
    c = quality_chunks(spark, sf_dir)
    return c.withColumn("stratum", stratum(C.FIXTURE, chunk_text(F.col("source"), F.col("section_path"), F.col("text")), F.lower("source"), F.col("society"), F.col("category")))


def strata(spark, sf_dir):
    """(id, source, stratum) of classified(), written: the samplers read it more than once."""
    return files.cut(classified(spark, sf_dir).select("id", "source", "stratum"))


# --- Chunks


@query(f"WITH {STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY md5(substr(text, 1, 150)) ORDER BY id) AS rn FROM qc) SELECT stratum, source, count(*) AS n FROM r WHERE rn = 1 GROUP BY ALL")
def slice_quality_strata_counts(spark, sf_dir):
    return dedup.prefix_dedup(classified(spark, sf_dir), 150, [F.col("id")]).groupBy("stratum", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FX.CHUNKS} SELECT id, length(text) AS n FROM ch WHERE {QUALITY}")
def f1_f3_quality_chunks(spark, sf_dir):
    return quality_chunks(spark, sf_dir).select("id", F.length("text").alias("n"))


@query(f"WITH {STRATA} SELECT id, stratum FROM qc")
def p1_classify_boost(spark, sf_dir):
    return classified(spark, sf_dir).select("id", "stratum")


_c2, _k2 = sql_stratum(C.FIXTURE, "t", None, True)


@query(f"WITH {FX.CHUNKS}, a AS (SELECT *, lower(source || ' ' || section_path || ' ' || substr(text, 1, 500)) AS t FROM ch WHERE {QUALITY}), k AS (SELECT *, {_c2} FROM a) SELECT id, {_k2} AS stratum FROM k")
def p2_classify_extractor(spark, sf_dir):
    t = extract_text(F.col("source"), F.col("section_path"), F.col("text"))
    return quality_chunks(spark, sf_dir).select("id", stratum(C.FIXTURE, t, None, F.col("society"), F.col("category")).alias("stratum"))


_c3, _k3 = sql_stratum(C.EXAMPLES, "t")


@query(f"WITH {FX.EXAMPLES}, a AS (SELECT id, lower(question || ' ' || answer) AS t FROM ex WHERE answer IS NOT NULL), k AS (SELECT *, {_c3} FROM a) SELECT id, {_k3} AS stratum FROM k")
def p3_classify_keywords(spark, sf_dir):
    e = FX.examples(spark, sf_dir).where("answer is not null")
    return e.select("id", stratum(C.EXAMPLES, F.lower(F.concat_ws(" ", "question", "answer"))).alias("stratum"))


@query("SELECT coalesce(source, 'unknown') AS source, coalesce(lang, '') AS category, count(*) AS n FROM documents GROUP BY ALL")
def p4_metadata_defaults(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select(F.map_filter(F.create_map(F.lit("source"), "source", F.lit("category"), "lang"), lambda k, v: v.isNotNull()).alias("m"))
    get = lambda k, d: F.coalesce(F.element_at("m", F.lit(k)), F.lit(d))
    return m.groupBy(get("source", "unknown").alias("source"), get("category", "").alias("category")).agg(F.count(F.lit(1)).alias("n"))


_fix_hints = {"alpha": "Uno.", "beta": "Dos, tres.", "gamma": "Cuatro."}


@query(f"""WITH {STRATA} SELECT id, 'FUENTE: ' || CASE WHEN society <> '' THEN '[' || society || '] ' ELSE '' END || coalesce(source, 'Guía clínica') || chr(10) || 'TIPO DE CONTENIDO: ' || stratum || chr(10) || chr(10)
|| 'FRAGMENTO:' || chr(10) || text || chr(10) || chr(10) || 'Genera 3 pares pregunta-respuesta clínicos ' || 'basados en este fragmento. '
|| CASE stratum {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _fix_hints.items())} ELSE '' END || chr(10) || 'Responde SOLO con el JSON array, ' || 'sin texto adicional.' AS prompt FROM qc""")
def p5_prompt(spark, sf_dir):
    return classified(spark, sf_dir).select("id", generation.prompt(_fix_hints).alias("prompt"))


@query("SELECT doc_id, md5(substr(text, 1, 100)) AS short_key, md5(substr(text, 1, 150)) AS long_key FROM documents")
def p13_prefix_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.prefix_key(F.col("text"), 100).alias("short_key"), X.prefix_key(F.col("text"), 150).alias("long_key"))


@query("SELECT doc_id, k AS piece_no, substr(text, CAST(k * 400 + 1 AS BIGINT), 500) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, (greatest(length(text), 1) - 1) // 400)) AS k FROM documents WHERE text IS NOT NULL)")
def p30_overlap_chunks(spark, sf_dir):
    d = files.spread(table(spark, sf_dir, "documents")).where("text is not null")
    return d.select("doc_id", F.posexplode(X.overlap_chunks(F.col("text"))).alias("piece_no", "piece")).withColumn("piece_no", F.col("piece_no").cast("bigint"))


SYNONYMS = [("thor", "that"), ("erre", "rere"), ("keit", "heit")]


@query(f"WITH s AS (SELECT * FROM {FX.values(SYNONYMS, 'brand string, generic string')}), w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM benchmark), p AS (SELECT brand AS a, generic AS b FROM s UNION SELECT generic, brand FROM s) SELECT item_id, word, b AS synonym, count(*) AS n FROM w JOIN p ON word = a GROUP BY ALL")
def p31_synonym_expansion(spark, sf_dir):
    s = spark.createDataFrame(SYNONYMS, "brand string, generic string")
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.letter_runs(F.col("text"))).alias("word"))
    return w.join(F.broadcast(X.synonyms(s)), F.col("word") == F.col("a")).groupBy("item_id", "word", F.col("b").alias("synonym")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT md5(source || ':' || text) AS example_id, count(*) AS n FROM documents GROUP BY ALL")
def p32_stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.content_id(F.col("source"), F.col("text")).alias("example_id")).agg(F.count(F.lit(1)).alias("n"))


# --- Examples and the funnel

_evasive = q("(?i)(?:" + C.EVASIVE_FIXTURE + ")")
REJECTED = f"{FX.EXAMPLES}, rj AS (SELECT *, CASE WHEN answer IS NULL OR answer = '' OR question = '' OR question IS NULL THEN 1 WHEN length(answer) < 300 THEN 2 WHEN regexp_matches(answer, {_evasive}) THEN 3 WHEN length(question) < 30 THEN 4 END AS rejected_at FROM ex)"


@query(f"WITH {FX.EXAMPLES} SELECT id FROM ex WHERE answer <> '' AND question <> ''")
def f4_stage1_valid(spark, sf_dir):
    return stages.canonical(FX.examples(spark, sf_dir)).where("not fail_format").select("id")


@query(f"WITH {FX.EXAMPLES} SELECT id, length(answer) AS n FROM ex WHERE length(answer) >= 300 AND question <> ''")
def f5_min_response(spark, sf_dir):
    e = stages.canonical(FX.examples(spark, sf_dir)).where("not fail_format")
    return e.where(F.length("assistant") >= FUNNEL.min_response).select("id", F.length("assistant").alias("n"))


@query(f"WITH {FX.EXAMPLES} SELECT id, regexp_matches(answer, {q('(?i)(?:' + C.EVASIVE + ')')}) AS evasive, regexp_matches(answer, {_evasive}) AS fixture_evasive FROM ex WHERE answer IS NOT NULL")
def f6_evasive(spark, sf_dir):
    e = FX.examples(spark, sf_dir).where("answer is not null")
    return e.select("id", X.is_evasive(F.col("answer"), C.EVASIVE).alias("evasive"), X.is_evasive(F.col("answer"), C.EVASIVE_FIXTURE).alias("fixture_evasive"))


@query(f"WITH {FX.EXAMPLES} SELECT id, length(question) AS n FROM ex WHERE length(question) >= 30")
def f7_min_question(spark, sf_dir):
    return FX.examples(spark, sf_dir).where(F.length("question") >= FUNNEL.min_question).select("id", F.length("question").alias("n"))


@query(f"WITH {FX.EXAMPLES} SELECT id FROM ex WHERE question <> '' AND answer <> '' AND length(answer) > 30")
def f8_pair_acceptance(spark, sf_dir):
    return FX.examples(spark, sf_dir).where(generation.acceptable(F.col("question"), F.col("answer"))).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality < 1 AND doc_id IS NOT NULL)")
def f10_score_threshold(spark, sf_dir):
    return quality.score_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 1, "doc_id", "quality").select("doc_id")


@query(f"WITH {FX.SCORES_SQL} SELECT tier, round(avg(composite), 4) AS mean FROM sc GROUP BY tier HAVING avg(composite) >= 2.5")
def f11_quality_gate(spark, sf_dir):
    return scores(spark).groupBy("tier").agg(F.avg("composite").alias("m")).where("m >= 2.5").select("tier", F.round("m", 4).alias("mean"))


@query(f"""WITH {REJECTED}, s(stage_no, stage) AS (VALUES (1, 'format'), (2, 'response_length'), (3, 'evasive'), (4, 'question_length')),
g AS (SELECT stage_no, stage, source, count(CASE WHEN coalesce(rejected_at, 5) >= stage_no THEN 1 END) AS before, count(CASE WHEN rejected_at = stage_no THEN 1 END) AS rejected FROM rj, s GROUP BY ALL)
SELECT stage_no, stage, source, before, rejected, before - rejected AS remaining, coalesce(round(rejected / nullif(before, 0), 4), 0) AS rate, FALSE AS skipped FROM g""")
def a2_funnel_report(spark, sf_dir):
    return stages.funnel_report(stages.with_rejection(FX.examples(spark, sf_dir), FUNNEL), FUNNEL)


_SKIP = C.FunnelConfig(evasive=C.EVASIVE_FIXTURE, classifier=C.FIXTURE, skip=frozenset({"evasive"}))


@query(f"WITH {FX.EXAMPLES} SELECT id FROM ex WHERE length(answer) >= 300 AND length(question) >= 30")
def f12_stage_skipped(spark, sf_dir):
    return stages.run_funnel(FX.examples(spark, sf_dir), _SKIP)[-1].kept.select("id")


_c4, _k4 = sql_stratum(C.FIXTURE, "t")
PASSED = f"{REJECTED}, pk AS (SELECT *, {_c4} FROM (SELECT *, lower(question || ' ' || answer) AS t FROM rj WHERE rejected_at IS NULL)), ps AS (SELECT id, source, question, answer, {_k4} AS stratum FROM pk)"


@query(f"WITH {PASSED} SELECT id, source, stratum FROM ps")
def funnel_passing(spark, sf_dir):
    return passed(spark, sf_dir).select("id", "source", "stratum")


def passed(spark, sf_dir):
    return stages.passing(FX.examples(spark, sf_dir), FUNNEL)


#: Vectors and scores for examples: one of the first 500 embeddings each, and a score for one in seven.
_vec = "(id // 1000 * 5 + id % 1000) % 500"
_WHOLE = C.FunnelConfig(evasive=C.EVASIVE_FIXTURE, classifier=C.FIXTURE, similarity=0.45, skip=frozenset({"extrapolation"}))
WHOLE = f"""{PASSED}, fv AS (SELECT ps.id, ps.source, stratum, length(answer) AS length, embedding FROM ps JOIN embeddings ON vec_id = {_vec}),
fp AS (SELECT row_number() OVER (ORDER BY a.id, b.id) AS n, a.id AS i, b.id AS j, a.length AS li, b.length AS lj FROM fv a JOIN fv b ON a.id < b.id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) > 0.45),
fg(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN list_contains(gone, p.i) OR list_contains(gone, p.j) THEN gone ELSE list_append(gone, CASE WHEN p.li >= p.lj THEN p.j ELSE p.i END) END FROM fg JOIN fp p ON p.n = fg.k + 1),
g5 AS (SELECT unnest(gone) AS id FROM fg WHERE k = (SELECT max(k) FROM fg)),
fr AS (SELECT rj.id, rj.source, CASE WHEN rejected_at IS NOT NULL THEN rejected_at WHEN rj.id IN (SELECT id FROM g5) THEN 5 WHEN rj.id % 7 = 0 AND rj.id % 6 < 3 THEN 7 END AS gone_at FROM rj)"""


def whole(spark, sf_dir):
    e = FX.examples(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").where("vec_id < 500")
    vectors = e.select("id", ((F.floor(F.col("id") / 1000) * 5 + F.col("id") % 1000) % 500).alias("vec_id")).join(v, "vec_id").select("id", "embedding")
    scores = e.where("id % 7 = 0").select("id", (F.col("id") % 6).cast("int").alias("score"))
    return funnel.run(e, _WHOLE, vectors, scores, ("major", "minor"))


@query(f"""WITH RECURSIVE {WHOLE}, s(stage_no, stage) AS (VALUES (1, 'format'), (2, 'response_length'), (3, 'evasive'), (4, 'question_length'), (5, 'semantic_dedup'), (6, 'cross_source_dedup'), (7, 'llm_score'), (8, 'extrapolation')),
g AS (SELECT stage_no, stage, source, count(CASE WHEN coalesce(gone_at, 9) >= stage_no THEN 1 END) AS before, count(CASE WHEN gone_at = stage_no THEN 1 END) AS rejected FROM fr, s GROUP BY ALL)
SELECT stage_no, stage, source, before, rejected, before - rejected AS remaining, coalesce(round(rejected / nullif(before, 0), 4), 0) AS rate, stage_no = 8 AS skipped FROM g""")
def funnel_eight_stages(spark, sf_dir):
    """The report of the whole funnel; no cross-source pair is left where stage 5 ran. Stage 8 is skipped: SQL can't
    grow its trees."""
    return whole(spark, sf_dir).report


_fcaps = "n0 AS (SELECT stratum, count(*) AS n FROM fk GROUP BY 1)" + "".join(f", n{k} AS (SELECT stratum, least(n, CAST(floor(sum(n) OVER () * 0.4::DOUBLE) AS BIGINT)) AS n FROM n{k - 1})" for k in range(1, 11))


@query(f"""WITH RECURSIVE {WHOLE}, fk AS (SELECT fr.id, fr.source, stratum FROM fr JOIN ps USING (id) WHERE gone_at IS NULL), {_fcaps},
b AS (SELECT id, source, r.stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || id), id) AS rn FROM fk) r JOIN n10 USING (stratum) WHERE rn <= n),
r AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY source, stratum) AS n FROM b), s AS (SELECT *, greatest(1, floor(n * 0.9::DOUBLE)) AS nt, floor(n * 0.05::DOUBLE) AS nv FROM r)
SELECT id, source, stratum, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + CASE WHEN nt + nv >= n THEN greatest(0, n - nt - 1) ELSE nv END THEN 'valid' ELSE 'test' END AS split FROM s""")
def funnel_kept_splits(spark, sf_dir):
    """What the whole funnel and the balance leave, with its split."""
    return whole(spark, sf_dir).kept.select("id", "source", "stratum", "split")


@query(f"WITH {REJECTED}, s(stage_no) AS (SELECT * FROM range(1, 5)) SELECT stage_no, source, count(CASE WHEN rejected_at = stage_no THEN 1 END) AS rejected FROM rj, s WHERE answer IS NOT NULL GROUP BY ALL")
def s9_s10_funnel_files(spark, sf_dir):
    """The whole run over files, dry and wet: JSON lines in, report and splits out."""
    path, e = _stored(spark, "s10"), FX.examples(spark, sf_dir).where("answer is not null")
    for s in ("major", "minor"):
        files.write_jsonl(e.where(F.col("source") == s), f"{path}/in/{s}.jsonl")
    c = C.FunnelConfig(evasive=C.EVASIVE_FIXTURE, classifier=C.FIXTURE, input_dir=f"{path}/in", output_dir=f"{path}/out", inputs=(("major.jsonl", "major"), ("minor.jsonl", "minor"), ("missing.jsonl", "minor")))
    funnel.run_files(spark, replace(c, dry_run=True))
    if files.exists(spark, f"{path}/out"):
        raise AssertionError("a dry run wrote results")
    done = funnel.run_files(spark, c)
    back = [spark.read.schema(done.report.schema).json(f"{path}/{d}/cleanup_report") for d in ("in", "out")]
    return back[0].intersect(back[1]).where("stage_no <= 4").select("stage_no", "source", "rejected")




@query(f"SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN src ELSE CASE doc_id % 4 WHEN 2 THEN '[]' ELSE 'sorry' END END AS said FROM (SELECT doc_id, '[{{\"q\": \"' || source || '\"}}]' AS src FROM documents)")
def p7_strip_reasoning(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('[{"q": "'), "source", F.lit('"}]')).alias("b"))
    return d.select("doc_id", X.strip_reasoning(_wrapped(F.col("b"))).alias("said"))


def _wrapped(body):
    k = F.col("doc_id") % 4
    return F.when(k == 0, F.concat(F.lit("<think>hm</think>\n```json\n"), body, F.lit("\n```"))).when(k == 1, body).when(k == 2, F.lit("[]")).otherwise(F.lit("sorry"))


@query("""SELECT doc_id, pair_no, CASE pair_no WHEN 0 THEN 'decision' ELSE 'conocimiento' END AS type, source AS question, CASE pair_no WHEN 0 THEN lang ELSE lang || '!' END AS answer
FROM documents, (VALUES (0), (1)) p(pair_no) WHERE doc_id % 4 < 2""")
def p8_p9_p12_parse_explode(spark, sf_dir):
    pair = lambda **kw: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in kw.items()])
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.array(pair(type="decision", question="", answer=F.col("lang"), pregunta=F.col("source"), respuesta=none), pair(type=none, question=F.col("source"), answer=none, pregunta=none, respuesta=F.concat("lang", F.lit("!")))))
    return generation.parse_pairs(d.select("doc_id", _wrapped(body).alias("response")), "response").select("doc_id", "pair_no", "type", "question", "answer")


@query(f"WITH {FX.EXAMPLES} SELECT id, CASE WHEN contains(lower(answer), lower(source)) THEN answer ELSE regexp_replace(answer, '\\s+$', '') || chr(10) || chr(10) || '[Fuente: ' || source || ', SOC]' END AS answer FROM ex WHERE answer IS NOT NULL")
def p10_citation_suffix(spark, sf_dir):
    e = FX.examples(spark, sf_dir).where("answer is not null")
    return e.select("id", generation.cite(F.col("answer"), F.col("source"), F.lit("SOC")).alias("answer"))


@query(f"WITH {FX.EXAMPLES}, m AS (SELECT id, unnest([{{'n': 0, 'role': 'system', 'content': {q(FX.SYSTEM)}}}, {{'n': 1, 'role': 'user', 'content': question}}, {{'n': 2, 'role': 'assistant', 'content': answer}}]) AS m FROM ex WHERE answer IS NOT NULL) SELECT id, m.n AS n, m.role AS role, m.content AS content FROM m")
def p11_chat_format(spark, sf_dir):
    e = FX.examples(spark, sf_dir).where("answer is not null")
    return e.select("id", F.posexplode(generation.chat(FX.SYSTEM, F.col("question"), F.col("answer"))).alias("n", "m")).select("id", "n", "m.role", "m.content")


_W = r"list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '')"
FEATURES = rf"""length(answer) AS answer_len, length(question) AS question_len, round(coalesce(length(answer) / nullif(length(question), 0), 0), 6) AS ratio_aq,
round(coalesce(len(list_distinct({_W})) / nullif(len({_W}), 0), 0), 6) AS ttr, len({_W}) AS word_count, len(regexp_extract_all(answer, '[.!?]+')) AS sentence_count,
regexp_matches(answer, {q(X.LIST.replace("(?mdU)", "(?m)"))})::INT AS has_list, regexp_matches(answer, {q(X.HEADERS.replace("(?mdU)", "(?m)"))})::INT AS has_headers, regexp_matches(answer, '(?i)\d+\s*mg')::INT AS has_dosing,
regexp_matches(answer, {q(X.EVIDENCE.replace("(?iuU)", "(?i)"))})::INT AS has_evidence, regexp_matches(answer, {q(X.CITATION.replace("(?iuU)", "(?i)"))})::INT AS has_citation"""


@query(f"WITH {FX.EXAMPLES} SELECT id, {FEATURES} FROM ex WHERE answer IS NOT NULL")
def p15_p22_text_features(spark, sf_dir):
    f = X.features(F.col("question"), F.col("answer"))
    f |= {k: F.round(f[k], 6) for k in ("ratio_aq", "ttr")}
    return FX.examples(spark, sf_dir).where("answer is not null").select("id", *[v.alias(k) for k, v in f.items()])


@query(f"WITH {PASSED} SELECT id, {FEATURES}, (source = 'major')::INT AS is_main_source, {', '.join(f'(stratum = {q(s.name)})::INT AS stratum_{s.name}' for s in C.FIXTURE.strata)} FROM ps")
def p23_x4_feature_row(spark, sf_dir):
    df, names = quality.with_features(passed(spark, sf_dir), "user", "assistant", C.FIXTURE, "major")
    return df.select("id", *[F.round(n, 6).alias(n) if n in ("ratio_aq", "ttr") else F.col(n) for n in names])


@query("SELECT count(*) AS chunks, count(*) * 800 AS input_tokens, count(*) * 600 AS output_tokens, round(count(*) * 800 / 1e6 * 3.0 + count(*) * 600 / 1e6 * 15.0, 2) AS cost_usd, count(*) * 3 AS examples, round(count(*) * 1.2::DOUBLE / 60, 1) AS minutes FROM documents")
def p25_cost_estimate(spark, sf_dir):
    return report.generation_cost(FX.chunks(spark, sf_dir), C.GenerationConfig())


@query("SELECT sum(n_chars) AS tokens_in, count(*) * 600 AS tokens_out, round(sum(n_chars) / 1e6 * 0.3, 4) AS cost_in, round(count(*) * 600 / 1e6 * 1.2, 4) AS cost_out, round(sum(n_chars) / 1e6 * 0.3 + count(*) * 600 / 1e6 * 1.2, 4) AS cost_total FROM documents")
def p26_token_cost(spark, sf_dir):
    return report.token_cost(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("tokens_in"), F.lit(600).alias("tokens_out")))


@query("SELECT item_id, " + STRIP.format("text") + " AS response FROM benchmark")
def p27_echo_strip(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", X.echo_stripped(F.concat(F.lit("<s>system</s>\n<s>assistant</s>\n\nquestion<s>assistant</s>\n\n"), "text"), "<s>assistant</s>").alias("response"))


# --- Joins and dedup


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j1_unprocessed_anti(spark, sf_dir):
    return generation.unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, l.quality, l.toxic, d.source FROM documents d JOIN labels l USING (doc_id)")
def j2_scores_by_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", "source")


@query(f"WITH {FX.EXAMPLES}, e AS (SELECT * FROM ex WHERE answer IS NOT NULL), k AS (SELECT DISTINCT substr(question, 1, 200) AS a, substr(answer, 1, 200) AS b FROM e WHERE source = 'minor') SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE a = substr(question, 1, 200) AND b = substr(answer, 1, 200))")
def j3_content_anti(spark, sf_dir):
    e = FX.examples(spark, sf_dir).where("answer is not null").select("id", "source", "question", "answer")
    return quality.content_anti(e, e.where("source = 'minor'").select(F.col("question"), F.col("answer")).alias("k").toDF("question", "answer"), "question", "answer").select("id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(substr(text, 1, 150)) ORDER BY doc_id) AS rn FROM documents) SELECT doc_id FROM r WHERE rn = 1")
def j4_prefix_dedup(spark, sf_dir):
    return dedup.prefix_dedup(table(spark, sf_dir, "documents"), 150, [F.col("doc_id")]).select("doc_id")


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) > 0.45")
def j5_similar_pairs(spark, sf_dir):
    return dedup.similar_pairs(FX.vectors(spark, sf_dir), 0.45).withColumn("similarity", F.round("similarity", 4))


_cos = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def sql_greedy(pairs: str, name: str) -> str:
    """Recursive CTE `name`(k, gone) over pairs (n from 1 in order, i, j, li, lj): the lists of ids that are dropped."""
    return f"{name}(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN list_contains(gone, p.i) OR list_contains(gone, p.j) THEN gone ELSE list_append(gone, CASE WHEN p.li >= p.lj THEN p.j ELSE p.i END) END FROM {name} JOIN {pairs} p ON p.n = {name}.k + 1)"


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, embedding, label AS length, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM embeddings),
p AS (SELECT row_number() OVER (ORDER BY a.vec_id, b.vec_id) AS n, a.vec_id AS i, b.vec_id AS j, a.length AS li, b.length AS lj FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE {_cos} > 0.45),
{sql_greedy('p', 'g')} SELECT vec_id, source, length FROM v WHERE vec_id NOT IN (SELECT unnest(gone) FROM g WHERE k = (SELECT max(k) FROM g))""")
def j5_semantic_dedup(spark, sf_dir):
    return dedup.semantic_dedup(FX.vectors(spark, sf_dir), 0.45).select("vec_id", "source", "length")


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, embedding, label AS length, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM embeddings),
p AS (SELECT row_number() OVER (ORDER BY a.vec_id, b.vec_id) AS n, a.vec_id AS i, b.vec_id AS j, a.length AS li, b.length AS lj FROM v a JOIN v b ON a.source = 'even' AND b.source = 'odd' WHERE {_cos} > 0.45),
s(k, gone, cur, lives) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, FALSE UNION ALL SELECT k + 1, CASE WHEN (CASE WHEN p.i = cur THEN lives ELSE NOT list_contains(gone, p.i) END) AND NOT list_contains(gone, p.j) THEN list_append(gone, CASE WHEN p.li >= p.lj THEN p.j ELSE p.i END) ELSE gone END,
p.i, CASE WHEN p.i = cur THEN lives ELSE NOT list_contains(gone, p.i) END FROM s JOIN p ON p.n = s.k + 1)
SELECT vec_id, source, length FROM v WHERE vec_id NOT IN (SELECT unnest(gone) FROM s WHERE k = (SELECT max(k) FROM s))""")
def j6_cross_source_dedup(spark, sf_dir):
    return dedup.cross_source_dedup(FX.vectors(spark, sf_dir), 0.45, "even", "odd").select("vec_id", "source", "length")


@query("SELECT item_id, 'base:' || length(text) AS base_response, 'tuned:' || length(text) AS finetuned_response FROM benchmark")
def j7_x9_question_by_model(spark, sf_dir):
    models = F.explode(F.array(F.lit("base"), F.lit("tuned")))
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text", models.alias("model")).select("item_id", "model", F.concat_ws(":", "model", F.length("text")).alias("prompt"))
    keyed = asked.withColumn("k", F.concat_ws("|", "item_id", "model"))
    said = generation.generate(keyed, _echo, "k", "prompt", partitions=4)
    joined = said.withColumn("item_id", F.split("k", r"\|")[0].cast("bigint")).withColumn("model", F.split("k", r"\|")[1])
    return joined.groupBy("item_id").pivot("model", ["base", "tuned"]).agg(F.first("response")).toDF("item_id", "base_response", "finetuned_response")


def _echo():
    """A provider that repeats its prompt."""
    return lambda prompt: prompt


@query("SELECT case_id, tier FROM (SELECT unnest(generate_series(1, 15)) AS case_id), (SELECT unnest(['A','B','C','D','E','F','G']) AS tier)")
def j8_case_by_tier(spark, sf_dir):
    return spark.range(1, 16).select(F.col("id").alias("case_id"), F.explode(F.array(*map(F.lit, "ABCDEFG"))).alias("tier"))


def scores(spark):
    return spark.createDataFrame(FX.SCORES, FX.SCORE_COLS).withColumn("composite", evalstats.composite())


def ratings(spark):
    return spark.createDataFrame(FX.RATINGS, FX.RATING_COLS)


HUMAN = f"{FX.SCORES_SQL}, {FX.RATINGS_SQL}, hm AS (SELECT case_id, tier, round(avg(score), 4) AS human_mean, max(score) - min(score) AS rater_range, count(*) AS raters FROM rt GROUP BY ALL), jh AS (SELECT sc.case_id, sc.tier, composite AS judge, human_mean AS human FROM sc JOIN hm USING (case_id, tier))"


def judged(spark):
    h = evalstats.human_mean(ratings(spark), ["case_id", "tier"])
    return scores(spark).join(h, ["case_id", "tier"]).select("case_id", "tier", F.col("composite").alias("judge"), F.col("human_mean").alias("human"))


@query(f"WITH {HUMAN} SELECT case_id, tier, round(judge, 4) AS judge, human FROM jh")
def j9_judge_human_join(spark, sf_dir):
    return judged(spark).withColumn("judge", F.round("judge", 4))


@query("""WITH t AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS source, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS rn FROM t) SELECT vec_id, source, score FROM r WHERE rn <= 3 ORDER BY score DESC, vec_id LIMIT 5""")
def j10_topk_diverse(spark, sf_dir):
    v = FX.vectors(spark, sf_dir)
    probe = v.where("vec_id = 0").first()["embedding"]
    return dedup.top_k_diverse(v, probe, 5, 3)


# --- Reports


@query(f"WITH {FX.EXAMPLES} SELECT CASE WHEN answer IS NULL THEN 'invalid' ELSE source END AS source, count(*) AS n FROM ex GROUP BY 1")
def a1_count_by_source(spark, sf_dir):
    return report.count_by_source(FX.examples(spark, sf_dir), valid=F.col("answer").isNotNull())


@query(f"WITH {PASSED} SELECT stratum, count(*) AS n FROM ps GROUP BY ALL")
def a3_histogram(spark, sf_dir):
    return report.histogram(passed(spark, sf_dir), "stratum")


@query("SELECT quality, count(*) AS n, round((SELECT avg(quality) FROM labels), 2) AS mean FROM labels GROUP BY quality")
def a4_score_histogram(spark, sf_dir):
    return report.score_summary(table(spark, sf_dir, "labels"), "quality")


@query("""WITH l AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS r, count(*) OVER () AS t FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS n, min(v) AS min_len, max(v) AS max_len, round(avg(v), 1) AS mean_len, max(CASE WHEN r = t // 2 THEN v END) AS median_len FROM l""")
def a5_length_stats(spark, sf_dir):
    return report.length_stats(table(spark, sf_dir, "documents"), F.length("text"))


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, count(*) AS n FROM documents")
def a6_distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STRATA}, d AS (SELECT stratum, count(*) AS b, count(CASE WHEN rn = 1 THEN 1 END) AS a FROM (SELECT stratum, row_number() OVER (PARTITION BY md5(substr(text, 1, 150)) ORDER BY id) AS rn FROM qc) GROUP BY ALL)
SELECT stratum, b AS count_before, round(b / sum(b) OVER (), 4) AS fraction_before, a AS count_after, round(a / sum(a) OVER (), 4) AS fraction_after FROM d""")
def a7_fractions(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("rn", dedup.prefix_rank(150, [F.col("id")]))
    return report.kept_fractions(c, F.col("rn") == 1)


@query(f"WITH {REJECTED} SELECT source, count(*) AS initial, count(CASE WHEN rejected_at IS NULL THEN 1 END) AS final, round(count(CASE WHEN rejected_at IS NULL THEN 1 END) * 100.0::DOUBLE / count(*), 1) AS retained_pct FROM rj GROUP BY ALL")
def a8_retention(spark, sf_dir):
    return report.retention(FX.examples(spark, sf_dir), passed(spark, sf_dir))


_targets = FX.values([(s.name, int(400 * s.share + 1e-9)) for s in C.FIXTURE.strata], "stratum string, target int")


@query(f"WITH {STRATA} SELECT v.stratum, count(qc.id) AS available, v.target FROM {_targets} LEFT JOIN qc USING (stratum) GROUP BY ALL")
def a9_availability(spark, sf_dir):
    return report.availability(classified(spark, sf_dir), C.FIXTURE, 400)


@query("SELECT count(*) AS processed, count(CASE WHEN n_chars < 80 THEN 1 END) AS failed, 2 * count(CASE WHEN n_chars >= 80 THEN 1 END) AS examples, sum(n_chars) AS tokens_in, count(*) AS tokens_out, round(sum(n_chars) / 1e6 * 0.3 + count(*) / 1e6 * 1.2, 4) AS cost_usd FROM documents")
def a10_progress(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("n_chars") < 80).alias("failed"), F.when(F.col("n_chars") >= 80, 2).otherwise(0).alias("examples"), F.col("n_chars").alias("tokens_in"), F.lit(1).alias("tokens_out"))
    return incremental.progress(d)


@query("SELECT source AS stratum, count(*) AS scored, sum((quality = 0)::INT) AS rejected, round(sum((quality = 0)::INT) / count(*), 4) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def a11_reject_by_stratum(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("stratum", F.col("source"))
    return report.reject_by_stratum(d, F.col("quality") > 0)


@query(f"WITH {FX.SCORES_SQL} SELECT tier, coalesce(complexity, 'all') AS complexity, round(avg(composite), 4) AS mean, count(*) AS n FROM sc GROUP BY GROUPING SETS ((tier, complexity), (tier))")
def a12_tier_means(spark, sf_dir):
    return evalstats.tier_means(scores(spark))


@query(f"WITH {FX.SCORES_SQL} SELECT tier, round(avg(dx), 4) AS dx, round(avg(guide), 4) AS guide, round(avg(complete), 4) AS complete, round(avg(utility), 4) AS utility FROM sc GROUP BY ALL")
def a12_criterion_pivot(spark, sf_dir):
    return evalstats.criterion_pivot(scores(spark))


@query(f"""WITH {FX.SCORES_SQL}, g AS (SELECT complexity AS model, max(CASE WHEN strategy = 'base' THEN composite END) AS base, max(CASE WHEN strategy = 'rag' THEN composite END) AS rag, max(CASE WHEN strategy = 'ft' THEN composite END) AS ft, arg_max(strategy, (composite, strategy)) AS best, max(composite) AS top FROM sc GROUP BY 1)
SELECT model, round(base, 4) AS base, round(rag, 4) AS rag, round(ft, 4) AS ft, round(rag - base, 4) AS rag_delta, round(ft - base, 4) AS ft_delta, best, round(top / base, 4) AS ratio FROM g""")
def a13_a23_strategy_delta(spark, sf_dir):
    d = evalstats.strategy_delta(scores(spark).withColumnRenamed("complexity", "model"))
    return d.withColumns({c: F.round(c, 4) for c in ("base", "rag", "ft")})


@query(f"""WITH {FX.SCORES_SQL}, r AS (SELECT tier, composite AS v, row_number() OVER (PARTITION BY tier ORDER BY composite) - 1 AS r, count(*) OVER (PARTITION BY tier) AS n FROM sc),
p AS (SELECT tier, b, ('0x' || substr(md5('42:' || tier || ':' || b || ':' || r), 1, 8))::BIGINT % n AS p FROM r, generate_series(1, 200) g(b)), m AS (SELECT p.tier, b, avg(v) AS m FROM p JOIN r ON p.tier = r.tier AND p.p = r.r GROUP BY ALL)
SELECT a.tier, round(a.mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m JOIN (SELECT tier, avg(composite) AS mean FROM sc GROUP BY 1) a ON a.tier = m.tier GROUP BY a.tier, a.mean""")
def a14_bootstrap(spark, sf_dir):
    return evalstats.bootstrap(scores(spark), "tier", "composite")


@query(f"""WITH {HUMAN}, r AS (SELECT judge, human, rank() OVER (ORDER BY judge) + (count(*) OVER (PARTITION BY judge) - 1) / 2 AS rj, rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2 AS rh FROM (SELECT round(judge, 6) AS judge, human FROM jh))
SELECT count(*) AS n, round(corr(judge, human), 6) AS pearson, round(corr(rj, rh), 6) AS spearman FROM r""")
def a15_correlations(spark, sf_dir):
    return evalstats.correlations(judged(spark).withColumn("judge", F.round("judge", 6)), "judge", "human")


@query(f"WITH {HUMAN} SELECT count(*) AS n, round(avg(judge - human), 6) AS bias, round(avg(judge - human) - 1.96 * stddev_samp(judge - human), 6) AS lower, round(avg(judge - human) + 1.96 * stddev_samp(judge - human), 6) AS upper FROM jh")
def a16_bland_altman(spark, sf_dir):
    return evalstats.bland_altman(judged(spark), "judge", "human")


@query(f"""WITH {FX.RATINGS_SQL}, o AS (SELECT sum((a.score - b.score) ** 2 / (m - 1)) AS w FROM rt a JOIN rt b ON a.case_id = b.case_id AND a.tier = b.tier AND a.rater <> b.rater JOIN (SELECT case_id, tier, count(*) AS m FROM rt GROUP BY ALL) c ON c.case_id = a.case_id AND c.tier = a.tier),
e AS (SELECT sum((a.score - b.score) ** 2) AS d FROM rt a, rt b), c AS (SELECT count(*) AS n FROM rt) SELECT n, round(1 - (w / n) / (d / (n * (n - 1))), 6) AS alpha, CASE WHEN 1 - (w / n) / (d / (n * (n - 1))) >= 0.8 THEN 'reliable' WHEN 1 - (w / n) / (d / (n * (n - 1))) >= 0.67 THEN 'tentative' ELSE 'unreliable' END AS band FROM o, e, c""")
def a17_krippendorff(spark, sf_dir):
    k = evalstats.krippendorff(ratings(spark), ["case_id", "tier"], "score")
    return k.withColumn("band", evalstats.agreement_band(F.col("alpha")))


@query(f"WITH {HUMAN} SELECT case_id, tier FROM jh WHERE abs(judge - human) > 1")
def a18_discrepancies(spark, sf_dir):
    return evalstats.discrepancies(judged(spark), "judge", "human").select("case_id", "tier")


@query(f"WITH {HUMAN} SELECT * FROM hm")
def a19_human_mean(spark, sf_dir):
    return evalstats.human_mean(ratings(spark), ["case_id", "tier"])


@query(f"WITH {FX.SCORES_SQL} SELECT case_id, tier, round(composite / nullif(cost_usd, 0), 4) AS score_per_usd FROM sc")
def a20_cost_benefit(spark, sf_dir):
    return evalstats.cost_benefit(scores(spark)).select("case_id", "tier", "score_per_usd")


@query(f"WITH {FX.SCORES_SQL} SELECT tier, round(avg(latency), 4) AS latency, round(avg(tokens / latency), 4) AS tokens_per_s, round(avg(tokens), 4) AS tokens, round(avg(cost_usd), 4) AS cost_usd FROM sc GROUP BY ALL")
def a21_operational_means(spark, sf_dir):
    return scores(spark).groupBy("tier").agg(*[F.round(F.avg(x), 4).alias(n) for x, n in ((F.col("latency"), "latency"), (F.col("tokens") / F.col("latency"), "tokens_per_s"), (F.col("tokens"), "tokens"), (F.col("cost_usd"), "cost_usd"))])


@query(f"WITH {FX.SCORES_SQL}, g AS (SELECT tier, avg(CASE WHEN case_id <= 3 THEN tokens END) AS r1, avg(CASE WHEN case_id > 3 THEN tokens END) AS r2 FROM sc GROUP BY 1) SELECT tier, round(r1, 4) AS round_1, round(r2, 4) AS round_2, round(r2 / nullif(r1, 0), 4) AS ratio FROM g")
def a22_token_length_by_round(spark, sf_dir):
    p = scores(spark).withColumn("r", F.when(F.col("case_id") <= 3, 1).otherwise(2)).groupBy("tier").pivot("r", [1, 2]).agg(F.avg("tokens"))
    return p.select("tier", F.round("1", 4).alias("round_1"), F.round("2", 4).alias("round_2"), F.round(F.try_divide("2", "1"), 4).alias("ratio"))


@query(f"WITH {FX.SCORES_SQL} SELECT coalesce(tier, 'total') AS tier, round(sum(cost_usd), 4) AS cost, round(sum(cost_usd) * 0.4, 4) AS projected FROM sc GROUP BY ROLLUP (tier)")
def a24_cost_totals(spark, sf_dir):
    return scores(spark).rollup("tier").agg(F.round(F.sum("cost_usd"), 4).alias("cost"), F.round(F.sum("cost_usd") * 0.4, 4).alias("projected")).select(F.coalesce("tier", F.lit("total")).alias("tier"), "cost", "projected")


@query(f"WITH {HUMAN}, s AS (SELECT tier, avg(composite) AS m FROM sc WHERE complexity = 'simple' GROUP BY 1) SELECT (SELECT m FROM s WHERE tier = 'A') >= 0.7 * (SELECT max(m) FROM s) AS local_enough, (SELECT corr(judge, human) FROM jh) > 0.8 AS judge_valid")
def a25_hypotheses(spark, sf_dir):
    m = scores(spark).where("complexity = 'simple'").groupBy("tier").agg(F.avg("composite").alias("m"))
    local = m.agg((F.max(F.when(F.col("tier") == "A", F.col("m"))) >= 0.7 * F.max("m")).alias("local_enough"))
    return local.crossJoin(judged(spark).agg((F.corr("judge", "human") > 0.8).alias("judge_valid")))


@query(f"WITH {FX.SCORES_SQL} SELECT case_id, tier, round(composite, 4) AS composite, CASE WHEN composite >= 4.5 THEN 'excellent' WHEN composite >= 3.5 THEN 'good' WHEN composite >= 2.5 THEN 'acceptable' WHEN composite >= 1.5 THEN 'insufficient' ELSE 'unacceptable' END AS band FROM sc")
def p28_p29_composite_bands(spark, sf_dir):
    return scores(spark).select("case_id", "tier", F.round("composite", 4).alias("composite"), evalstats.band(F.col("composite")).alias("band"))


# --- Samples and splits

_rank = "CASE stratum " + " ".join(f"WHEN {q(s.name)} THEN {k}" for k, s in enumerate(C.FIXTURE.strata)) + " END"


@query(f"""WITH {STRATA}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, md5(substr(text, 1, 100)) ORDER BY id) AS rn FROM qc) WHERE rn = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY stratum, source ORDER BY id) - 1 AS r, dense_rank() OVER (PARTITION BY stratum ORDER BY md5('42:' || source), source) - 1 AS p FROM u),
b AS (SELECT a.*, r * (max(p) OVER (PARTITION BY stratum) + 1) + p AS visit, target FROM a JOIN {_targets} USING (stratum)),
c AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY visit >= 10 * target, CASE WHEN visit < 10 * target THEN visit END NULLS FIRST, CASE WHEN visit >= 10 * target THEN md5('42:' || id) END NULLS FIRST, id) AS pick FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY md5(substr(text, 1, 150)) ORDER BY {_rank}, pick) AS rn2 FROM c WHERE pick <= target) SELECT id, stratum, pick FROM d WHERE rn2 = 1""")
def w1_w2_w3_round_robin_sample(spark, sf_dir):
    return sampling.chunk_picks(classified(spark, sf_dir), C.FIXTURE, 400, 42)


@query(f"WITH {STRATA}, r AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM qc) SELECT id, stratum FROM r WHERE rn <= greatest(1, floor(n * 0.05::DOUBLE))")
def w4_stratified_sample(spark, sf_dir):
    return sampling.stratified_fraction(strata(spark, sf_dir), 0.05, 42).select("id", "stratum")


_caps = "n0 AS (SELECT stratum, count(*) AS n FROM qc GROUP BY 1)" + "".join(f", n{k} AS (SELECT stratum, least(n, CAST(floor(sum(n) OVER () * 0.4::DOUBLE) AS BIGINT)) AS n FROM n{k - 1})" for k in range(1, 11))


@query(f"WITH {STRATA}, {_caps}, r AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || id), id) AS rn FROM qc) SELECT id, r.stratum FROM r JOIN n10 USING (stratum) WHERE rn <= n")
def w5_balance_cap(spark, sf_dir):
    return sampling.balance(strata(spark, sf_dir), 42).select("id", "stratum")


@query(f"""WITH {STRATA}, r AS (SELECT id, source, stratum, row_number() OVER (PARTITION BY source, stratum ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY source, stratum) AS n FROM qc),
s AS (SELECT *, greatest(1, floor(n * 0.9::DOUBLE)) AS nt, floor(n * 0.05::DOUBLE) AS nv FROM r) SELECT id, source, stratum, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + CASE WHEN nt + nv >= n THEN greatest(0, n - nt - 1) ELSE nv END THEN 'valid' ELSE 'test' END AS split FROM s""")
def w6_stratified_split(spark, sf_dir):
    return sampling.stratified_split(strata(spark, sf_dir), 42, ["source", "stratum"]).select("id", "source", "stratum", "split")


@query("""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag, l_linestatus FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM r),
s AS (SELECT *, greatest(1, floor(n * 0.9::DOUBLE)) AS nt, floor(n * 0.05::DOUBLE) AS nv FROM k) SELECT id, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + CASE WHEN nt + nv >= n THEN greatest(0, n - nt - 1) ELSE nv END THEN 'valid' ELSE 'test' END AS split FROM s""")
def w6_stratified_split_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_returnflag", "l_linestatus")
    return sampling.stratified_split(li, 42, ["l_returnflag", "l_linestatus"]).select("id", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= n * 80 // 100 THEN 'train' WHEN rn <= n * 80 // 100 + n * 10 // 100 THEN 'valid' ELSE 'test' END AS split FROM r")
def w7_global_split(spark, sf_dir):
    return sampling.global_split(table(spark, sf_dir, "documents"), 42, id_col="doc_id").select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= n // 2 THEN 1 ELSE 2 END AS batch FROM r")
def w8_halves(spark, sf_dir):
    return sampling.halves(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "batch")


@query("SELECT doc_id FROM documents ORDER BY md5('2026:' || doc_id), doc_id LIMIT 50")
def w9_fixed_sample(spark, sf_dir):
    return sampling.fixed_sample(table(spark, sf_dir, "documents"), 50, 2026, "doc_id").select("doc_id")


@query(f"WITH {FX.SCORES_SQL} SELECT case_id, tier, chr(CAST(64 + row_number() OVER (PARTITION BY case_id ORDER BY md5('42:' || case_id || ':' || tier), tier) AS INTEGER)) AS letter FROM sc")
def w10_letters(spark, sf_dir):
    return sampling.letters(scores(spark), 42).select("case_id", "tier", "letter")


#: Published panels by scenario: the case ids of each evaluator.
PANELS = {"A": ["1 3 5 7 8 9 10 11 13 15", "1 2 4 6 7 9 10 12 14 15", "2 3 4 5 6 8 11 12 13 14"],
          "B": ["1 4 5 8 9 11 13 15", "2 3 6 7 10 12 14 15", "1 2 5 7 8 10 11 14", "3 4 6 9 12 13 14 15"],
          "C": ["1 4 7 9 11 14", "2 5 8 10 12 15", "3 6 7 9 13 14", "1 4 8 10 11 15", "2 3 5 6 12 13"]}
ASSIGNED = [(s, f"D{k}", int(c)) for s, ds in PANELS.items() for k, d in enumerate(ds, 1) for c in d.split()]


@query(f"SELECT scenario, case_id, count(*) AS raters, count(*) = 2 AS balanced FROM {FX.values(ASSIGNED, 'scenario string, doctor string, case_id int')} GROUP BY scenario, case_id")
def w11_assignment_check(spark, sf_dir):
    a = spark.createDataFrame(ASSIGNED, "scenario string, doctor string, case_id int")
    return a.groupBy("scenario", "case_id").agg(F.count(F.lit(1)).alias("raters")).withColumn("balanced", F.col("raters") == 2)


LOSSES = [(m, i, round(2 - 0.1 * i + 0.01 * (i - k) ** 2, 4)) for m, k in (("small", 12), ("large", 9)) for i in range(1, 21)]


@query(f"SELECT model, arg_min(iter, (val_loss, iter)) AS best_iter, min(val_loss) AS best_loss FROM {FX.values(LOSSES, 'model string, iter int, val_loss double')} GROUP BY model")
def w12_best_checkpoint(spark, sf_dir):
    return evalstats.best_checkpoint(spark.createDataFrame(LOSSES, "model string, iter int, val_loss double"))


@query(f"WITH {HUMAN}, j AS (SELECT case_id, tier, round(judge, 6) AS judge, human FROM jh), r AS (SELECT case_id, tier, rank() OVER (PARTITION BY case_id ORDER BY judge DESC) AS judge_rank, rank() OVER (PARTITION BY case_id ORDER BY human DESC) AS human_rank FROM j) SELECT *, judge_rank = human_rank AS same FROM r")
def w13_rank_agreement(spark, sf_dir):
    return evalstats.rank_agreement(judged(spark).withColumn("judge", F.round("judge", 6))).select("case_id", "tier", "judge_rank", "human_rank", "same")


# --- Order, sets


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def o1_sorted_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def o2_topk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def o3_prefix_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def o4_shuffle(spark, sf_dir):
    r = sampling.global_rank(table(spark, sf_dir, "documents"), X.seeded(42, F.col("doc_id")), "doc_id")
    return r.select("doc_id", F.col("_rank").alias("place"))


@query("SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'label', doc_id FROM labels")
def u1_union(spark, sf_dir):
    tag = lambda n, k: table(spark, sf_dir, n).select(F.lit(k).alias("kind"), F.col("doc_id").alias("id"))
    return tag("documents", "doc").unionByName(tag("labels", "label"))


@query("SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark")
def u2_union_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "benchmark").select("item_id")).distinct()


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def u3_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")


# --- Files


def _stored(spark, what: str):
    return files.scratch_path(spark, what) + "/t"


@query(f"WITH {FX.EXAMPLES} SELECT CASE WHEN id % 5 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM ex WHERE answer IS NOT NULL GROUP BY 1")
def s2_jsonl_scan(spark, sf_dir):
    """One row in five is written as what isn't an example (cut JSON, a number, messages that aren't a list), with blank
    lines between."""
    e = FX.examples(spark, sf_dir).where("answer is not null")
    good = F.to_json(F.struct("messages"))
    bad = F.element_at(F.array(F.lit('{"messages": ['), F.lit("17"), F.lit('{"messages": "no"}')), (F.col("id") % 3 + 1).cast("int"))
    path = _stored(spark, "s2")
    e.select(F.explode(F.array(F.when(F.col("id") % 5 == 0, bad).otherwise(good), F.lit("  "))).alias("value")).write.text(path)
    return files.read_jsonl(spark, path).groupBy(F.when(F.col("messages").isNull(), "bad").otherwise("good").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FX.EXAMPLES} SELECT source AS _source, count(*) AS n FROM ex WHERE answer IS NOT NULL GROUP BY 1")
def s3_tagged_union(spark, sf_dir):
    e, path = FX.examples(spark, sf_dir).where("answer is not null"), _stored(spark, "s3")
    for s in ("major", "minor"):
        files.write_jsonl(e.where(F.col("source") == s), f"{path}/{s}")
    return files.read_tagged(spark, [(f"{path}/{s}", s) for s in ("major", "missing", "minor")]).groupBy("_source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STRATA} SELECT id::VARCHAR AS id, stratum, md5(text) AS text FROM qc")
def s4_s7_envelope_roundtrip(spark, sf_dir):
    path = _stored(spark, "s7")
    c = classified(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    m = c.groupBy().agg(F.lit("1.0").alias("version"), F.count(F.lit(1)).alias("sampled_count"))
    files.write_chunks(c.select(*[f.name for f in schema.CHUNK]), path, m)
    files.write_envelopes(spark.read.schema(schema.CHUNK).json(f"{path}/chunks"), f"{path}/envelope", 100)
    return files.read_envelope(spark, f"{path}/envelope").select("id", "stratum", F.md5("text").alias("text"))


@query("SELECT doc_id AS index, quality AS score, 'q' AS reason, NULL::VARCHAR AS stratum FROM labels")
def s5_s6_score_files(spark, sf_dir):
    path = _stored(spark, "s6")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"), F.col("quality").cast("int").alias("score"), F.lit("q").alias("reason"), F.lit(None).cast("string").alias("stratum"))
    rows.write.json(f"{path}/lines")
    strict = files.read_jsonl_strict(spark, f"{path}/lines", schema.SCORE)
    # A JSON array per file, as the scorer writes it.
    files.write_scores(strict, f"{path}/array")
    return files.read_scores(spark, f"{path}/array")


@query(f"WITH {PASSED}, r AS (SELECT id, source, stratum, question, answer, row_number() OVER (PARTITION BY source, stratum ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY source, stratum) AS n FROM ps), s AS (SELECT *, greatest(1, floor(n * 0.9::DOUBLE)) AS nt, floor(n * 0.05::DOUBLE) AS nv FROM r), t AS (SELECT question, answer, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + CASE WHEN nt + nv >= n THEN greatest(0, n - nt - 1) ELSE nv END THEN 'valid' ELSE 'test' END AS split FROM s) SELECT split, question, answer, count(*) AS n FROM t GROUP BY ALL")
def s8_jsonl_roundtrip(spark, sf_dir):
    path = _stored(spark, "s8")
    files.write_jsonl(sampling.stratified_split(passed(spark, sf_dir), 42, ["source", "stratum"]), path, "split")
    back = spark.read.schema(T.StructType([*schema.EXAMPLE.fields, T.StructField("split", T.StringType())])).json(path)
    return stages.canonical(back).groupBy("split", F.col("user").alias("question"), F.col("assistant").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PASSED}, r AS (SELECT id, source, stratum, row_number() OVER (PARTITION BY source, stratum ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY source, stratum) AS n FROM ps), s AS (SELECT *, greatest(1, floor(n * 0.9::DOUBLE)) AS nt, floor(n * 0.05::DOUBLE) AS nv FROM r), t AS (SELECT CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + CASE WHEN nt + nv >= n THEN greatest(0, n - nt - 1) ELSE nv END THEN 'valid' ELSE 'test' END AS split FROM s) SELECT split, count(*) AS lines FROM t GROUP BY ALL")
def a26_line_counts(spark, sf_dir):
    path = _stored(spark, "a26")
    files.write_jsonl(sampling.stratified_split(passed(spark, sf_dir), 42, ["source", "stratum"]), path, "split")
    return spark.read.schema("split string, messages string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {REJECTED} SELECT source, count(*) AS before, count(rejected_at) AS rejected FROM rj GROUP BY ALL")
def s9_report_roundtrip(spark, sf_dir):
    path = _stored(spark, "s9")
    r = stages.funnel_report(stages.with_rejection(FX.examples(spark, sf_dir), FUNNEL), FUNNEL)
    r.write.json(path)
    back = spark.read.schema(r.schema).json(path)
    return back.groupBy("source").agg(F.max("before").alias("before"), F.sum("rejected").alias("rejected"))


@query(f"WITH {FX.SCORES_SQL} SELECT strategy AS arena, count(*) AS n FROM sc GROUP BY ALL")
def s12_tier_merge(spark, sf_dir):
    path = _stored(spark, "s12")
    s = scores(spark).withColumn("arena", F.col("strategy"))
    for a in ("base", "rag", "ft"):
        files.append_tier(s.where(F.col("arena") == a), path)
    return spark.read.parquet(path).groupBy("arena").agg(F.count(F.lit(1)).alias("n"))


# --- Incremental runs, providers, models


@query("SELECT doc_id AS id, 'P' || n_chars AS response FROM documents")
def t1_t2_resume_stream(spark, sf_dir):
    """documents arrive in two parts; a second run takes up what the first left, and neither repeats a row."""
    path = _stored(spark, "t1")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("P"), "n_chars").alias("prompt"))
    for part in (0, 1):
        d.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(d.schema).parquet(f"{path}/in")
        incremental.run_available(stream, lambda b: generation.generate(b, _echo), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("id", "response")


@query("SELECT count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT DISTINCT md5(substr(text, 1, 150)) AS key FROM documents)")
def t5_first_wins_stream(spark, sf_dir):
    path = _stored(spark, "t5")
    raw = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    s = incremental.first_wins(raw.select("doc_id", "text")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    s.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(X.prefix_key(F.col("text"), 150)).alias("keys"))


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE 'P' || n_chars END AS response, n_chars % 7 = 0 AS failed, CASE WHEN n_chars % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM documents")
def x2_t3_t4_provider(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("P"), "n_chars").alias("prompt"))
    return generation.generate(p, _flaky, "doc_id")


def _flaky():
    """A provider that always fails for one prompt in seven."""

    def call(prompt: str) -> str:
        if int(prompt[1:]) % 7 == 0:
            raise TimeoutError(prompt)
        return prompt

    return call


@query(f"WITH {STRATA}, r AS (SELECT id, stratum, length(text) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY stratum) AS c FROM qc), s AS (SELECT id, n % 6 AS score FROM r WHERE rn <= greatest(1, floor(c * 0.05::DOUBLE))) SELECT id FROM qc WHERE id NOT IN (SELECT id FROM s WHERE score < 3)")
def x3_sampled_scorer(spark, sf_dir):
    """A sample is scored by a provider; failing rows go, unscored ones stay."""
    c = classified(spark, sf_dir)
    asked = sampling.stratified_fraction(c, 0.05, 42).select("id", F.length("text").cast("string").alias("prompt"))
    said = generation.generate(asked, _scorer)
    scored = said.select("id", F.from_json("response", "score int, reason string")["score"].alias("score"))
    return quality.score_filter(c, scored, 3, "id").select("id")


def _scorer():
    return lambda prompt: json.dumps({"score": int(prompt) % 6, "reason": "length"})


@query("SELECT doc_id, CAST(CASE n_chars % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 END AS DOUBLE) AS score, CASE n_chars % 5 WHEN 0 THEN '' WHEN 1 THEN 'cut' WHEN 2 THEN 'text' WHEN 3 THEN 'fenced' END AS reason, n_chars % 5 = 4 AS failed, n_chars % 5 IN (1, 2, 4) AS kept FROM documents")
def x3_llm_scorer(spark, sf_dir):
    """Replies without a score (0), with 3.7, with "4", in a fence, and without JSON; what has no score stays."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("question"), F.lit("").alias("answer"))
    said = generation.llm_scores(d, _judge, "doc_id", template="%s|%s|")
    return said.withColumn("kept", F.coalesce(F.col("score") >= 3, F.lit(True))).withColumn("score", F.col("score").cast("double"))


def _judge():
    replies = ['{"reason": ""}', 'hm</think>{"score": 3.7, "reason": "cut"}', '{"score": "4", "reason": "text"}', '```json\n{"score": 2, "reason": "fenced"}\n```', "five out of five"]
    return lambda prompt: replies[int(prompt.split("|")[0]) % 5]


@query("SELECT doc_id, CASE n_chars % 50 WHEN 0 THEN '(TIMEOUT)' WHEN 1 THEN '(ERROR: no)' ELSE 'P' || n_chars END AS response, n_chars % 50 < 2 AS failed FROM documents WHERE lang = 'en'")
def x9_timeouts(spark, sf_dir):
    """A provider that hangs for some prompts and fails for others; the rows say so. A task makes 16 calls at the same
    time, or its waits for those that hang would add up."""
    p = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.concat(F.lit("P"), "n_chars").alias("prompt"))
    return generation.generate(p, _hanging, "doc_id", retries=1, timeout=0.3, marks=True, calls=16).select("doc_id", "response", "failed")


def _hanging():
    def call(prompt: str) -> str:
        k = int(prompt[1:]) % 50
        if k == 0:
            time.sleep(1.5)
        if k == 1:
            raise RuntimeError("no")
        return prompt

    return call


@query("""WITH n AS (SELECT doc_id, length(text) AS c, len(text) - len(replace(text, 'e', '')) AS e FROM documents), u AS (SELECT doc_id, c, e, sqrt(c * c + e * e) AS norm FROM n)
SELECT doc_id, CASE WHEN c > 0 THEN round((c / norm)::FLOAT::DOUBLE, 5) ELSE 0 END AS x, CASE WHEN c > 0 THEN round((e / norm)::FLOAT::DOUBLE, 5) ELSE 0 END AS y FROM u""")
def x1_embeddings(spark, sf_dir):
    e = generation.embeddings(table(spark, sf_dir, "documents"), _counts, "doc_id")
    return e.select("doc_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.round(F.col("embedding")[1].cast("double"), 5).alias("y"))


def _counts():
    """A model of two dimensions: characters, and how many are e."""
    return lambda texts: [[len(t), t.count("e")] for t in texts]


@query("SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, count(CASE WHEN n_chars < 80 THEN 1 END) AS short FROM documents")
def s13_metrics(spark, sf_dir):
    """Counters taken in the pass that writes."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _stored(spark, "s13")
    got = metrics.observed(d, lambda x: x.write.parquet(path), "documents", chars=F.sum("n_chars"), short=F.count(F.when(F.col("n_chars") < 80, 1)))
    return spark.createDataFrame([(got["rows"], got["chars"], got["short"])], "rows bigint, chars bigint, short bigint")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) WHERE doc_id % 3 <> 0")
def s11_generation_options(spark, sf_dir):
    """The first 100 chunks less those that are done."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return generation.to_generate(d, d.where("doc_id % 3 = 0"), C.GenerationConfig(limit=100), "doc_id")


def _labelled(spark, sf_dir):
    """documents with text features, and quality where labelled. Labels come first, so that features are made of those
    documents only that a query goes on with."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = files.spread(table(spark, sf_dir, "documents")).join(files.bounded(labels), "doc_id", "left").withColumn("question", F.substring("text", 1, 60)).withColumn("stratum", F.lit("alpha"))
    df, names = quality.with_features(d, "question", "text", C.FIXTURE, "src0")
    return df.select("doc_id", *names, "quality"), names


@query()
def x5_x8_gbt_extrapolation(spark, sf_dir):
    """(doc_id, predicted) of the unlabelled documents; 200 trees."""
    df, names = _labelled(spark, sf_dir)
    model = quality.train(df.where("quality is not null"), names, "quality")
    rest = df.where("quality is null")
    if model is None:
        return rest.select("doc_id", F.lit(1).alias("predicted"))
    return quality.predict(model, rest, names).select("doc_id", "predicted")


@query()
def x6_cross_validated_f1(spark, sf_dir):
    df, names = _labelled(spark, sf_dir)
    return quality.cv_f1(df.where("quality is not null"), names, "quality", "doc_id").agg(F.round(F.avg("f1"), 4).alias("mean_f1"), F.round(F.stddev_pop("f1"), 4).alias("std_f1"))


@query()
def x7_feature_importances(spark, sf_dir):
    df, names = _labelled(spark, sf_dir)
    model = quality.train(df.where("quality is not null"), names, "quality")
    return quality.importances(model, names, spark).limit(10)

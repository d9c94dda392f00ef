"""Prompts, parsing of generated pairs, chat formatting, and resumable calls of an external provider."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GenerationConfig
from ..functions.text import strip_reasoning
from ..sources.schema import PAIRS


def orempty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def hint(stratum: Column, hints: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in hints.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), stratum), F.lit("")) if pairs else F.lit("")


def prompt(hints: dict[str, str], n_pairs: int = 3) -> Column:
    """Prompt of a flat chunk: labelled source, stratum, fragment and what to make of it. Nulls count as ''."""
    source, society, section = F.coalesce(F.col("source"), F.lit("Guía clínica")), orempty(F.col("society")), orempty(F.col("section_path"))
    label = F.concat(F.when(society != "", F.concat(F.lit("["), society, F.lit("] "))).otherwise(""), source, F.when(section != "", F.concat(F.lit(" > "), section)).otherwise(""))
    stratum = orempty(F.col("stratum"))
    return F.concat(F.lit("FUENTE: "), label, F.lit("\nTIPO DE CONTENIDO: "), stratum, F.lit("\n\nFRAGMENTO:\n"), orempty(F.col("text")),
                    F.lit(f"\n\nGenera {n_pairs} pares pregunta-respuesta clínicos basados en este fragmento. "), hint(stratum, hints), F.lit("\nResponde SOLO con el JSON array, sin texto adicional."))


def parse_pairs(df: DataFrame, response: str) -> DataFrame:
    """Explodes a generated JSON array to (type, question, answer) rows, one per object: Spanish keys and empty
    strings give way to the other name of a field. What isn't a non-empty array gives no rows."""
    parsed = df.withColumn("_p", F.from_json(strip_reasoning(F.col(response)), PAIRS)).where(F.size("_p") > 0)
    rows = parsed.select(*df.columns, F.posexplode("_p").alias("pair_no", "_q"))
    pick = lambda a, b, d: F.coalesce(F.nullif(F.col(f"_q.{a}"), F.lit("")), F.col(f"_q.{b}"), F.lit(d))
    return rows.select(*df.columns, "pair_no", pick("type", "tipo", "conocimiento").alias("type"), pick("question", "pregunta", "").alias("question"), pick("answer", "respuesta", "").alias("answer"))


def acceptable(question: Column, answer: Column, min_answer: int = 30) -> Column:
    return (question != "") & (answer != "") & (F.length(answer) > min_answer)


def cite(answer: Column, source: Column, society: Column) -> Column:
    """Appends the source where the answer doesn't name it in any case."""
    source, society = orempty(source), orempty(society)
    note = F.concat(F.lit("\n\n[Fuente: "), source, F.when(society != "", F.concat(F.lit(", "), society)).otherwise(""), F.lit("]"))
    return F.when((source != "") & ~F.contains(F.lower(answer), F.lower(source)), F.concat(F.regexp_replace(answer, r"(?U)\s+$", ""), note)).otherwise(answer)


def chat(system: str, question: Column, answer: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", answer))


def unprocessed(chunks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id isn't in `done`. Spark broadcasts `done` if it is small."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def to_generate(chunks: DataFrame, done: DataFrame | None, c: GenerationConfig, key: str = "id") -> DataFrame:
    """The chunks of a run: the first c.limit by id (0: all), less those that `done` has where c.resume."""
    some = chunks.orderBy(key).limit(c.limit) if c.limit else chunks
    return unprocessed(some, done, key) if c.resume and done is not None else some


Provider = Callable[[str], str]


def within(call: Provider, seconds: float) -> Provider:
    """`call` that raises TimeoutError after so many seconds (0: never). A call that hangs is left behind in a thread
    that doesn't keep the process."""
    if not seconds:
        return call

    def run(text: str) -> str:
        said: queue.SimpleQueue = queue.SimpleQueue()

        def ask() -> None:
            try:
                said.put((call(text), None))
            except Exception as e:  # noqa: BLE001 - raised again below
                said.put((None, e))

        threading.Thread(target=ask, daemon=True).start()
        try:
            answer, error = said.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer in {seconds} s") from None
        if error is not None:
            raise error
        return answer

    return run


def generate(prompts: DataFrame, provider: Callable[[], Provider], id_col: str = "id", prompt_col: str = "prompt", partitions: int = 8, per_minute: float = 0,
             retries: int = 3, wait: float = 0.0, timeout: float = 0, marks: bool = False, calls: int = 1) -> DataFrame:
    """(id, response, failed, attempts) of an external model. `provider` is called once per task and makes the call.

    Concurrency is the number of partitions, as far as the cluster has slots, times `calls` of a task at the same time
    (more than one: the call must be safe for threads), so that one that hangs doesn't hold up the others. Each task has
    an equal part of the rate limit; calls that fail or take more than `timeout` seconds are tried again with growing
    waits inside the task. A failed one is a row (failed, null response), so it can be run again; marks: its response is
    (TIMEOUT) or (ERROR: ...)."""
    at_once = min(partitions, prompts.sparkSession.sparkContext.defaultParallelism)
    pause = 60.0 * at_once / per_minute if per_minute else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, due, turn = within(provider(), timeout), 0.0, threading.Lock()

        def paced() -> None:
            nonlocal due
            with turn:
                if (left := due - time.monotonic()) > 0:
                    time.sleep(left)
                due = time.monotonic() + pause

        def ask(text: str) -> tuple:
            answer, tries, mark = None, 0, None
            while answer is None and tries < retries:
                paced()
                tries += 1
                try:
                    answer = call(text)
                except TimeoutError:
                    mark = "(TIMEOUT)"
                    time.sleep(wait * tries)
                except Exception as e:  # noqa: BLE001 - a provider may fail in any way; the row records it
                    mark = f"(ERROR: {e})"
                    time.sleep(wait * tries)
            return mark if answer is None and marks else answer, answer is None, tries

        with ThreadPoolExecutor(calls) as pool:
            for pdf in batches:
                said = map(ask, pdf["p"]) if calls == 1 else pool.map(ask, pdf["p"])
                yield pd.DataFrame([(i, *r) for i, r in zip(pdf["i"], said)], columns=["i", "response", "failed", "attempts"])

    kind = dict(prompts.dtypes)[id_col]
    out = prompts.select(F.col(id_col).alias("i"), F.col(prompt_col).alias("p")).repartition(partitions).mapInPandas(run, f"i {kind}, response string, failed boolean, attempts int")
    return out.withColumnRenamed("i", id_col)


SCORE_PROMPT = "Score from 0 to 5 how correct, complete and useful the answer is. Reply with JSON alone: {\"score\": n, \"reason\": \"...\"}.\n\nQUESTION:\n%s\n\nANSWER:\n%s"


def parsed_score(said: str) -> tuple[int, str]:
    """(score, reason) of a scorer's reply, with or without reasoning before and a fence around it. The score may be a
    number or a string of one, and is cut to an integer; a missing one is 0. Raises ValueError for anything else."""
    text = said.split("</think>", 1)[-1].strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("no object")
    score = found.get("score", 0)
    if isinstance(score, (list, dict)) or score is None:
        raise ValueError("no number")
    return int(score), str(found.get("reason", ""))


def llm_scores(examples: DataFrame, provider: Callable[[], Provider], id_col: str = "id", question: str = "question", answer: str = "answer", template: str = SCORE_PROMPT, **options) -> DataFrame:
    """(id, score, reason, failed) of an external scorer, asked by generate() with these options. A reply that can't be
    parsed is asked for again; after the last try the row has failed and no score, so that a score filter keeps it."""

    def asking() -> Provider:
        call = provider()

        def ask(prompt: str) -> str:
            score, reason = parsed_score(call(prompt))
            return json.dumps({"score": score, "reason": reason})

        return ask

    parts = template.split("%s")
    prompt = F.concat(F.lit(parts[0]), orempty(F.col(question)), F.lit(parts[1]), orempty(F.col(answer)), F.lit(parts[2]))
    said = generate(examples.select(id_col, prompt.alias("prompt")), asking, id_col, **options)
    r = F.from_json("response", "score int, reason string")
    return said.select(id_col, r["score"].alias("score"), r["reason"].alias("reason"), "failed")


def embeddings(df: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(id, embedding): unit vectors of an external model, which is made once a task and takes `batch` texts at a time.
    Null texts count as ''; a vector of zeros stays."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            said = [t if isinstance(t, str) else "" for t in texts]
            out = np.concatenate([np.asarray(encode(said[a : a + batch]), np.float64) for a in range(0, len(said), batch)]) if said else np.zeros((0, 1))
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list((out / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return df.select(F.col(id_col), F.pandas_udf(run, "array<float>")(F.col(text_col)).alias("embedding"))

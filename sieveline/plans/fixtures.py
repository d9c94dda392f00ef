"""The driver's tables as the inputs of the operators, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.generation import chat
from ..sources.files import spread, table

SYSTEM = "You answer from the given guidelines."


def chunks(spark, sf_dir: str) -> DataFrame:
    """documents as flat chunks: category is the language, German ones have a society."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("id"), "text", "source", F.when(F.col("lang") == "de", "SOC").otherwise("").alias("society"), F.col("lang").alias("category"), F.lit("").alias("section_path"))


CHUNKS = "ch AS (SELECT doc_id AS id, text, source, CASE WHEN lang = 'de' THEN 'SOC' ELSE '' END AS society, lang AS category, '' AS section_path FROM documents)"


def examples(spark, sf_dir: str) -> DataFrame:
    """conversations as chat examples: every user turn with the assistant turn that follows at once. Without one there
    are only two messages."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w)).where("role = 'user'")
    answer = F.when(F.col("_r") == "assistant", F.col("_t"))
    full = chat(SYSTEM, F.col("text"), answer)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 8 == 0, "minor").otherwise("major").alias("source"),
                    F.when(answer.isNotNull(), full).otherwise(F.slice(full, 1, 2)).alias("messages"), F.col("text").alias("question"), answer.alias("answer"))


EXAMPLES = """cv AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
ex AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 8 = 0 THEN 'minor' ELSE 'major' END AS source, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM cv WHERE role = 'user')"""


def vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("length"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("source"))


#: A small table of judged responses: 6 cases x 3 tiers, two raters.
SCORES = [(c, t, ("simple", "moderate", "complex")[c % 3], ("base", "rag", "ft")["ABC".index(t)], float((c * 7 + k * 5) % 6), float((c * 5 + k * 3 + 2) % 6), float((c * 3 + k * 2 + 1) % 6), float((c + k * 4 + 3) % 6), 0.5 * k, 10.0 + c * k, 100 + 10 * c + k)
          for c in range(1, 7) for k, t in enumerate("ABC")]
SCORE_COLS = "case_id int, tier string, complexity string, strategy string, dx double, guide double, complete double, utility double, cost_usd double, latency double, tokens int"
RATINGS = [(c, t, r, float((c * 3 + "ABC".index(t) * 2 + r * (c % 2)) % 6)) for c in range(1, 7) for t in "ABC" for r in (1, 2)]
RATING_COLS = "case_id int, tier string, rater int, score double"


def values(rows: list[tuple], cols: str) -> str:
    def lit(v: object) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)

    names = ", ".join(c.strip().split()[0] for c in cols.split(","))
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


SCORES_SQL = f"sc AS (SELECT *, dx * 0.25 + guide * 0.30 + complete * 0.25 + utility * 0.20 AS composite FROM {values(SCORES, SCORE_COLS)})"
RATINGS_SQL = f"rt AS (SELECT * FROM {values(RATINGS, RATING_COLS)})"

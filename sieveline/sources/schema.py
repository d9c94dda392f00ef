"""Schemas of what is read; inference would take a second pass and hide malformed rows."""

from pyspark.sql import types as T


def _s(*names: str, kind=T.StringType) -> list[T.StructField]:
    return [T.StructField(n, kind()) for n in names]


MESSAGES = T.ArrayType(T.StructType(_s("role", "content")))
EXAMPLE = T.StructType([T.StructField("messages", MESSAGES)])
CHUNK = T.StructType(_s("id", "text", "source", "society", "category", "section_path", "stratum"))
RAW_CHUNK = T.StructType([*_s("id", "text"), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
ENVELOPE = T.StructType([*_s("version"), *_s("total_source_chunks", "sampled_count", kind=T.LongType),
                         T.StructField("strata_config", T.MapType(T.StringType(), T.StructType([T.StructField("target_pct", T.DoubleType()), *_s("description")]))),
                         T.StructField("chunks", T.ArrayType(CHUNK))])
PAIRS = T.ArrayType(T.StructType(_s("type", "question", "answer", "tipo", "pregunta", "respuesta")))
SCORE = T.StructType([T.StructField("index", T.LongType()), T.StructField("score", T.IntegerType()), *_s("reason", "stratum")])

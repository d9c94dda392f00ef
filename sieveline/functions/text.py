"""Text predicates and features as Column expressions, Unicode-aware like the definitions they follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST = r"(?mdU)^\s*(?:[-•*]|\d+[.)])\s"
HEADERS = r"(?mdU)^(?:#{1,3}\s|[ÁÉÍÓÚA-Z][\sñáéíóúÁÉÍÓÚa-zA-Z]{3,}:\s*$)"
DOSING = r"(?iuU)\d+\s*mg"
EVIDENCE = r"(?iuU)" + "|".join((r"clase\s+[iv]+", r"evidencia\s+\d", r"grado\s+de\s+recomendaci", r"nivel\s+de\s+evidencia"))
CITATION = r"(?iuU)" + "|".join((r"fase\s+[iv123]+", "metaan[aá]lisis", r"et\s+al", "ensayo", "estudio", "asco", "esmo", "nccn"))


#: White space of any kind, separators of information included.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(SPACES))


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it: lambda variables are bound, expressions are
    evaluated anew at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def alpha_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))


def contains_none(text: Column, literals) -> Column:
    return ~once(F.lower(text), lambda t: F.exists(F.array(*[F.lit(x) for x in literals]), lambda x: F.contains(t, x)))


def is_quality_chunk(text: Column, min_chars: int, min_alpha: float, boilerplate) -> Column:
    """Cheap tests first: length, blocklist, share of letters."""
    return (F.length(strip(text)) >= min_chars) & contains_none(text, boilerplate) & (alpha_ratio(text) >= min_alpha)


def is_evasive(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu)(?:{pattern})")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def strip_reasoning(text: Column) -> Column:
    """What follows the first </think>; of a fenced text, what is between its first line and the last fence."""
    said = strip(F.regexp_replace(text, r"(?s)^.*?</think>", ""))
    inner = F.regexp_replace(F.regexp_replace(said, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(said.startswith("```"), strip(inner)).otherwise(said)


def echo_stripped(output: Column, marker: str) -> Column:
    return strip(F.substring_index(output, marker, -1))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern).cast("int")


def features(question: Column, answer: Column) -> dict[str, Column]:
    """Length, vocabulary and structure features of an answered question; 0 where a division has no meaning."""
    w = words(answer)
    return {
        "answer_len": F.length(answer), "question_len": F.length(question),
        "ratio_aq": F.coalesce(F.try_divide(F.length(answer), F.length(question)), F.lit(0.0)),
        "ttr": F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)),
        "word_count": F.size(w), "sentence_count": F.regexp_count(answer, F.lit("[.!?]+")),
        "has_list": has(answer, LIST), "has_headers": has(answer, HEADERS), "has_dosing": has(answer, DOSING),
        "has_evidence": has(answer, EVIDENCE), "has_citation": has(answer, CITATION),
    }


def seeded(seed: int, *keys: Column) -> Column:
    """A sort key that any engine can repeat: md5 of 'seed:key'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def prefix_key(text: Column, n: int) -> Column:
    return F.md5(F.encode(F.substring(text, 1, n), "UTF-8"))


def overlap_chunks(text: Column, size: int = 500, step: int = 400) -> Column:
    """array<string> of pieces of `size` characters that start every `step`; an empty text has one empty piece."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step)), lambda i: F.substring(text, i, F.lit(size)))


def content_id(*parts: Column) -> Column:
    """The same id for the same content: md5 of the parts with ':' between; nulls are left out."""
    return F.md5(F.concat_ws(":", *parts))


def letter_runs(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def synonyms(pairs: DataFrame) -> DataFrame:
    """(a, b) of each pair of names in both directions, once."""
    first, second = pairs.columns
    return pairs.toDF("a", "b").union(pairs.select(second, first).toDF("a", "b")).distinct()

"""Keyword classifiers: substring scores, first of the best in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Classifier
from .text import once


def _score(text: Column, words, weight: int = 1) -> Column:
    if not words:
        return F.lit(0)
    # One array of literals, not a chain of tests: the generated method stays small.
    hits = F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w)))
    return hits * weight if weight != 1 else hits


def stratum(c: Classifier, text: Column, source: Column | None = None, society: Column | None = None, category: Column | None = None) -> Column:
    """`text` and `source` must be lower case. A stratum without words never wins outright, but may tie at 0."""

    def scores(t: Column) -> Column:
        return F.array(*[_score(t, s.keywords) + (_score(source, s.sources, 2) if source is not None and s.sources else F.lit(0)) for s in c.strata])

    def first_of_best(s: Column) -> Column:
        best = F.array_max(s)
        out = F.when(best < 1, F.lit(c.fallback))
        for k, x in enumerate(c.strata):
            out = out.when(s[k] == best, F.lit(x.name))
        return out

    out = once(text, lambda t: once(scores(t), first_of_best))
    if c.society is not None and society is not None:
        out = F.when((society == c.society) | (category == c.category), F.lit(c.boosted)).otherwise(out)
    return out


def chunk_text(source: Column, section: Column, text: Column) -> Column:
    """Sampler variant: the text is lowered, then cut to 500 characters."""
    return F.concat(F.lower(source), F.lit(" "), F.lower(section), F.lit(" "), F.substring(F.lower(text), 1, 500))


def extract_text(source: Column, section: Column, text: Column) -> Column:
    """Extractor variant: cut first, then lowered with the rest."""
    return F.lower(F.concat(source, F.lit(" "), section, F.lit(" "), F.substring(text, 1, 500)))

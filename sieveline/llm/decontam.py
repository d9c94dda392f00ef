"""Benchmark decontamination by pigeonhole edit matching."""

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, fresh

#: Production parameters: edits allowed per character of an item, the least length of an item that can be told from
#: chance anywhere in a text (a letter of a script without spaces counts WIDE), and how many characters of items one
#: automaton holds, some 60 bytes each (larger benchmarks take several passes).
ERROR_RATE = 0.08
MIN_ITEM_CHARS, WIDE = 24, 3
BLOCK_CHARS = 4_000_000
WORDS = re.compile(r"\w+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def match_type(item_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_type), T.StructField("distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType())]))


def normalise(text: str) -> str:
    """Lower-case words with single spaces between: case, punctuation and layout don't count as edits."""
    return " ".join(WORDS.findall(text.lower()))


def weight(item: str) -> int:
    """Length of a normalised item; a letter of a script without spaces says as much as WIDE others."""
    return len(item) + (WIDE - 1) * len(UNSPACED.findall(item))


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of about equal length for a budget of k = floor(rate * length) edits; k edits
    touch at most k of them, so an occurrence within the budget holds one unchanged."""
    k = int(rate * len(item))
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int) -> int | None:
    """Least edit distance of pattern to any substring of text, or None beyond budget. Bit-parallel: one
    arbitrary-width integer holds a column of the matrix."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may start anywhere: row 0 stays 0
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best if best <= budget else None


class Matcher:
    """Items with their pieces in one automaton. Items of less weight than min_chars stand in a table: they are found
    where they make up a whole line of a text, or all of it, without edits."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE, min_chars: int = 0):
        import ahocorasick

        self.lines: dict[str, list[object]] = {}
        for i, t in items:
            if weight(t) < min_chars:
                self.lines.setdefault(t, []).append(i)
        self.items = items = [(i, t) for i, t in items if weight(t) >= min_chars]
        self.budget = [int(rate * len(t)) for _, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(items):
            for at, piece in pieces(t, rate):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, (len(piece), spots))
        if where:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item_id, distance, item_chars), the least distance of each item that occurs."""
        if not text:
            return []
        t = normalise(text)
        out = []
        if self.lines:
            for line in {t, *map(normalise, text.splitlines())} & self.lines.keys():
                out += [(i, 0, len(line)) for i in self.lines[line]]
        if not self.items:
            return sorted(out, key=repr)
        windows: dict[int, set[int]] = {}
        for end, (length, spots) in self.automaton.iter(t):
            for n, at in spots:
                windows.setdefault(n, set()).add(end + 1 - length - at)
        for n, starts in windows.items():
            item_id, item = self.items[n]
            k, best = self.budget[n], None
            if any(s >= 0 and t.startswith(item, s) for s in starts):
                best = 0
            else:
                spans: list[list[int]] = []  # overlapping windows are one
                for s in sorted(starts):
                    a, b = max(0, s - k), min(len(t), s + len(item) + k)
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    d = myers(item, t[a:b], k)
                    if d is not None and (best is None or d < best):
                        best = d
            if best is not None:
                out.append((item_id, best, len(item)))
        return sorted(out, key=repr)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items that have words, normalised, in blocks of bounded size that stream through the driver."""
    block, chars = [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        t = normalise(r["t"])
        if not t:
            continue
        if block and chars + len(t) > block_chars:
            yield block
            block, chars = [], 0
        block.append((r["i"], t))
        chars += len(t)
    if block:
        yield block


#: The matcher that this process has built, by block: tasks that follow find it again, and the one before goes.
_BUILT: dict[str, Matcher] = {}


def _matches(spark, items: list[tuple[object, str]], rate: float, min_chars: int, item_type: T.DataType):
    shared, name = spark.sparkContext.broadcast((items, rate, min_chars)), uuid.uuid4().hex

    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Matcher(*shared.value)
        found = _BUILT[name]
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(("item_id", "distance", "item_chars"), x)) for x in found(t)])

    return F.pandas_udf(match, match_type(item_type))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE,
                  min_chars: int = MIN_ITEM_CHARS, block_chars: int = BLOCK_CHARS, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_chars) for each document row and benchmark item that occurs in its text
    within floor(rate * length) edits.

    Lengths and edits are of normalised text. Items of less than min_chars (letters of scripts without spaces count
    WIDE) occur by chance within texts: they count where they are a whole line or text, without edits. Null or empty
    texts and items match nothing; an item that occurs several times gives its least distance; repeated rows and
    repeated items each give rows. Ids are of any type. Whole texts are searched. Empty tables give no rows; extra
    columns are ignored. A benchmark beyond block_chars is searched in several passes over docs, each with a bounded
    automaton, built once a process."""
    out, item_type = None, benchmark.schema[item_id_col].dataType
    for block in item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        match = _matches(docs.sparkSession, block, rate, min_chars, item_type)
        hits = docs.select(F.col(id_col).alias("doc_id"), F.explode(match(F.col(text_col))).alias("m")).select("doc_id", "m.*")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.select(F.col(id_col).alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", item_type), ("distance", "int"), ("item_chars", "int"))]).where("false")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_ITEM_CHARS,
                  block_chars: int = BLOCK_CHARS, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs`, all columns, less the rows that hold a benchmark item; cases as in contamination(). Row by row: no
    shuffle and no join, where the benchmark fits one automaton; else the texts that hold an item are found in one
    pass a block, and go by their hash (128 bits)."""
    item_type, blocks = benchmark.schema[item_id_col].dataType, item_blocks(benchmark, item_id_col, item_text_col, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.where(F.size(_matches(docs.sparkSession, first, rate, min_chars, item_type)(docs[text_col])) == 0)
    (name,) = fresh(docs, "text")
    hits = None
    for block in (first, second, *blocks):
        match = _matches(docs.sparkSession, block, rate, min_chars, item_type)
        found = docs.where(F.size(match(docs[text_col])) > 0).select(F.md5(docs[text_col]).alias(name))
        hits = found if hits is None else hits.unionByName(found)
    hits = bounded(cut(hits.distinct()))
    return docs.join(hits, F.md5(docs[text_col]) == hits[name], "left_anti")

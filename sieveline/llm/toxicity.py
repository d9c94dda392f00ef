"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with block-max inverted indexes."""

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, document_counts
from .quality import sample_labelled
from .simhash import BUDGET, WIDE_BUDGET, Components, fingerprint

#: Production parameters. MAX_PER_CLASS bounds the labelled examples (by hash of id). All their terms count; a term
#: whose document counts differ between the classes weighs more, by the root of its log-likelihood ratio, and none
#: less than its TF-IDF. NEIGHBOURS vote; a document is toxic from THRESHOLD on, a calibrated probability.
MAX_PER_CLASS = 4000
NEIGHBOURS, THRESHOLD = 15, 0.5
PRIOR = 10.0
#: Examples of a block; terms with a weight for every example; texts that are searched together.
BLOCK, DENSE, QUERIES = 32, 512, 64
#: Examples are ordered by so many of their terms of most weight.
LEADING = 8
EVIDENCE = 3
WORD = re.compile(r"\w+")


def result(id_type: T.DataType) -> T.StructType:
    found = T.StructType([T.StructField("doc_id", id_type), T.StructField("toxic", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    return T.StructType([T.StructField("score", T.DoubleType()), T.StructField("vote", T.DoubleType()), T.StructField("evidence", T.ArrayType(found))])


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashes(terms) -> np.ndarray:
    """64-bit hashes of terms, which stand for them: a model of hundreds of thousands of terms holds no strings."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(t) for t in terms], np.uint64).view(np.int64)


def number(terms: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted terms, whether they are there) of hashes."""
    if not len(terms):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    return at, terms[at] == found


def arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a dict, or of such a pair."""
    if isinstance(vector, dict):
        return np.fromiter(vector, np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))
    return vector


class BlockMaxIndex:
    """Postings by term, and blocks of `block` examples with the largest weight of each common term. The `dense` terms
    that most examples hold are common: they have a weight for every example, so that a block's part of their sums is a
    matrix product. Vectors are dicts or pairs of arrays; weights are not negative."""

    def __init__(self, vectors: list, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        pairs = [arrays(v) for v in vectors]
        docs = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in pairs])
        terms = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in pairs]])
        weights = np.concatenate([np.zeros(0), *[w for _, w in pairs]])
        head = np.sort(np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[:dense])
        self.slot = np.full(n_terms, -1, np.int32)
        self.slot[head] = np.arange(len(head))
        common = self.slot[terms] >= 0
        rows = np.zeros((self.blocks * block, len(head)))
        rows[docs[common], self.slot[terms[common]]] = weights[common]
        self.dense = rows.reshape(self.blocks, block, len(head))
        self.max = self.dense.max(axis=1)
        terms, docs, weights = (x[~common] for x in (terms, docs, weights))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order].astype(np.int64), weights[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.scored = 0

    def search(self, query, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest of positive cosine, with all that tie with the last, nearest first,
        ties by number."""
        return self.search_many([query], k, [skip])[0]

    def search_many(self, queries: list, k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of each query. The postings of its rare terms are summed; with the block maxima of its common terms
        they bound each block. Blocks of highest bound are scored first, then those whose bound reaches the k-th best.
        skip: an example that isn't to be found, by query."""
        if not self.n or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        n = len(queries)
        common, score = np.zeros((n, self.dense.shape[2])), np.zeros((n, self.blocks * self.block))
        for i, (terms, q) in enumerate(map(arrays, queries)):
            slot = self.slot[terms]
            held = slot >= 0
            common[i, slot[held]] = q[held]
            terms, q = terms[~held], q[~held]
            start, size = self.first[terms], self.first[terms + 1] - self.first[terms]
            if len(size) and (total := int(size.sum())):
                at = np.arange(total)
                at += np.repeat(start - (np.cumsum(size) - size), size)
                w = self.weights.take(at)
                w *= np.repeat(q, size)
                score[i] = np.bincount(self.docs.take(at), w, score.shape[1])
        score = score.reshape(n, self.blocks, self.block)
        bound = common @ self.max.T + score.max(axis=2)
        best = np.argsort(-bound, axis=1, kind="stable")[:, : 6 + k // self.block]
        seen = np.zeros((n, self.blocks), bool)
        np.put_along_axis(seen, best, True, axis=1)

        def add(blocks: np.ndarray) -> None:
            for b in np.flatnonzero(blocks.any(axis=0)):
                rows = np.flatnonzero(blocks[:, b])
                score[rows, b] += common[rows] @ self.dense[b].T
            for i, x in enumerate(skip or ()):
                if x >= 0:
                    score[i, x // self.block, x % self.block] = 0
            self.scored += int(blocks.sum())

        add(seen)
        some = np.take_along_axis(score, best[:, :, None], axis=1).reshape(n, -1)
        low = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] if some.shape[1] > k else np.zeros(n)
        more = ~seen & (bound > 0) & (bound >= low[:, None] - 2e-6)
        add(more)
        seen |= more
        out = []
        for i in range(n):
            at = np.flatnonzero(seen[i])
            s = np.round(score[i, at].ravel(), 6)
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else 0.0
            found = np.flatnonzero((s > 0) & (s >= least))
            ids = at[found // self.block] * self.block + found % self.block
            order = np.lexsort((ids, -s[found]))
            out.append((ids[order], s[found][order]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (upper edges of x, probabilities), a step function that never falls."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # right edge, weighted mean, weight
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        if pools and pools[-1][0] == xi:
            p = pools[-1]
            pools[-1] = [xi, (p[1] * p[2] + yi * wi) / (p[2] + wi), p[2] + wi]
        else:
            pools.append([xi, yi, wi])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1] and pools[-1][0] == xi:
            b, a = pools.pop(), pools.pop()
            pools.append([b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]])
    # A later equal x may reopen a pool; one more sweep settles it.
    out: list[list[float]] = []
    for p in pools:
        out.append(list(p))
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            b, a = out.pop(), out.pop()
            out.append([b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]])
    return np.array([p[0] for p in out]), np.array([p[1] for p in out])


class Model:
    """Sorted hashes of terms and their weights (idf and class evidence); vectors: (terms, weights) of each example;
    id_type: that of their ids."""

    def __init__(self, ids, labels, terms, weight, vectors, class_weight, id_type: T.DataType | None = None):
        # Examples of like language and leading terms share blocks, whose bounds are then tight.
        side = _sides(vectors, len(terms))
        order = sorted(range(len(ids)), key=lambda i: (side[i], vectors[i][0][np.lexsort((vectors[i][0], -vectors[i][1]))[:LEADING]].tolist(), ids[i]))
        ids, labels, vectors = ([x[i] for i in order] for x in (ids, labels, vectors))
        self.ids, self.labels, self.weight, self.id_type = ids, np.asarray(labels, np.float64), weight, id_type or T.LongType()
        self.rank = np.argsort(np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64))
        self.terms = np.asarray(terms, np.int64)
        self.index = BlockMaxIndex(vectors, len(terms))
        sample = np.where(self.labels > 0, class_weight[1], class_weight[0])
        raw = np.array([self._vote(*x) for a in range(0, len(ids), QUERIES) for x in self.index.search_many(vectors[a : a + QUERIES], NEIGHBOURS, list(range(a, min(len(ids), a + QUERIES))))])
        self.edges, self.prob = isotonic(raw, self.labels, sample) if len(raw) else (np.zeros(0), np.zeros(0))

    def _vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """Toxic share of the neighbours, each weighted by 1 / (distance + 0.05), against PRIOR votes for clean, so
        that far neighbours alone decide little; 0 without neighbours."""
        if not len(ids):
            return 0.0
        w = 1 / (1 - sims + 0.05)
        return round(float((w * self.labels[ids]).sum() / (w.sum() + PRIOR)), 6)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(words(text))
        at, known = number(self.terms, hashes(counts))
        return weigh(at[known], np.fromiter(counts.values(), np.float64, len(counts))[known], self.weight)

    def __call__(self, texts: list[str | None]) -> list[tuple[float, float, list]]:
        """(score, vote, evidence) of each text; ties in the evidence by id."""
        out = []
        for a in range(0, len(texts), QUERIES):
            for ids, sims in self.index.search_many([self.vector(t or "") for t in texts[a : a + QUERIES]], NEIGHBOURS):
                vote = self._vote(ids, sims)
                k = min(int(np.searchsorted(self.edges, vote - 1e-9)), len(self.prob) - 1)
                first = np.lexsort((self.rank[ids], -sims))[:EVIDENCE]
                out.append((float(self.prob[k]) if len(self.prob) else 0.0, vote, [{"doc_id": self.ids[ids[j]], "toxic": int(self.labels[ids[j]]), "similarity": float(sims[j])} for j in first]))
        return out


def _sides(vectors: list, n_terms: int) -> np.ndarray:
    """Which sides of the three leading axes of their commonest terms the vectors lie on: a number, language above
    all."""
    held = BlockMaxIndex(vectors, n_terms)
    rows = held.dense.reshape(held.blocks * held.block, held.dense.shape[2])[: held.n]
    if not rows.size:
        return np.zeros(len(vectors), np.int64)
    rows = rows - rows.mean(axis=0)
    axes = np.linalg.eigh(rows.T @ rows)[1][:, ::-1][:, :3]
    return (rows @ axes > 0) @ (1 << np.arange(axes.shape[1]))


def weigh(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, (1 + log tf) * weight), of unit length."""
    v = (1 + np.log(counts)) * weight[terms]
    norm = math.sqrt(v @ v)
    return terms, v / norm if norm else v


@F.pandas_udf(T.MapType(T.LongType(), T.IntegerType()))
def word_counts(texts: pd.Series) -> pd.Series:
    """Counts of words by their hash."""

    def of(text: str | None) -> dict[int, int]:
        counts = Counter(words(text)) if text else Counter()
        return dict(zip(hashes(counts).tolist(), counts.values()))

    return texts.map(of)


def _first_copies(rows: DataFrame) -> DataFrame:
    """ids of the examples less near copies, which would make any word of theirs look significant. The examples are
    bounded, so their fingerprints are compared on the driver."""
    got = sorted(rows.select("id", "fp").collect())
    prints = np.array([np.frombuffer(r["fp"], ">u8") for r in got], np.uint64).reshape(-1, 4)
    groups = Components(len(got))
    for i in range(len(got) - 1):
        d = np.bitwise_count(prints[i + 1 :] ^ prints[i]).astype(np.int64)
        j = np.flatnonzero((d[:, :2].sum(1) <= BUDGET) & (d.sum(1) <= WIDE_BUDGET)) + i + 1
        if len(j):
            groups.add(np.full(len(j), i), j)
    first = [(r["id"],) for k, r in enumerate(got) if groups.label[k] == k]
    return rows.sparkSession.createDataFrame(first, rows.select("id").schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on a bounded labelled sample; document frequencies come from all of docs. Calibration weighs the sample's
    classes up to their real numbers."""
    rows = cut(sample_labelled(docs, labels, label_col, id_col, text_col, per_class).select("id", "label", word_counts("text").alias("terms"), fingerprint("text").alias("fp")))
    rows = rows.join(F.broadcast(_first_copies(rows)), "id", "left_semi")
    # Terms by class are counted by Spark; the driver sees one row a term.
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model([], [], np.zeros(0, np.int64), np.zeros(0), [], (1.0, 1.0), rows.schema["id"].dataType)
    df = rows.select("label", F.explode(F.map_keys("terms")).alias("t")).groupBy("t").agg(F.sum("label").cast("double").alias("x"), F.sum(1 - F.col("label")).cast("double").alias("y")).toArrow()
    order = np.argsort(df["t"].to_numpy(), kind="stable")
    terms, x, y = (df[c].to_numpy()[order] for c in "txy")
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def numberer():
        terms = shared.value

        def of(texts: list[str]) -> np.ndarray:
            at, known = number(terms, hashes(chain.from_iterable(set(words(t)) for t in texts)))
            return at[known]

        return of

    total, seen = document_counts(docs, text_col, len(terms), numberer)
    weight = np.log(1 + total / np.maximum(1, seen)) * evidence(x, y, pos, neg)
    got = rows.select("id", "label", _numbered(shared)("terms").alias("r")).select("id", "label", "r.*").toArrow().sort_by("id")
    vectors = [weigh(np.array(t.values, np.int64), np.array(c.values, np.float64), weight) for t, c in zip(got["at"], got["n"])]
    ids, labelled = got["id"].to_pylist(), got["label"].to_pylist()
    real = {r["l"]: r["n"] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return Model(ids, labelled, terms, weight, vectors, (real[0] / neg, real[1] / pos), rows.schema["id"].dataType)


def evidence(x: np.ndarray, y: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Root of the log-likelihood ratio of terms that x of pos and y of neg examples hold, 1 at least: words that say
    nothing of the class still count, as by TF-IDF alone."""
    size, seen = pos + neg, x + y

    def part(observed, expected):
        """observed * ln(observed / expected), 0 for an empty cell."""
        return observed * np.log(np.divide(observed, expected, out=np.ones(len(seen)), where=observed > 0))

    g = 2 * (part(x, seen * pos / size) + part(y, seen * neg / size) + part(pos - x, (size - seen) * pos / size) + part(neg - y, (size - seen) * neg / size))
    return np.sqrt(np.maximum(g, 1))


def _numbered(shared):
    def run(maps: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in maps:
            pairs = [dict(m) for m in batch]
            yield pd.DataFrame({"at": [np.searchsorted(shared.value, np.fromiter(p, np.int64, len(p))).tolist() for p in pairs], "n": [list(p.values()) for p in pairs]})

    return F.pandas_udf(run, T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, vote, evidence) of every row: calibrated probability, distance-weighted vote and the nearest
    labelled examples.

    Null and empty texts, and any without a term of the model, have vote 0, the score of such examples and no
    evidence. Ties with the last neighbour vote too. Repeated rows score alike; whole texts count. Without labels of
    both classes all scores are 0. An empty table gives no rows; extra columns are ignored. Row by row: no
    shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame(m([t if isinstance(t, str) else None for t in texts]), columns=["score", "vote", "evidence"])

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, result(model.id_type))(F.col(text_col)).alias("r")).select("doc_id", "r.*")

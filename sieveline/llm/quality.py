"""Quality classifier: similarity-weighted vote of the nearest labelled latent-semantic vectors."""

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, document_counts, key_hash

#: Production parameters. MAX_PER_CLASS bounds the labelled rows that the model is fitted on, taken by hash of
#: their id, and with them the vocabulary: all terms that two of them share. DIMS axes are found by ITERATIONS of a
#: block of DIMS + SPARE vectors; NEIGHBOURS vote; a document is kept from THRESHOLD on.
MAX_PER_CLASS = 2000
DIMS, SPARE, ITERATIONS = 48, 16, 15
NEIGHBOURS, THRESHOLD = 15, 0.5
BLOCK = 256

LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")


def _kind(word: str) -> str:
    return "a" if word.islower() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"


def shape(token: str) -> str:
    """Runs of capitals to A, of other letters to a, capitalised words to Aa, digits to 9; the rest as it is."""
    core = token.rstrip(".,;:!?%&*#$")
    if core.isalpha():
        return _kind(core) + token[len(core) :]
    return DIGITS.sub("9", LETTERS.sub(lambda m: _kind(m.group()), token))


def terms(text: str) -> Counter:
    """Counts of word terms, of shape terms, and of tokens that repeat the one before. Shapes and repeats carry the
    form of a text, words its language and topic."""
    tokens = text.split()
    found: Counter = Counter()
    for t, n in Counter(tokens).items():
        found["s:" + shape(t)] += n
        found["w:" + t.lower().strip(".,;:!?")] += n
    again = sum(map(eq, tokens, islice(tokens, 1, None)))
    if again:
        found["r:"] = again
    return found


#: A task keeps at hand so many tokens whose word is in the vocabulary, of at most so many characters; texts of a block
#: are taken apart together.
KNOWN, KNOWN_CHARS = 150_000, 40


class Known(dict):
    """token -> (shape + 1) * (size + 1) + word + 1, of its vocabulary rows, -1 for none. Tokens of words that aren't in
    the vocabulary are taken apart each time."""

    def __init__(self, shapes: dict[str, int], words: dict[str, int], size: int):
        self.shapes, self.words, self.step = shapes, words, size + 1
        self.plain = (shapes.get("a", -1) + 1) * self.step

    def __missing__(self, t: str) -> int:
        if t.islower() and t.isalpha():  # by far the commonest
            w = self.words.get(t, -1)
            if w < 0:
                return self.plain
            code = self.plain + w + 1
        else:
            w = self.words.get(t.lower().strip(".,;:!?"), -1)
            code = (self.shapes.get(shape(t), -1) + 1) * self.step + w + 1
        if w >= 0 and len(t) <= KNOWN_CHARS:
            self[t] = code
        return code


class Rows:
    """Terms of texts by their row in the vocabulary, which is given as one text, a line a term; many texts at once."""

    def __init__(self, vocabulary: str):
        terms = vocabulary.split("\n") if vocabulary else []
        self.size = max(1, len(terms))
        self.again = next((r for r, t in enumerate(terms) if t == "r:"), None)
        self.shapes, self.words = ({t[2:]: r for r, t in enumerate(terms) if t.startswith(kind)} for kind in ("s:", "w:"))
        self.known = Known(self.shapes, self.words, self.size)

    def _found(self, tokens: list) -> np.ndarray:
        """Sorted text * size + row of every term of the tokens of each text."""
        if len(self.known) > KNOWN:
            self.known = Known(self.shapes, self.words, self.size)
        n = np.array([len(t) for t in tokens], np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(tokens)), np.int64, n.sum())
        rows, text = np.concatenate(np.divmod(codes, self.size + 1)) - 1, np.repeat(np.arange(len(tokens)) * self.size, n)
        found = (np.concatenate([text, text]) + rows)[rows >= 0]
        found.sort()
        return found

    def _again(self, tokens: list[list[str]]) -> np.ndarray:
        """How often a token of each text repeats the one before."""
        return np.array([sum(map(eq, t, islice(t, 1, None))) for t in tokens], np.int64) * (self.again is not None)

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, counts) of each text."""
        tokens = [t.split() if t else [] for t in texts]
        found = self._found(tokens)
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(found)])
        text, rows = np.divmod(found[first], self.size)
        at, again = np.searchsorted(text, np.arange(len(texts) + 1)), self._again(tokens)
        return [(np.append(rows[a:b], self.again), np.append(counts[a:b], k)) if k else (rows[a:b], counts[a:b]) for a, b, k in zip(at, at[1:], again)]

    def distinct(self, texts: list[str]) -> np.ndarray:
        """The rows of each text, each once, one text after the other."""
        tokens = [t.split() for t in texts]
        found = self._found([set(t) for t in tokens])
        rows = found[np.r_[True, found[1:] != found[:-1]]] % self.size if len(found) else found
        return np.append(rows, np.full(np.count_nonzero(self._again(tokens)), self.again or 0))


#: The lookup that this process has built, by name: tasks that follow find it again, and the one before goes.
_BUILT: dict[str, Rows] = {}


def rows_of(name: str, vocabulary: str) -> Rows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Rows(vocabulary)
    return _BUILT[name]


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Model:
    """vocabulary: the terms by row of `projection` (idf applied); vectors, labels, weights: the labelled examples."""

    def __init__(self, vocabulary: list[str], projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.terms, self.projection, self.vectors, self.labels, self.weights = "\n".join(vocabulary), projection, vectors, labels, weights
        self.name = uuid.uuid4().hex

    @property
    def vocabulary(self) -> list[str]:
        return self.terms.split("\n") if self.terms else []

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        rows = rows_of(self.name, self.terms)
        for a in range(0, len(texts), BLOCK):
            for i, (at, n) in enumerate(rows(texts[a : a + BLOCK]), a):
                if len(at):
                    out[i] = (1 + np.log(n.astype(np.float32))) @ self.projection[at]
        return unit(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.vote(self.embed(texts))

    def vote(self, x: np.ndarray, leave_out: bool = False) -> np.ndarray:
        """Share of class 1 among the NEIGHBOURS nearest by exact cosine, each weighted by cosine^4 and by its class
        weight; ties with the last neighbour vote too. A zero vector scores 0."""
        out = np.zeros(len(x), np.float64)
        k = min(NEIGHBOURS, len(self.labels) - leave_out)
        if k < 1:
            return out
        for a in range(0, len(x), BLOCK):
            block = np.round(x[a : a + BLOCK] @ self.vectors.T, 5)
            if leave_out:
                block[np.arange(len(block)), np.arange(a, a + len(block))] = -2
            kth = np.partition(block, block.shape[1] - k, axis=1)[:, block.shape[1] - k]
            row, col = np.nonzero((block >= kth[:, None]) & (block > 0))
            w = block[row, col].astype(np.float64) ** 4 * self.weights[col]
            total = np.bincount(row, w, len(block))
            good = np.bincount(row, w * self.labels[col], len(block))
            out[a : a + BLOCK] = np.divide(good, total, out=np.zeros(len(block)), where=total > 0)
        return out


def leading_axes(start: np.ndarray, at: np.ndarray, values: np.ndarray, n_terms: int, dims: int) -> np.ndarray:
    """(n_terms, dims): leading right singular vectors of the sparse rows (at, values)[start[i] : start[i + 1]], by
    block power iteration from a fixed start, which never forms a matrix of terms by terms."""
    n = len(start) - 1
    width = min(dims + SPARE, n, n_terms)
    spans = list(zip(start[:-1].tolist(), start[1:].tolist()))
    by_term = np.argsort(at, kind="stable")
    row_of = np.repeat(np.arange(n), np.diff(start))[by_term]
    sorted_values, sorted_terms = values[by_term], at[by_term]
    q = np.random.default_rng(0).standard_normal((n, width)).astype(np.float32)
    basis = np.zeros((n_terms, width), np.float32)
    for _ in range(ITERATIONS):
        basis[:] = 0
        for a in range(0, len(by_term), 1 << 17):  # rows^T q, sums by term
            t = sorted_terms[a : a + (1 << 17)]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            basis[t[first]] += np.add.reduceat(sorted_values[a : a + (1 << 17), None] * q[row_of[a : a + (1 << 17)]], first, axis=0)
        basis = np.linalg.qr(basis)[0]
        q = np.stack([values[a:b] @ basis[at[a:b]] for a, b in spans])
    axes = np.linalg.svd(q, full_matrices=False)[2][:dims]
    return basis @ axes.T


def fit(vocabulary: list[tuple[str, int]], rows: list[tuple[list[int], list[int]]], labels: list[int], dims: int = DIMS,
        class_weight: tuple[float, float] = (1.0, 1.0), n_docs: int | None = None) -> Model:
    """Latent-semantic space of the examples: (1 + log tf) * idf over the vocabulary [(term, documents with it)] of
    n_docs documents (the examples, if not given), unit rows, and their leading right singular vectors. rows:
    (vocabulary rows, counts) of each example. Without examples the model scores everything 0."""
    n, v = len(rows), len(vocabulary)
    start = np.cumsum([0, *[len(at) for at, _ in rows]])
    if not n or not v or not start[-1]:
        return Model([], np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    idf = np.log(1 + (n_docs or n) / np.maximum(1, np.array([d for _, d in vocabulary], np.float32))).astype(np.float32)
    at = np.concatenate([np.asarray(a, np.int64) for a, _ in rows])
    values = (1 + np.log(np.concatenate([np.asarray(c, np.float32) for _, c in rows]))) * idf[at]
    norm = np.sqrt(np.bincount(np.repeat(np.arange(n), np.diff(start)), values**2, n)).astype(np.float32)
    values = values / np.repeat(norm, np.diff(start))
    basis = leading_axes(start, at, values.astype(np.float32), v, dims)
    y = np.asarray(labels, np.float64)
    vectors = unit(np.stack([values[a:b] @ basis[at[a:b]] for a, b in zip(start[:-1], start[1:])]).astype(np.float32))
    # The rows' lengths cancel: embedded texts are scaled to unit length too.
    return Model([t for t, _ in vocabulary], idf[:, None] * basis, vectors, y, np.where(y > 0, class_weight[1], class_weight[0]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def term_set(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(terms(t)) if t else [])


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """(id, label, text) of up to per_class labelled documents of each class, by hash of the id. The labels alone are
    ranked (top-k by partial sorts); their texts come with one scan of docs against a broadcast of bounded size.
    Of an id with several labels the least counts; of one with several texts, one row."""
    ids = (labels.select(F.col(id_col).alias("_sv_i"), F.col(label_col).cast("int").alias("_sv_l")).where("_sv_i is not null and _sv_l in (0, 1)")
           .groupBy("_sv_i").agg(F.min("_sv_l").alias("_sv_l")))
    picked = None
    for c in (0, 1):
        some = ids.where(F.col("_sv_l") == c).orderBy(key_hash(F.col("_sv_i"), "label:"), "_sv_i").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = slim.join(F.broadcast(cut(picked)), F.col("id") == F.col("_sv_i"))
    return found.groupBy("id").agg(F.min("_sv_l").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on a bounded labelled sample; document frequencies of its terms come from all of docs. A class that the bound thins is weighted up to its number of labels, halved
    in log scale, so that the vote leans to the larger class but a clear neighbourhood of the smaller one wins."""
    sample = cut(sample_labelled(docs, labels, label_col, id_col, text_col, per_class))
    shared = sample.select(F.explode(term_set("text")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t")
    vocabulary = sorted(shared.toArrow()["t"].to_pylist())
    numbers, name = docs.sparkSession.sparkContext.broadcast("\n".join(vocabulary)), uuid.uuid4().hex

    def numberer():
        return rows_of(name, numbers.value).distinct

    n_docs, held = document_counts(docs, text_col, len(vocabulary), numberer)
    got = sample.select("id", "label", _rows_udf(numbers, name)("text").alias("r")).select("id", "label", "r.*").toArrow().sort_by("id")
    label = got["label"].to_pylist()
    have = Counter(label)
    real = {r["l"]: r["n"] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = tuple(math.sqrt(real.get(c, 0) / have[c]) if have[c] else 1.0 for c in (0, 1))
    return fit(list(zip(vocabulary, held.tolist())), [(a.values.to_numpy(), n.values.to_numpy()) for a, n in zip(got["at"], got["n"])], label, class_weight=weight, n_docs=n_docs)


def _rows_udf(shared, name: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = rows_of(name, shared.value)
        for texts in batches:
            found = rows(texts.tolist())
            yield pd.DataFrame({"at": [a.tolist() for a, _ in found], "n": [n.tolist() for _, n in found]})

    return F.pandas_udf(run, T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]))


def scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.scores([t if isinstance(t, str) else None for t in texts]))

    return F.pandas_udf(score, T.DoubleType())


def quality_filter(docs: DataFrame, source: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   threshold: float = THRESHOLD, score_col: str | None = None) -> DataFrame:
    """`docs`, all columns, less the rows that score below threshold; with the score if score_col names one.

    The model is fitted on labelled rows of `source`. Null, empty and blank texts, and any without a known term,
    score 0 and go. Repeated rows score alike. Row by row: no shuffle. Without labels every row scores 0; with labels of
    one class a text near any example scores 1 (class 1) or 0 (class 0)."""
    score = scorer(docs.sparkSession, train(source, labels, id_col=id_col, text_col=text_col))
    if score_col is None:
        return docs.where(score(docs[text_col]) >= threshold)
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() != score_col.lower()]
    return docs.select(*kept, score(docs[text_col]).alias(score_col)).where(F.col(score_col) >= threshold)

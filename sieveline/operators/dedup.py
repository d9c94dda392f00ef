"""Exact prefix dedup, similar pairs of vectors, and greedy semantic dedup within and across sources."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import prefix_key
from .components import connected_components

#: Vectors in a block of the pair search, in a tile of a block, and in a row of the shuffle: a task holds one block, a row
#: of another and the product of that and a tile. Each vector goes to as many tasks as there are blocks.
BLOCK_ROWS, TILE, PACK = 32_768, 2048, 1024
#: Pairs, at least, in a batch of them.
FOUND = 65_536


def prefix_dedup(df: DataFrame, n: int, order: list, text: str = "text", within: list[str] = ()) -> DataFrame:
    """First row, in `order`, of each md5 of the first n characters (within groups if given). A window, because
    dropDuplicates may keep any row."""
    return df.withColumn("_rn", prefix_rank(n, order, text, within)).where("_rn = 1").drop("_rn")


def prefix_rank(n: int, order: list, text: str = "text", within: list[str] = ()):
    """Rank of a row, in `order`, among those of its first n characters: 1 for the row that prefix_dedup() keeps."""
    return F.row_number().over(Window.partitionBy(*within, prefix_key(F.col(text), n)).orderBy(*order))


def blocks_of(rows: int, tasks: int = 1) -> int:
    """Blocks of BLOCK_ROWS; smaller ones while pairs of blocks are fewer than tasks that can run."""
    return max(1, math.ceil(rows / BLOCK_ROWS), min(math.ceil(rows / 256), math.ceil(math.sqrt(2 * tasks))))


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(i, j, similarity), i < j, of all pairs of rows whose cosine exceeds threshold: exact.

    Rows are hashed into blocks; each pair of blocks meets in one task, which holds the first block, reads the second row
    by row and hands on pairs as it finds them."""
    v = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    b = blocks or blocks_of(v.count(), v.sparkSession.sparkContext.defaultParallelism)
    placed = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")).mapInArrow(_packed, "b int, ids binary, vs binary")
    task = F.explode(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda o: F.struct(F.least(F.col("b"), o).alias("x"), F.greatest(F.col("b"), o).alias("y"))))
    spread = placed.select("b", "ids", "vs", task.alias("t")).select("b", "ids", "vs", "t.x", "t.y")
    met = spread.repartitionById(b * (b + 1) // 2, (F.col("y") * (F.col("y") + 1) / 2 + F.col("x")).cast("int")).sortWithinPartitions("x", "y", "b")
    return met.mapInArrow(lambda batches: _pairs(batches, threshold), "i bigint, j bigint, similarity double").where("i <> j")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, ids, vs): the rows of a block, at most PACK at a time, as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.unique(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False))
        if len(lengths) > 1:
            raise ValueError("vectors differ in length")
        ids, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "b"))
        m = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), int(lengths[0]))
        out = [(k, at[r : r + PACK]) for k in np.unique(block) for at in (np.flatnonzero(block == k),) for r in range(0, len(at), PACK)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([ids[at].astype(np.int64).tobytes() for _, at in out], pa.binary()), pa.array([m[at].tobytes() for _, at in out], pa.binary())], ["b", "ids", "vs"])


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of rows that are sorted by (x, y, b): block x against block y, a block against itself where x = y."""
    at, held, found, n = None, [], [], 0

    def flush() -> pa.RecordBatch:
        i, j, s = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(s)], ["i", "j", "similarity"])

    for batch in batches:
        for k in range(batch.num_rows):
            x, y, block, ids, vs = (batch.column(c)[k].as_py() for c in ("x", "y", "b", "ids", "vs"))
            if (x, y) != at:
                at, held = (x, y), []
            ids = np.frombuffer(ids, np.int64)
            m = np.frombuffer(vs, np.float32).reshape(len(ids), len(vs) // 4 // len(ids)).astype(np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m /= np.where(norm > 0, norm, 1)
            if block == y:
                for others, a in [*held, (ids, m)] if x == y else held:
                    s = a @ m.T
                    p, r = np.nonzero(s > threshold)
                    if others is ids:
                        p, r = p[p < r], r[p < r]
                    if len(p):
                        found.append((others[p], ids[r], s[p, r]))
                        n += len(p)
                    if n >= FOUND:
                        yield flush()
                        found, n = [], 0
            if block == x:
                if held and len(held[-1][0]) + len(ids) <= TILE:
                    others, a = held.pop()
                    ids, m = np.concatenate([others, ids]), np.concatenate([a, m])
                held.append((ids, m))
    if found:
        yield flush()


def greedy_self(pairs: list[tuple[int, int]], length: dict[int, int]) -> set[int]:
    """Rows that the greedy rule drops: pairs (i < j) in order; a pair counts while both live; the longer stays, the
    earlier at ties."""
    return set(_drop_self((i, j, length[i] >= length[j]) for i, j in sorted(pairs)))


def _drop_self(pairs: Iterable[tuple[int, int, bool]]) -> Iterator[int]:
    """greedy_self() over sorted pairs (i, j, whether i is as long as j), one by one."""
    gone: set[int] = set()
    for i, j, first in pairs:
        if i not in gone and j not in gone:
            gone.add(out := j if first else i)
            yield out


def greedy_cross(pairs: list[tuple[int, int]], length: dict[int, int]) -> set[int]:
    """Pairs (left, right) by left row: a left row that lives when its turn comes meets all its living right rows,
    even after it has lost to one."""
    return set(_drop_cross((i, j, length[i] >= length[j]) for i, j in sorted(pairs)))


def _drop_cross(pairs: Iterable[tuple[int, int, bool]]) -> Iterator[int]:
    """greedy_cross() over sorted pairs, one by one."""
    gone: set[int] = set()
    left, lives = None, False
    for i, j, first in pairs:
        if i != left:
            left, lives = i, i not in gone
        if lives and j not in gone and (out := j if first else i) not in gone:
            gone.add(out)
            yield out


def _resolve(pairs: DataFrame, lengths: DataFrame, rule) -> DataFrame:
    """ids that `rule` drops, replayed apart in each connected component of the sparse pair list. Pairs of a component are
    read in order, one by one; only the ids that are gone are held."""
    from ..sources.files import cut

    pairs = cut(pairs.select("i", "j"))
    roots = connected_components(pairs.select(F.col("i").alias("u"), F.col("j").alias("v")))
    # Every node but the root is listed; a pair's component is that of its larger end.
    of = pairs.join(roots.withColumnRenamed("node", "hi"), F.greatest("i", "j") == F.col("hi")).select("i", "j", "root")
    li = lengths.select(F.col("id").alias("i"), F.col("length").alias("li"))
    lj = lengths.select(F.col("id").alias("j"), F.col("length").alias("lj"))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        dropped = (k for _, some in groupby(rows, lambda r: r[0]) for k in rule(r[1:] for r in some))
        while ids := list(islice(dropped, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["id"])

    first = F.coalesce(F.col("li") >= F.col("lj"), F.lit(False)).alias("first")
    ordered = of.join(li, "i").join(lj, "j").select("root", "i", "j", first).repartition("root").sortWithinPartitions("root", "i", "j")
    return ordered.mapInArrow(replay, "id bigint")


def semantic_rejects(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", length_col: str = "length") -> DataFrame:
    """(id) of the rows that the greedy rule drops. A component of similar rows is replayed in one task, as the rule is
    sequential; only its pairs and which of two is longer go there."""
    lengths = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(length_col).alias("length"))
    return _resolve(similar_pairs(vectors, threshold, id_col, vec_col), lengths, _drop_self)


def semantic_dedup(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", length_col: str = "length") -> DataFrame:
    """`vectors` less the rows that the greedy rule drops. Ids give the order of rows and are unique."""
    gone = semantic_rejects(vectors, threshold, id_col, vec_col, length_col)
    return vectors.join(gone, vectors[id_col] == gone.id, "left_anti")


def cross_source_rejects(vectors: DataFrame, threshold: float, left: str, right: str, source_col: str = "source", id_col: str = "vec_id",
                         vec_col: str = "embedding", length_col: str = "length") -> DataFrame:
    """(id) of the rows that the bipartite rule drops between two sources; none if one of them is missing."""
    ids = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(length_col).alias("length"), F.col(source_col).alias("s"))
    p = similar_pairs(vectors, threshold, id_col, vec_col)
    a, b = ids.select(F.col("id").alias("i"), F.col("s").alias("si")), ids.select(F.col("id").alias("j"), F.col("s").alias("sj"))
    both = p.join(a, "i").join(b, "j")
    ordered = both.where((F.col("si") == left) & (F.col("sj") == right)).select("i", "j").union(both.where((F.col("si") == right) & (F.col("sj") == left)).select("j", "i"))
    return _resolve(ordered, ids.select("id", "length"), _drop_cross)


def cross_source_dedup(vectors: DataFrame, threshold: float, left: str, right: str, source_col: str = "source", id_col: str = "vec_id",
                       vec_col: str = "embedding", length_col: str = "length") -> DataFrame:
    """`vectors` less what the bipartite rule drops between two sources; unchanged if one of them is missing."""
    gone = cross_source_rejects(vectors, threshold, left, right, source_col, id_col, vec_col, length_col)
    return vectors.join(gone, vectors[id_col] == gone.id, "left_anti")


def top_k_diverse(vectors: DataFrame, query: list[float], k: int, per_source: int, id_col: str = "vec_id", vec_col: str = "embedding", source_col: str = "source") -> DataFrame:
    """The k nearest by cosine with at most per_source of a source. The inner bound is a literal, so each map task
    keeps only its best of a source before the shuffle."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vec_col), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.select(id_col, source_col, F.round(dot, 6).alias("score"))
    w = Window.partitionBy(source_col).orderBy(F.desc("score"), id_col)
    return scored.withColumn("_rn", F.row_number().over(w)).where(f"_rn <= {int(per_source)}").drop("_rn").orderBy(F.desc("score"), id_col).limit(k)

"""Minimum-cost-flow resharding: move the fewest bytes from old shard sizes to new capacities."""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cumulative_thresholds, cut, fresh, key_hash, replace_columns

#: Production parameters: number of new shards and slack of their equal capacities.
NEW_SHARDS = 16
SLACK = 0.05


class MinCostFlow:
    """Shortest paths with potentials over integer capacities and nonnegative integer costs. Each round finds the
    distances once and then fills all paths of that length, so there are as many rounds as path costs, not as paths."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.cost, self.out = n, [], [], [], [[] for _ in range(n)]

    def edge(self, u: int, v: int, cap: int, cost: int) -> int:
        k = len(self.to)
        self.to += [v, u]
        self.cap += [cap, 0]
        self.cost += [cost, -cost]
        self.out[u].append(k)
        self.out[v].append(k + 1)
        return k

    def solve(self, s: int, t: int) -> tuple[int, int]:
        """(flow, cost)."""
        flow = total = 0
        potential = [0] * self.n
        while True:
            dist, heap = [math.inf] * self.n, [(0, s)]
            dist[s] = 0
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.out[u]:
                    if self.cap[k] > 0 and (nd := d + self.cost[k] + potential[u] - potential[self.to[k]]) < dist[self.to[k]]:
                        dist[self.to[k]] = nd
                        heapq.heappush(heap, (nd, self.to[k]))
            if dist[t] == math.inf:
                return flow, total
            for u in range(self.n):
                if dist[u] < math.inf:
                    potential[u] += dist[u]
            tight = lambda u, k: self.cap[k] > 0 and dist[u] < math.inf and dist[self.to[k]] < math.inf and not self.cost[k] + potential[u] - potential[self.to[k]]  # noqa: B023, E731
            while more := self._fill(s, t, tight):
                flow += more
                total += more * (potential[t] - potential[s])

    def _fill(self, s: int, t: int, tight) -> int:
        """Flow added along shortest paths, by number of edges, of tight edges until none is left (a blocking flow)."""
        level, queue = {s: 0}, [s]
        for u in queue:
            for k in self.out[u]:
                if self.to[k] not in level and tight(u, k):
                    level[self.to[k]] = level[u] + 1
                    queue.append(self.to[k])
        added, next_, path, u = 0, [0] * self.n, [], s
        while t in level:
            if u == t:
                push = min(self.cap[k] for k in path)
                added += push
                for k in path:
                    self.cap[k] -= push
                    self.cap[k ^ 1] += push
                full = next(i for i, k in enumerate(path) if not self.cap[k])
                u = self.to[path[full] ^ 1]
                del path[full:]
                continue
            while next_[u] < len(self.out[u]):
                k = self.out[u][next_[u]]
                if level.get(self.to[k]) == level[u] + 1 and tight(u, k):
                    path.append(k)
                    u = self.to[k]
                    break
                next_[u] += 1
            else:
                if u == s:
                    break
                u = self.to[path.pop() ^ 1]
                next_[u] += 1
        return added


def plan_transfers(sizes: Sequence[int], capacities: Sequence[int], costs: Mapping[tuple[int, int], int] | None = None) -> list[tuple[int, int, int]]:
    """Transfers (old, new, bytes), stays included, of least cost; old shard i stays in place at new shard i.

    A byte costs 0 where it is and 1 elsewhere; `costs` may price pairs otherwise (0 at least), absent pairs cost 1.
    With the one price, all moves go through a hub, so that the graph grows with the shards and not with their
    pairs. A total capacity below the total size is an error. Sizes of 0 give no transfers."""
    if sum(capacities) < sum(sizes):
        raise ValueError(f"{sum(sizes)} bytes don't fit in {sum(capacities)}")
    n, m = len(sizes), len(capacities)
    s, t, hub = n + m, n + m + 1, n + m + 2
    net = MinCostFlow(n + m + 3)
    for i, x in enumerate(sizes):
        net.edge(s, i, int(x), 0)
    for j, c in enumerate(capacities):
        net.edge(n + j, t, int(c), 0)
    total = int(sum(sizes))
    if costs is None:
        stay = {i: net.edge(i, n + i, total, 0) for i in range(min(n, m))}
        leave = [net.edge(i, hub, total, 1) for i in range(n)]
        enter = [net.edge(hub, n + j, total, 0) for j in range(m)]
        net.solve(s, t)
        out = [(i, i, net.cap[k ^ 1]) for i, k in stay.items() if net.cap[k ^ 1]]
        gone, came = [[i, net.cap[k ^ 1]] for i, k in enumerate(leave)], [[j, net.cap[k ^ 1]] for j, k in enumerate(enter)]
        gone, came = [x for x in gone if x[1]], [x for x in came if x[1]]
        while gone:
            x = min(gone[0][1], came[0][1])
            out.append((gone[0][0], came[0][0], x))
            for side in (gone, came):
                side[0][1] -= x
                if not side[0][1]:
                    side.pop(0)
    else:
        pairs = {(i, j): net.edge(i, n + j, total, costs.get((i, j), 0 if i == j else 1)) for i in range(n) for j in range(m)}
        net.solve(s, t)
        out = [(i, j, net.cap[k ^ 1]) for (i, j), k in pairs.items() if net.cap[k ^ 1]]
    return sorted(out, key=lambda x: (x[0], x[0] != x[1], x[1]))


def natural(name: str | None) -> tuple:
    """src2 before src10; null first."""
    return (name is not None, [(p.isdigit(), int(p) if p.isdigit() else 0, p) for p in re.split(r"(\d+)", name or "")])


def transfer_ranges(docs: DataFrame, n_new: int = NEW_SHARDS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text",
                    shard_col: str = "source", capacities: Sequence[int] | None = None, seed: str = "shard:") -> DataFrame:
    """One row per transfer: (old, old_shard, new_shard, lo, hi): the block of old shard `old` with hash in
    [lo, hi) goes to new_shard.

    The driver sees one row per old shard and per transfer. Blocks end at document bounds: what stays never exceeds
    the shard's capacity; a block that moves ends within one document of its planned size."""
    rows = cut(docs.select(F.col(shard_col).cast("string").alias("old"), key_hash(F.col(id_col), seed).alias("h"), document_bytes(F.col(text_col)).alias("bytes")))
    sizes = sorted(((r["old"], r["bytes"]) for r in rows.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()), key=lambda x: natural(x[0]))
    total = sum(b for _, b in sizes)
    if capacities is None:
        capacities = [math.ceil(total * (1 + slack) / n_new)] * n_new
    moves = plan_transfers([b for _, b in sizes], capacities)
    spark, targets, at = docs.sparkSession, [], {}
    for i, j, x in moves:
        at[i] = at.get(i, 0) + x
        targets.append((sizes[i][0], i, j, at[i], at[i] == sizes[i][1]))
    schema = "old string, old_shard int, new_shard int, upto bigint, last boolean"
    plan = spark.createDataFrame(targets, schema).withColumn("target_id", F.concat_ws(":", "old_shard", "new_shard"))
    found = cumulative_thresholds(rows, "old", "h", "bytes", plan.where("not last").select("old", "target_id", F.col("upto").alias("target")))
    # The last block of a shard takes all that is left of it, documents of 0 bytes included.
    ends = plan.join(bounded(found.select("target_id", "threshold")), "target_id", "left").withColumn("hi", F.coalesce("threshold", F.lit(1 << 60)))
    empty = [(n, i, i if i < n_new else i % n_new, 0, True) for i, (n, b) in enumerate(sizes) if not b]
    if empty:
        ends = ends.unionByName(spark.createDataFrame(empty, schema).withColumn("target_id", F.lit("")).withColumn("threshold", F.lit(None).cast("bigint")).withColumn("hi", F.lit(1 << 60)))
    from pyspark.sql.window import Window

    order = Window.partitionBy("old_shard").orderBy("upto")
    return cut(ends.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("bigint"))).select("old", "old_shard", "new_shard", "lo", "hi"))


def document_bytes(text):
    """UTF-8 bytes; null counts 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def reshard(docs: DataFrame, n_new: int = NEW_SHARDS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text",
            shard_col: str = "source", capacities: Sequence[int] | None = None, seed: str = "shard:") -> DataFrame:
    """`docs` with old_shard, new_shard and moved.

    Old shards are the values of shard_col in natural order, numbered from 0; null is one of them. Documents are
    looked up by hash range, without a shuffle or sort of their texts. Repeated ids share a hash and move together.
    Texts that are null or empty have 0 bytes and go with their range. Input columns named like the three new ones
    give way. An empty table stays empty."""
    ranges = transfer_ranges(docs, n_new, slack, id_col, text_col, shard_col, capacities, seed)
    names = fresh(docs, "old", "old_shard", "new_shard", "lo", "hi")
    ranges = ranges.toDF(*names)
    old, i, j, lo, hi = names
    h = key_hash(docs[id_col], seed)
    placed = docs.join(bounded(ranges), docs[shard_col].cast("string").eqNullSafe(ranges[old]) & (h >= ranges[lo]) & (h < ranges[hi]), "inner")
    return replace_columns(placed, old_shard=F.col(i), new_shard=F.col(j), moved=F.col(i) != F.col(j)).drop(*names)


def _files(spark, path: str):
    """(Hadoop's file system of path, a maker of its paths)."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def rewrite_shards(placed: DataFrame, path: str, whole: bool = False) -> list[int]:
    """Write, under path/new_shard=K, only the shards that a transfer changes; returns their numbers. Others keep
    their files: nothing is written for them, and nothing else under path is touched. A changed shard that no document
    is left on goes. whole: write all shards, for a path that doesn't hold the others yet.

    The new files are written beside the old ones first, in a hidden folder of path, and then take their places shard by
    shard, so that `placed` may be read from path itself. An empty table changes nothing."""
    spark = placed.sparkSession
    files, of = _files(spark, path)
    changed = cut(placed.where("moved").select(F.explode(F.array("old_shard", "new_shard")).alias("k")).distinct())
    kept = placed if whole else placed.join(bounded(changed), F.col("new_shard") == F.col("k"), "left_semi")
    beside = f"{path}/.rewrite-{uuid.uuid4().hex}"
    kept.write.partitionBy("new_shard").parquet(beside)
    touched = sorted(r["k"] for r in changed.collect())
    made = {s.getPath().getName() for s in files.listStatus(of(beside)) if s.isDirectory()}
    for name in sorted(made | {f"new_shard={k}" for k in touched}):
        files.delete(of(f"{path}/{name}"), True)
        if name in made:
            files.rename(of(f"{beside}/{name}"), of(f"{path}/{name}"))
    files.delete(of(beside), True)
    return touched


def reshard_files(docs: DataFrame, path: str, **options) -> DataFrame:
    """reshard(), with the new shards written under path, and read from there."""
    placed = reshard(docs, **options)
    rewrite_shards(placed, path, whole=True)
    return docs.sparkSession.read.schema(placed.schema).parquet(path).select(*[f"`{c}`" for c in placed.columns])


#: Prices are alike, so the least cost is known: a shard keeps what fits; what is left goes, in order, to the free room,
#: in order.
ORACLE = """
WITH d AS (SELECT *, ('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS b FROM documents),
o AS (SELECT source, CAST(sum(b) AS BIGINT) AS size, row_number() OVER (ORDER BY source IS NOT NULL, length(source), source) - 1 AS i FROM d GROUP BY source),
m AS (SELECT CAST(ceil(sum(size) * 1.05::DOUBLE / 16) AS BIGINT) AS cap FROM o),
k AS (SELECT o.*, cap, CASE WHEN i < 16 THEN least(size, cap) ELSE 0 END AS stay FROM o, m),
g AS (SELECT i, sum(size - stay) OVER (ORDER BY i) - (size - stay) AS a, sum(size - stay) OVER (ORDER BY i) AS z FROM k),
f AS (SELECT j, m.cap - coalesce(stay, 0) AS free, sum(m.cap - coalesce(stay, 0)) OVER (ORDER BY j) AS z FROM m, range(16) r(j) LEFT JOIN k ON k.i = j),
t AS (SELECT i, i AS j, 0 AS step, stay AS bytes FROM k WHERE stay > 0
      UNION ALL SELECT i, j, j + 1, least(g.z, f.z) - greatest(g.a, f.z - free) FROM g JOIN f ON least(g.z, f.z) > greatest(g.a, f.z - free)
      UNION ALL SELECT i, i % 16, 0, 0 FROM k WHERE size = 0),
u AS (SELECT i, j, step, sum(bytes) OVER (PARTITION BY i ORDER BY step) AS upto FROM t),
c AS (SELECT d.*, o.i, o.size, sum(b) OVER (PARTITION BY d.source ORDER BY h) AS so_far FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, text, lang, source, n_chars, CAST(c.i AS INTEGER) AS old_shard, CAST(arg_min(j, step) AS INTEGER) AS new_shard, arg_min(j, step) <> c.i AS moved
FROM c JOIN u ON c.i = u.i AND (so_far <= upto OR upto = size) GROUP BY doc_id, text, lang, source, n_chars, h, c.i
"""

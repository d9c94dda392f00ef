"""SimHash near-duplicate groups by a binary-trie self-join.

A text has a 256-bit SimHash of its words (weight sqrt(count)). Two fingerprints match when the first 128 bits differ
in at most BUDGET bits and all 256 in at most WIDE_BUDGET. The 128 bits are cut into 9 blocks: within a budget of 17
at least one block differs in at most one bit, hence in at most one of its halves. So each fingerprint enters 18
sub-tries, one per (block, half), rooted at the value of that half; the pairs of all sub-tries are the exact join.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .common import bounded, cut, fresh

BUDGET, WIDE_BUDGET = 17, 36
#: Offsets and lengths of the 9 blocks of the first 128 bits.
BLOCKS = [(0, 14), (14, 14), (28, 14), (42, 14), (56, 14), (70, 14), (84, 14), (98, 15), (113, 15)]
#: Node pairs of at most this many fingerprint pairs are compared outright; larger ones are descended. Fingerprint pairs
#: and node pairs that are held at a time; entries that a task gathers from its sub-tries before it joins them.
LEAF_PAIRS, CHUNK_PAIRS, FRONTIER, GATHER = 64, 1 << 18, 1 << 15, 1 << 18
#: Fingerprints above which a sub-trie is parted among tasks, by the values of the other half of its block.
SPLIT_ROWS = 1_000_000
WORD = re.compile(r"\w+")


def simhash(text: str) -> bytes:
    """32 bytes. A text without words is hashed whole, without white space at its ends."""
    import xxhash

    counts = Counter(WORD.findall(text.lower())) or Counter([text.strip()])
    words = list(counts)
    raw = b"".join([xxhash.xxh3_128_digest(w, 1) + xxhash.xxh3_128_digest(w, 2) for w in words])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(words), 256)
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(words)))
    # A bit is 1 where more than half of the weight has it; rounding makes the order of words irrelevant.
    return np.packbits(np.round(2 * (weight @ bits) - weight.sum(), 6) > 0).tobytes()


@F.pandas_udf(T.BinaryType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: simhash(t) if isinstance(t, str) else None)


def _words(fp):
    """The four 64-bit words of a 32-byte fingerprint, most significant first."""
    return [F.conv(F.hex(F.substring(fp, 1 + 8 * k, 8)), 16, -10).cast("bigint") for k in range(4)]


def _bits(w0, w1, offset: int, length: int):
    """`length` bits from `offset` of the 128 bits w0 w1."""
    if offset + length <= 64:
        x = F.shiftrightunsigned(w0, 64 - offset - length)
    elif offset >= 64:
        x = F.shiftrightunsigned(w1, 128 - offset - length)
    else:
        x = F.shiftleft(w0, offset + length - 64).bitwiseOR(F.shiftrightunsigned(w1, 128 - offset - length))
    return x.bitwiseAND(F.lit((1 << length) - 1))


def subtries() -> list[tuple[int, int, int, int]]:
    """(offset and length of the half that is equal, rotation that puts the other half first, its length)."""
    out = []
    for o, n in BLOCKS:
        a = n // 2
        out += [(o, a, o + a, n - a), (o + a, n - a, o, a)]
    return out


def rotate(w0: np.ndarray, w1: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits w0 w1 rotated left by r in [0, 128)."""
    swap = r >= 64
    a, b = np.where(swap, w1, w0), np.where(swap, w0, w1)
    s = (r % 64).astype(np.uint64)
    back = (np.uint64(64) - s) % np.uint64(64)
    none = s == 0
    return np.where(none, a, (a << s) | (b >> back)), np.where(none, b, (b << s) | (a >> back))


class Components:
    """Minimum labels of connected components, by vectorised hooking and pointer jumping."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def trie_self_join(bucket: np.ndarray, rotation: np.ndarray, first: np.ndarray, words: np.ndarray, budget: int = BUDGET, wide: int = WIDE_BUDGET, side: np.ndarray | None = None) -> Components:
    """Components of the matches within buckets.

    bucket[i], rotation[i], first[i]: the sub-trie of entry i, the rotation of its bits and how many leading bits
    are the other half of its block, where one differing bit is allowed. words: (n, 4) uint64. side[i]: -1, or 0 and 1
    in a bucket of two nodes of a sub-trie, the lesser and the greater, that are only compared with each other.

    Entries are sorted, so that a trie node is a range. Pairs of nodes descend together, one bit at a time, and
    carry the bits that differ so far; a pair beyond the budget is pruned. At most FRONTIER pairs descend at a time, the
    deepest first, so what waits doesn't grow with the pairs that there are."""
    r0, r1 = rotate(words[:, 0], words[:, 1], rotation)
    order = np.lexsort((r1, r0, bucket))
    bucket, r0, r1, words, first = bucket[order], r0[order], r1[order], np.asfortranarray(words[order]), first[order]
    side = np.full(len(bucket), -1, np.int8) if side is None else side[order]
    n, found, ones = len(bucket), Components(len(bucket)), _Ones(r0, r1)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], n]
    two, greater = side[starts] >= 0, np.r_[0, np.cumsum(side == 1)]
    middle = ends - (greater[ends] - greater[starts])  # the lesser node comes first
    many = np.where(two, (starts < middle) & (middle < ends), ends - starts > 1)
    roots = [starts[many], np.where(two, middle, ends)[many], np.where(two, middle, starts)[many], ends[many], np.zeros(many.sum(), np.int64)]
    del bucket, side, greater
    waiting = [(0, [x[k : k + FRONTIER] for x in roots]) for k in range(0, len(roots[0]), FRONTIER)]
    while waiting:
        depth, (a0, a1, b0, b1, acc) = waiting.pop()
        same = a0 == b0
        pairs = np.where(same, (a1 - a0) * (a1 - a0 - 1) // 2, (a1 - a0) * (b1 - b0))
        leaf = (pairs <= LEAF_PAIRS) if depth < 128 else np.ones(len(a0), bool)
        _compare(a0[leaf], a1[leaf], b0[leaf], b1[leaf], words, found, budget, wide)
        a0, a1, b0, b1, acc = (x[~leaf] for x in (a0, a1, b0, b1, acc))
        if not len(a0):
            continue
        am, bm, same = a1 - (ones(depth, a1) - ones(depth, a0)), b1 - (ones(depth, b1) - ones(depth, b0)), a0 == b0
        down = [(a0, am, b0, bm, acc, np.ones(len(a0), bool)), (am, a1, bm, b1, acc, np.ones(len(a0), bool)),
                (a0, am, bm, b1, acc + 1, np.ones(len(a0), bool)), (am, a1, b0, bm, acc + 1, ~same)]
        a0, a1, b0, b1, acc = (np.concatenate([x[k][x[5]] for x in down]) for k in range(5))
        allowed = np.where(depth < first[np.minimum(a0, n - 1)], 1, budget)
        live = (a1 > a0) & (b1 > b0) & (acc <= allowed) & ~((a0 == b0) & (a1 - a0 < 2))
        below = [x[live] for x in (a0, a1, b0, b1, acc)]
        waiting += [(depth + 1, [x[k : k + FRONTIER].copy() for x in below]) for k in range(0, len(below[0]), FRONTIER)]
    out = Components(n)
    out.label = order[found.label][np.argsort(order)]
    return out


class _Ones:
    """ones(depth, i): how many of the first i entries have a one at that bit of r0 r1. A bit and a half an entry for each
    depth that is asked for."""

    def __init__(self, r0: np.ndarray, r1: np.ndarray):
        self.words, self.known = (r0, r1), {}

    def __call__(self, depth: int, i: np.ndarray) -> np.ndarray:
        if depth not in self.known:
            bits = (self.words[depth // 64] >> np.uint64(63 - depth % 64)).astype(np.uint8) & 1
            packed = np.packbits(np.r_[bits, np.zeros(64 - len(bits) % 64, np.uint8)], bitorder="little").view("<u8")
            self.known[depth] = packed, np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int32)
        packed, before = self.known[depth]
        at, rest = i >> 6, (i & 63).astype(np.uint64)
        return before[at] + np.bitwise_count(packed[at] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)


def _compare(a0, a1, b0, b1, words, found, budget, wide) -> None:
    """Join all pairs of these node pairs that match, in chunks of bounded size."""
    same = a0 == b0
    count = (a1 - a0) * (b1 - b0)
    upto_here = np.r_[0, np.cumsum(count)]
    at = 0
    while at < len(a0):
        upto = max(at + 1, int(np.searchsorted(upto_here, upto_here[at] + CHUNK_PAIRS)) - 1)
        s = slice(at, upto)
        at = upto
        if upto - s.start == 1 and count[s.start] > CHUNK_PAIRS:  # one large pair of nodes: by blocks of rows
            x0, x1, y0, y1 = a0[s][0], a1[s][0], b0[s][0], b1[s][0]
            rows = max(1, CHUNK_PAIRS // int(y1 - y0))
            for r in range(x0, x1, rows):
                i = np.arange(r, min(x1, r + rows))
                _match(i, np.maximum(i + 1, y0) if same[s][0] else np.full(len(i), y0), np.full(len(i), y1), words, found, budget, wide)
            continue
        c = (a1 - a0)[s]
        node = np.repeat(np.arange(len(c)), c)
        i = np.arange(len(node)) + (a0[s] - (np.cumsum(c) - c))[node]
        _match(i, np.where(same[s][node], i + 1, b0[s][node]), b1[s][node], words, found, budget, wide)


def _match(i, j0, j1, words, found, budget, wide) -> None:
    """Join every entry i[k] with those of [j0[k], j1[k]) that match it."""
    c = j1 - j0
    j = np.arange(c.sum()) + np.repeat(j0 - (np.cumsum(c) - c), c)
    w = words[:, 0]
    near = np.flatnonzero(np.bitwise_count(np.repeat(w[i], c) ^ w[j]) <= budget)
    i, j = i[np.searchsorted(np.cumsum(c), near, side="right")], j[near]
    d = np.bitwise_count(words[i, 0] ^ words[j, 0]).astype(np.int64)
    d += np.bitwise_count(words[i, 1] ^ words[j, 1])
    near = d <= budget
    i, j, d = i[near], j[near], d[near]
    d += np.bitwise_count(words[i, 2] ^ words[j, 2])
    d += np.bitwise_count(words[i, 3] ^ words[j, 3])
    near = d <= wide
    found.add(i[near], j[near])


#: Keys from here on are of pairs of nodes.
PARTED = 1 << 40


def _join_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, w0..w3) of whole sub-tries, or pairs of their nodes, sorted by key -> (u, v): every fingerprint that
    isn't the first of its component here, with the first. Joined as they come, once GATHER entries or more are there."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= GATHER:
            # What came is whole up to where its last key ends in this batch.
            key = batch.column("key").to_numpy()
            ends = int(np.searchsorted(key, held[-1].column("key")[-1].as_py(), side="right"))
            if ends < len(key):
                yield _join_entries([*held, batch.slice(0, ends)])
                held, rows, batch = [], 0, batch.slice(ends)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield _join_entries(held)


def _join_entries(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    column = lambda name: np.concatenate([b.column(name).to_numpy() for b in batches])
    key, side, words = column("key"), column("side").astype(np.int8), np.empty((sum(b.num_rows for b in batches), 4), np.uint64)
    for k in range(4):
        words[:, k] = column(f"w{k}").view(np.uint64)
    batches.clear()
    tries = np.array(subtries(), np.int16)
    which = np.where(key < PARTED, key, (key - PARTED) >> 16) >> 16
    label = trie_self_join(key, tries[which, 2], tries[which, 3], words, side=side).label
    # The same fingerprint is here in several sub-tries; its entries are one node.
    order = np.lexsort(words.T[::-1])
    new = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(1)]
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    first_at = order[new]
    one = Components(len(first_at))
    one.add(node, node[label])
    member = np.flatnonzero(one.label != np.arange(len(one.label)))
    u, v = words[first_at[member]], words[first_at[one.label[member]]]
    raw = lambda x: [r.tobytes() for r in x.astype(">u8")]
    return pa.RecordBatch.from_arrays([pa.array(raw(u), pa.binary()), pa.array(raw(v), pa.binary())], names=["u", "v"])


def match_edges(prints: DataFrame, rows: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """prints: distinct fp (binary 32), at most `rows`. (u, v): edges whose components are those of the matching pairs.

    A sub-trie of more than split_rows is parted: its matches differ in one bit at most of the other half of the block, so
    they lie in one node of that depth or in two whose values differ in one bit; each such pair of nodes is a key of its
    own. The same pairs are compared either way."""
    w = prints.select("fp", *[c.alias(f"w{k}") for k, c in enumerate(_words(F.col("fp")))])
    w0, w1 = F.col("w0"), F.col("w1")
    tries = [F.struct(F.lit(k << 16).bitwiseOR(_bits(w0, w1, o, n)).cast("bigint").alias("key"), _bits(w0, w1, p, m).cast("bigint").alias("v"), F.lit(m).alias("bits")) for k, (o, n, p, m) in enumerate(subtries())]
    words = ["w0", "w1", "w2", "w3"]
    entries = w.select(F.explode(F.array(*tries)).alias("e"), *words).select("e.*", *words)
    if rows <= split_rows:
        entries = entries.select("key", F.lit(-1).alias("side"), *words)
    else:
        # A row for each of at most 2,560 sub-tries.
        large = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows).select(F.col("key").alias("large"))
        parted = F.expr(f"""transform(sequence(0, bits), i -> if(i = 0, named_struct('key', {PARTED} + key * 65536 + v * 256 + v, 'side', -1),
            named_struct('key', {PARTED} + key * 65536 + least(v, v ^ shiftleft(1L, i - 1)) * 256 + greatest(v, v ^ shiftleft(1L, i - 1)), 'side', if((v & shiftleft(1L, i - 1)) = 0, 0, 1))))""")
        whole = F.array(F.struct("key", F.lit(-1).alias("side")))
        entries = entries.join(F.broadcast(cut(large)), F.col("key") == F.col("large"), "left").withColumn("p", F.explode(F.when(F.col("large").isNull(), whole).otherwise(parted))).select("p.*", *words)
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(_join_partition, "u binary, v binary")


def duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row per distinct (id, text) of each group of two rows or more: (id, th = hash of the text, n = rows of it,
    root = group, kept_id, kept_th, distinct order)."""
    rows = cut(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), fingerprint(F.col(text_col)).alias("fp")))
    ids = rows.groupBy("fp", "id", "th").agg(F.count(F.lit(1)).alias("n"))
    roots = connected_components(match_edges(rows.select("fp").distinct(), rows.count(), split_rows))
    grouped = ids.join(roots, ids.fp == roots.node, "left").select("id", "th", "n", F.coalesce("root", "fp").alias("root"))
    # Group sizes and the row that stays come from an aggregate with partial sums, so a huge group is no hot spot.
    heads = grouped.groupBy("root").agg(F.sum("n").alias("size"), F.min(F.struct(F.col("id").isNull().alias("nid"), "id", "th")).alias("keep")).where("size > 1")
    return cut(grouped.join(heads, "root").select("id", "th", "n", "root", F.col("keep.id").alias("kept_id"), F.col("keep.th").alias("kept_th")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs (doc_id, kept_doc_id): each document that a smaller id of its group stands for.

    Groups are the connected components of matching texts. The row of the smallest id stays (null ids last, then by
    hash of the text). A repeated row with the id of the one that stays gives a pair of equal ids. Null texts are
    never compared; empty ones are copies of each other. Long texts count as a whole. An empty table gives no
    rows."""
    rows = duplicate_rows(docs, id_col, text_col, split_rows)
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    times = F.explode(F.sequence(F.lit(1), F.col("n").cast("int") - F.when(same, 1).otherwise(0)))
    return rows.where(~same | (F.col("n") > 1)).select(F.col("id").alias("doc_id"), F.col("kept_id").alias("kept_doc_id"), times.alias("_copy")).drop("_copy")


def dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with one row of each group; cases as in near_duplicates(). Of repeated rows with the id and
    text of the one that stays, the least by a hash of all columns stays. Rows with null texts stay.

    Only keys of dropped rows are joined back: broadcast up to BROADCAST_BYTES of them, else by a shuffle."""
    rows = duplicate_rows(docs, id_col, text_col)
    i, th, rank = fresh(docs, "id", "th", "rank")
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    gone = rows.where(~same).select(F.col("id").alias(i), F.col("th").alias(th))
    again = rows.where(same & (F.col("n") > 1)).select(F.col("id").alias(i), F.col("th").alias(th))
    of = F.xxhash64(docs[text_col])

    gone, again = bounded(gone), bounded(again)
    left = docs.join(gone, docs[id_col].eqNullSafe(gone[i]) & (of == gone[th]) & docs[text_col].isNotNull(), "left_anti")
    on = left[id_col].eqNullSafe(again[i]) & (F.xxhash64(left[text_col]) == again[th]) & left[text_col].isNotNull()
    once = left.join(again, on, "left_anti")
    first = left.join(again, on, "left_semi")
    w = Window.partitionBy(first[id_col], F.xxhash64(first[text_col])).orderBy(F.md5(F.to_json(F.struct(*[first[f"`{c}`"] for c in first.columns]))))
    return once.unionByName(first.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank))

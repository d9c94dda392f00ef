"""Training-order materialisation: token ids packed into fixed sequences, each at a global slot given by a keyed
Feistel permutation, in fixed-stride shards."""

import base64
import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cut, key_hash, scratch_path, scratch_table

#: Production parameters: vocabulary file (ranks, GPT-2 style), end-of-text id, tokens of a sequence, slots of a
#: shard and the key of the order. Ids are little-endian uint16.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOT, SEQUENCE, SHARD_SLOTS, KEY = 50256, 1024, 8192, 20240229
#: Rows of the token files are at most this long, so that very long texts need no very long rows; so many of the rows
#: that place documents are summed at a time; how hard token files and shuffled pieces are compressed.
PIECE, RUN, FILE_LEVEL, PIECE_LEVEL = 16384, 100_000, 9, 1
#: Ids that take one byte in shuffled pieces; commonest ids of a file that stand for election.
COMMON, ELIGIBLE = 255, 1000

_ENCODERS: dict[bytes, object] = {}


def read_ranks(ranks_path: str = RANKS) -> bytes:
    with open(ranks_path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """One encoder per process and vocabulary, of the content of its file."""
    name = blake2b(ranks).digest()
    if name not in _ENCODERS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[name] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[name]


def encode(text: str, ranks: bytes | None = None) -> np.ndarray:
    ids = encoder(read_ranks() if ranks is None else ranks).encode_to_numpy(text, allowed_special=set(), disallowed_special=())
    return np.append(ids, EOT).astype("<u2")


class SlotPermutation:
    """A keyed permutation of [0, n) over numpy arrays: a balanced Feistel network on the next even number of bits;
    values beyond n walk along their cycle until they are back inside."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [self._mix(np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + n) % 2**64)) for r in range(1, rounds + 1)]

    @staticmethod
    def _mix(x):
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def _once(self, x, keys, back: bool):
        a, b = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            if back:
                a, b = b ^ (self._mix(a ^ k) & self.mask), a
            else:
                a, b = b, a ^ (self._mix(b ^ k) & self.mask)
        return (a << np.uint64(self.half)) | b

    def _walk(self, x, keys, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), keys, back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, self.keys[::-1], True)


class PieceCode:
    """Shuffled pieces: a byte for each id, its place among `common` or COMMON; then how many others there are, and the
    low and the high bytes of those; compressed. Any list of common ids gives back the same ids."""

    def __init__(self, common: list[int]):
        self.ids = np.zeros(COMMON + 1, "<u2")
        self.ids[: len(common)] = common
        self.place = np.full(1 << 16, COMMON, np.uint8)
        self.place[common] = np.arange(len(common))
        self.codec = pa.Codec("zstd", PIECE_LEVEL)

    def pack(self, ids: np.ndarray) -> bytes:
        place = self.place[ids]
        rest = ids[place == COMMON]
        body = place.tobytes() + rest.view(np.uint8).reshape(-1, 2).T.tobytes()
        return len(rest).to_bytes(4, "little") + self.codec.compress(body, asbytes=True)

    def unpack(self, raw: pa.Buffer, n: int) -> bytes:
        some = int.from_bytes(raw.slice(0, 4).to_pybytes(), "little")
        body = np.frombuffer(self.codec.decompress(raw.slice(4), n + 2 * some, asbytes=True), np.uint8)
        place = body[:n]
        ids = self.ids[place]
        ids[place == COMMON] = np.ascontiguousarray(body[n:].reshape(2, some).T).view("<u2").ravel()
        return ids.tobytes()


def _settle(where, made: str, path: str) -> None:
    """Give a whole file its name, in place of one that is there: another attempt's, which is equal, or an older one."""
    from pyarrow import fs

    if where.get_file_info(path).type == fs.FileType.File:
        where.delete_file(path)
    where.move(made, path)


def _token_file(root: str, part: int) -> str:
    return f"{root}/part-{part:08d}.parquet"


def token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """Write the ids of every text, an end-of-text after each, to one file a task under folder, in rows of at most PIECE
    ids. Returns (h, th, n, part, c): c documents of n ids with the hashes h (of id and text) and th (of the text) are in
    the file of `part`. Rows without h: the id th is there c times; of the ELIGIBLE commonest ids of a file. A file appears
    when it is whole."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        where, root = fs.FileSystem.from_uri(folder)
        part, counts, writer = TaskContext.get().partitionId(), Counter(), None
        made, e = f"{root}/.{part:08d}.{TaskContext.get().taskAttemptId()}", encoder(shared.value)
        seen, few, some = np.zeros(1 << 16, np.int64), [np.zeros(0, "<u2")], 0
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            at: list[int] = []
            for k, (h, th, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3))):
                ids = np.append(e.encode_to_numpy(text.as_py(), allowed_special=set(), disallowed_special=()), EOT).astype("<u2")
                counts[h, th, len(ids)] += 1
                few.append(ids)
                some += len(ids)
                if some >= 1 << 18:
                    seen += np.bincount(np.concatenate(few), minlength=1 << 16)
                    few, some = [], 0
                for a in range(0, len(ids), PIECE):
                    at.append(k)
                    for c, v in zip(cols, (h, th, len(ids), a, ids[a : a + PIECE].tobytes())):
                        c.append(v)
            table = pa.table([*[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], batch.column(2).take(pa.array(at, pa.int64()))], names=["h", "th", "n", "at", "tokens", "doc_id"])
            if writer is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(made)
                writer = parquet.ParquetWriter(out, table.schema, compression="zstd", compression_level=FILE_LEVEL)
            writer.write_table(table)
        if writer is not None:
            writer.close()
            out.close()
            _settle(where, made, _token_file(root, part))
        if few:
            seen += np.bincount(np.concatenate(few), minlength=1 << 16)
        rows = list(counts.items())
        rows += [((None, int(k), None), int(seen[k])) for k in np.argsort(-seen, kind="stable")[:ELIGIBLE] if seen[k]]
        yield pa.RecordBatch.from_arrays([*[pa.array([k[j] for k, _ in rows], pa.int64()) for j in range(3)], pa.array([part] * len(rows), pa.int32()), pa.array([c for _, c in rows], pa.int64())], names=["h", "th", "n", "part", "c"])

    th = F.xxhash64(F.col(text_col))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), th.cast("string"))
    rows = docs.where(F.col(text_col).isNotNull()).select(key_hash(key, "order:").alias("h"), th.alias("th"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scratch_table(rows.mapInArrow(run, "h bigint, th bigint, n bigint, part int, c bigint"), "order")


def places(counts: DataFrame, rows: int) -> DataFrame:
    """(part, h, th, n, start): where the first of the documents of that key in the file of part begins in the stream of
    all documents, which is in the order of their keys. Keys are summed within ranges of h, then the ranges."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / RUN)))
    run = counts.withColumn("range", F.shiftright("h", 60 - bits)).withColumn("size", F.col("n") * F.col("c"))
    ranges = cut(run.groupBy("range").agg(F.sum("size").alias("size")))
    bases = ranges.select(F.col("range").alias("r"), (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("range").orderBy("h", "th", "n", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return run.withColumn("inside", inside).join(bounded(bases), F.col("range") == F.col("r")).select("part", "h", "th", "n", (F.col("inside") + F.col("base")).alias("start"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, sequence: int = SEQUENCE,
                   shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """(slot, shard, byte_offset, seq, doc_ids, tokens): one row per sequence of `sequence` ids.

    The texts, in the order of a hash of their ids and texts, are cut into sequences; the last is filled with end-of-text
    ids. Sequence seq has slot permutation(seq), which is place slot % shard_slots of shard slot // shard_slots; all
    sequences have the same stride, so the slot gives the byte offset. Partitions hold whole shards, sorted by slot. The
    same rows give the same slots, however they lie in files and tasks.

    A null text gives nothing, an empty one its end-of-text id. Repeated rows are texts of their own; ids are of any type
    and may be null. Texts without a token in them and special strings are ordinary text. An empty table gives no rows;
    extra columns are ignored. The tokens are shuffled once; the order is that of narrow rows, of which equal ones are one
    a task."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    folder = scratch_path(spark, "tokens")
    counts = token_files(docs, folder, id_col, text_col, ranks_path)
    common = [r["th"] for r in counts.where("h is null").groupBy("th").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "th").limit(COMMON).collect()]
    counts = counts.where("h is not null")
    rows, parts, total = counts.agg(F.count(F.lit(1)), F.max("part"), F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0))).first()
    n = -(-total // sequence)
    if not n:
        return spark.createDataFrame([], f"slot bigint, shard int, byte_offset bigint, seq bigint, doc_ids array<{id_type}>, tokens binary")
    shards = -(-n // shard_slots)
    slots = SlotPermutation(n, key)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        where, root, code = *fs.FileSystem.from_uri(folder), PieceCode(common)
        starts: dict[int, dict[tuple[int, int, int], int]] = {}
        for batch in batches:
            for part, h, th, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                starts.setdefault(part, {})[h, th, size] = start
        for part, first in starts.items():
            o = 0
            for batch in parquet.ParquetFile(where.open_input_file(_token_file(root, part))).iter_batches(1024):
                out: tuple[list, ...] = ([], [], [], [], [])
                for k, (h, th, size, at, raw) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(4)], batch.column(4))):
                    if not at:
                        o = first[h, th, size]
                        first[h, th, size] = o + size
                    ids = np.frombuffer(raw.as_buffer(), "<u2")
                    some, done = len(ids), 0
                    while done < some:
                        s, inside = divmod(o + at + done, sequence)
                        take = min(sequence - inside, some - done)
                        for c, v in zip(out, (s, inside, k, take, code.pack(ids[done : done + take]))):
                            c.append(v)
                        done += take
                seq = np.array(out[0], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots(seq)), pa.array(seq), pa.array(out[1], pa.int32()), batch.column(5).take(pa.array(out[2], pa.int64())), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())],
                                                 names=["slot", "seq", "inside", "doc_id", "n", "tokens"])

    placed = places(counts, rows).repartitionById(parts + 1, F.col("part"))
    pieces = placed.mapInArrow(cut_up, f"slot bigint, seq bigint, inside int, doc_id {id_type}, n int, tokens binary")
    by_shard = pieces.repartitionById(shards, F.floor(F.col("slot") / shard_slots).cast("int")).sortWithinPartitions("slot", "inside")
    fill = np.full(sequence, EOT, "<u2").tobytes()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted pieces to whole sequences; a sequence may run on into the next batch."""
        slot = seq = kind = None
        code = PieceCode(common)
        raw: list[bytes] = []
        ids: list = []

        def whole() -> bytes:
            b = b"".join(raw)
            return b + fill[len(b) :]

        for batch in batches:
            kind = batch.column(3).type
            done: tuple[list, ...] = ([], [], [], [])
            for s, q, d, size, t in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3, 4)], batch.column(5)):
                if s != slot:
                    if slot is not None:
                        for c, v in zip(done, (slot, seq, ids, whole())):
                            c.append(v)
                    slot, seq, raw, ids = s, q, [], []
                raw.append(code.unpack(t.as_buffer(), size))
                if not ids or ids[-1] != d:
                    ids.append(d)
            yield records(done, kind)
        if slot is not None:
            yield records(([slot], [seq], [ids], [whole()]), kind)

    def records(done: tuple[list, ...], kind: pa.DataType) -> pa.RecordBatch:
        slot = np.array(done[0], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot % shard_slots * (2 * sequence)), pa.array(done[1], pa.int64()),
                                           pa.array(done[2], pa.list_(kind)), pa.array(done[3], pa.binary())],
                                          names=["slot", "shard", "byte_offset", "seq", "doc_ids", "tokens"])

    return by_shard.mapInArrow(join, f"slot bigint, shard int, byte_offset bigint, seq bigint, doc_ids array<{id_type}>, tokens binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(records: DataFrame, uri: str, through: bool = False) -> DataFrame:
    """Write the records of training_order() as uri/shard-N.bin, fixed strides in slot order. A file appears under its
    name when it is whole, so tasks may be tried again. A shard that is there is replaced; others in the folder stay, so
    a shorter order needs a new folder. Without records no file is written. Returns the written (shard, slots, bytes),
    written once; through: the records themselves, whose shards are written as they are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(uri)
        where.create_dir(root, recursive=True)
        out = shard = part = None
        n = size = 0
        done: list[tuple[int, int, int]] = []

        def close() -> None:
            out.close()
            _settle(where, part, f"{root}/{shard_name(shard)}")
            done.append((shard, n, size))

        for batch in batches:
            for s, t in zip(batch.column("shard").to_pylist(), batch.column("tokens")):
                if s != shard:
                    if out is not None:
                        close()
                    shard, n, size = s, 0, 0
                    part = f"{root}/.{shard_name(s)}.{TaskContext.get().taskAttemptId()}"
                    out = where.open_output_stream(part)
                b = t.as_buffer()
                out.write(b)
                n, size = n + 1, size + b.size
            if through:
                yield batch
        if out is not None:
            close()
        if through:
            return
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["shard", "slots", "bytes"])

    if through:
        return records.mapInArrow(run, records.schema)
    return cut(records.select("shard", "tokens").mapInArrow(run, "shard int, slots bigint, bytes bigint"))


def read_slots(uri: str, start: int = 0, sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS) -> Iterator[np.ndarray]:
    """Sequences from slot `start` on: a seek, then sequential reads; the place to resume is the slot alone."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(uri)
    shard, inside = divmod(start, shard_slots)
    while where.get_file_info(path := f"{root}/{shard_name(shard)}").type == fs.FileType.File:
        with where.open_input_file(path) as f:
            f.seek(inside * sequence * 2)
            while len(b := f.read(sequence * 2)) == sequence * 2:
                yield np.frombuffer(b, "<u2")
        shard, inside = shard + 1, 0

"""AVI motion-JPEG columns: RIFF indexes, baseline JPEG frames, shots by adaptive histogram differences."""

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Production parameters of shot detection: frames on each side that set the local level, its multiple and the least
#: difference (0 to 1) of a cut, and the fewest frames of a shot.
WINDOW, FACTOR, FLOOR, MIN_SHOT = 8, 4.0, 0.3, 2

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
                   35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_DCT = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Coefficients in zigzag order to pixels in rows.
_IDCT = np.einsum("ux,vy->uvxy", _DCT, _DCT).reshape(64, 64)[ZIGZAG]

#: Blocks that are decoded before they are counted, over all frames that are decoded together; bytes and number of those
#: frames; films whose rows are made together.
WINDOW_BLOCKS, TOGETHER_BYTES, TOGETHER_FRAMES, FILMS = 1 << 15, 16 << 20, 2048, 256


def _std_tables() -> dict[tuple[int, int], bytes]:
    """The Huffman tables of the JPEG standard's annex K, which motion-JPEG frames may leave out: 16 counts and the
    symbols, by (class, number)."""
    dc = bytes(range(12))
    # Symbols of the AC tables in order of code length: run << 4 | size.
    lum = ("0102 03 000411 0512 213141 0613516107 227114 328191a1 082342b1c1 1552d1f0 24336272 82"
           "090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a"
           "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")
    chrom = ("0001 02 0311 04052131 06124151 076171 1322328108144291a1b1c1 09233352f0 156272d1 0a162434 e1 25f1"
             "1718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a"
             "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa")
    return {(0, 0): bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + dc, (0, 1): bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]) + dc,
            (1, 0): bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + bytes.fromhex(lum.replace(" ", "")),
            (1, 1): bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]) + bytes.fromhex(chrom.replace(" ", ""))}


STANDARD = _std_tables()


class MediaError(ValueError):
    """The bytes aren't what the format says."""


@lru_cache(maxsize=64)
def huffman_lookup(table: bytes) -> tuple[list[int], list[int]]:
    """(lengths, symbols) by the next 16 bits; length 0: no code."""
    lengths, symbols, code, k = [0] * 65536, [0] * 65536, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            span = 1 << (16 - n)
            at = code << (16 - n)
            if at + span > 65536 or k >= len(table):
                raise MediaError("bad Huffman table")
            lengths[at : at + span], symbols[at : at + span] = [n] * span, [table[k]] * span
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


def huffman_codes(table: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, k = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[table[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Frame:
    """Headers of a baseline JPEG: height, width, parts (id, h, v, quantisation table), Huffman tables by part, restart
    interval, and the entropy-coded segments; missing Huffman tables are the standard ones."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise MediaError("no JPEG")
        quant: dict[int, np.ndarray] = {}
        huff, frame, self.restart, at = dict(STANDARD), None, 0, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    length = 128 if wide else 64
                    if len(body) < 1 + length:
                        raise MediaError("bad quantisation table")
                    quant[n] = np.frombuffer(body[1 : 1 + length], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[1 + length :]
            elif marker == 0xC4:
                while len(body) >= 17:
                    n = 17 + sum(body[1:17])
                    huff[body[0] >> 4, body[0] & 15] = bytes(body[1:n])
                    body = body[n:]
            elif marker in (0xC0, 0xC1):
                if len(body) < 6 or body[0] != 8:
                    raise MediaError("only 8-bit frames")
                parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, min(len(body) - 2, 6 + 3 * body[5]), 3)]
                frame = (int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), parts)
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise MediaError("only baseline frames")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if frame is None or not frame[0] or not frame[1] or not frame[2]:
                    raise MediaError("scan before frame")
                chosen = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
                break
        else:
            raise MediaError("no scan")
        if frame is None or marker != 0xDA:
            raise MediaError("no scan")
        self.height, self.width, parts = frame
        if not all(p[1] and p[2] for p in parts):
            raise MediaError("bad sampling")
        self.hmax, self.vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        if any(p[0] not in chosen or p[3] not in quant for p in parts):
            raise MediaError("missing table")
        self.parts = tuple(p[1:3] for p in parts)
        self.tables = tuple((huff.get((0, chosen[p[0]][0])), huff.get((1, chosen[p[0]][1]))) for p in parts)
        if any(t is None for pair in self.tables for t in pair):
            raise MediaError("missing table")
        self.quant = [quant[p[3]] for p in parts]
        self.mx, self.my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.segments = _segments(data, at)

    def layout(self) -> tuple:
        """Frames of one layout can be decoded together."""
        return self.height, self.width, self.parts, self.tables

    def plane(self, c: int) -> tuple[int, int]:
        h, v = self.parts[c]
        return -(-self.height * v // self.vmax), -(-self.width * h // self.hmax)

    def runs(self) -> list[tuple[int, int, bytes]]:
        """(first unit, units, bytes) of each segment that can be decoded alone."""
        units = self.mx * self.my
        per, out, done = self.restart or units, [], 0
        for seg in self.segments:
            if done >= units:
                break
            out.append((done, min(per, units - done), seg))
            done += out[-1][1]
        if done < units:
            raise MediaError("truncated scan")
        return out


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The planes (uint8) of a baseline JPEG, each at its own sampling; one frame by itself, unit by unit."""
    f = Frame(data)
    coefs: list[list] = [[] for _ in f.parts]
    plan = [(c, *huffman_lookup(f.tables[c][0]), *huffman_lookup(f.tables[c][1])) for c, (h, v) in enumerate(f.parts) for _ in range(h * v)]
    for _, n, seg in f.runs():
        _entropy(seg, n, plan, coefs)
    planes = []
    for c, ((h, v), blocks) in enumerate(zip(f.parts, coefs)):
        x = np.zeros((len(blocks), 64))
        for k, (places, values) in enumerate(blocks):
            x[k, places] = values
        pixels = np.clip(np.rint((x * f.quant[c]) @ _IDCT + 128), 0, 255).astype(np.uint8)
        image = pixels.reshape(f.my, f.mx, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(f.my * v * 8, f.mx * h * 8)
        rows, cols = f.plane(c)
        planes.append(image[:rows, :cols])
    return planes


def _segments(data: bytes, at: int) -> list[bytes]:
    """Entropy-coded segments between restart markers, without stuffing."""
    out, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            out.append(data[start:])
            break
        m = data[k + 1]
        if m == 0 or m == 0xFF:
            at = k + (2 if m == 0 else 1)
            continue
        out.append(data[start:k])
        if not 0xD0 <= m <= 0xD7:
            break
        start = at = k + 2
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def _entropy(seg: bytes, mcus: int, plan, coefs) -> None:
    """Decode the blocks of `mcus` units: (zigzag places, values) each."""
    pred = [0] * len(coefs)
    buf = bits = pos = 0
    size = len(seg)
    for _ in range(mcus):
        for c, dlen, dsym, alen, asym in plan:
            if bits < 32:
                if pos > size + 16:
                    raise MediaError("truncated scan")
                buf = ((buf & ((1 << bits) - 1)) << 48) | int.from_bytes(seg[pos : pos + 6].ljust(6, b"\xff"), "big")
                pos, bits = pos + 6, bits + 48
            look = (buf >> (bits - 16)) & 0xFFFF
            n, s = dlen[look], dsym[look]
            if not n or s > 15:
                raise MediaError("bad code")
            bits -= n
            if s:
                bits -= s
                v = (buf >> bits) & ((1 << s) - 1)
                pred[c] += v if v >> (s - 1) else v - (1 << s) + 1
            places, values, k = [0], [pred[c]], 1
            while k < 64:
                if bits < 32:
                    if pos > size + 16:
                        raise MediaError("truncated scan")
                    buf = ((buf & ((1 << bits) - 1)) << 48) | int.from_bytes(seg[pos : pos + 6].ljust(6, b"\xff"), "big")
                    pos, bits = pos + 6, bits + 48
                look = (buf >> (bits - 16)) & 0xFFFF
                n, rs = alen[look], asym[look]
                if not n:
                    raise MediaError("bad code")
                bits -= n
                s = rs & 15
                if not s:
                    if rs != 0xF0:
                        break
                    k += 16
                    continue
                k += rs >> 4
                if k > 63:
                    raise MediaError("bad run")
                bits -= s
                v = (buf >> bits) & ((1 << s) - 1)
                places.append(k)
                values.append(v if v >> (s - 1) else v - (1 << s) + 1)
                k += 1
            coefs[c].append((places, values))
    if pos - bits // 8 > size + 2:
        raise MediaError("truncated scan")


@lru_cache(maxsize=16)
def _codes(tables: tuple[tuple[bytes, bytes], ...]) -> np.ndarray:
    """length | symbol << 5 by the next 16 bits, of the DC and AC tables of each part in turn."""
    out = np.zeros((2 * len(tables), 65536), np.int64)
    for k, table in enumerate(t for pair in tables for t in pair):
        lengths, symbols = huffman_lookup(table)
        out[k] = np.array(lengths) | np.array(symbols) << 5
    return out.ravel()


def level_counts(frames: list[Frame]) -> tuple[np.ndarray, np.ndarray]:
    """((frames, parts, 256) counts of pixel values, whether the frame could be decoded) of frames of one layout.

    The segments of all frames are decoded side by side, one symbol of each at a time, over arrays. After some units the
    blocks are turned to pixels and counted, and their room is used again, so memory doesn't depend on the frames' size."""
    f = frames[0]
    counts, good = np.zeros((len(frames), len(f.parts), 256), np.int64), np.ones(len(frames), bool)
    of, first, units, segs = [], [], [], []
    for i, x in enumerate(frames):
        try:
            runs = x.runs()
        except MediaError:
            good[i] = False
            continue
        for a, n, seg in runs:
            of.append(i)
            first.append(a)
            units.append(n)
            segs.append(seg)
    if not of:
        return counts, good
    of, first, units = (np.array(x, np.int64) for x in (of, first, units))
    sizes = np.array([len(x) for x in segs], np.int64)
    base = np.cumsum(np.r_[0, sizes[:-1] + 16])
    buffer = (b"\xff" * 16).join(segs) + b"\xff" * 24
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, 0, (1,))  # the 8 bytes from each byte on
    part = np.array([c for c, (h, v) in enumerate(f.parts) for _ in range(h * v)])
    nb, nc, codes = len(part), len(f.parts), _codes(f.tables)
    table = np.stack([2 * part, 2 * part + 1], axis=1).ravel() << 16
    half = np.array([0, *[1 << s for s in range(15)]], np.int64)
    full = np.array([(1 << s) - 1 for s in range(16)], np.int64)
    quant = [np.stack([x.quant[c] for x in frames]) for c in range(nc)]
    lanes = len(of)
    pos, end = 8 * base, 8 * (base + sizes + 2)
    pred, done, alive = np.zeros(lanes * nc, np.int64), np.zeros(lanes, np.int64), np.ones(lanes, bool)
    wide = max(1, min(int(units.max()), WINDOW_BLOCKS // (lanes * nb)))
    while (open_ := np.flatnonzero(alive & (done < units))).size:
        coefs = np.zeros(len(open_) * wide * nb * 64 + 1, np.int32)  # the last is for what isn't written
        limit = np.minimum(wide, units[open_] - done[open_]) * nb
        lane, row, p = open_, np.arange(len(open_)), pos[open_]
        k = np.zeros(len(open_), np.int64)
        block = np.zeros(len(open_), np.int64)
        while len(lane):
            w = words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
            j = block % nb
            dc = k == 0
            e = codes[table[2 * j + ~dc] + (w >> np.uint64(48)).astype(np.int64)]
            n, sym = e & 31, e >> 5
            size, run = sym & 15, sym >> 4
            v = ((w << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            v -= full[size] * (v < half[size])
            at = lane * nc + part[j]
            total = pred[at] + v * dc
            pred[at] = total
            v = np.where(dc, total, v)
            stop = ~dc & (size == 0) & (sym != 0xF0)
            k = np.where(stop, k, k + run)
            put = dc | (size > 0)
            wrong = (n == 0) | (dc & (run > 0)) | (put & (k > 63)) | (p > end[lane])
            coefs[np.where(put & ~wrong, (row * wide * nb + block) * 64 + k, len(coefs) - 1)] = v
            p = p + n + size
            over = stop | (k >= 63)
            block = block + over
            k = np.where(over, 0, k + 1)
            out = wrong | (block == limit[row])
            if out.any():
                alive[lane[wrong]] = False
                pos[lane[out]] = p[out]
                lane, row, p, k, block = (x[~out] for x in (lane, row, p, k, block))
        alive[open_] &= pos[open_] <= end[open_]
        blocks = coefs[:-1].reshape(len(open_), wide, nb, 64)
        unit = first[open_, None] + done[open_, None] + np.arange(wide)
        there = np.arange(wide) < (limit // nb)[:, None]
        for c in range(nc):
            (h, v), (rows, cols) = f.parts[c], f.plane(c)
            mine = np.flatnonzero(part == c)
            x = blocks[:, :, mine][there]
            frame = np.repeat(of[open_], there.sum(axis=1))
            pixels = np.clip(np.rint((x * quant[c][frame][:, None]).reshape(-1, 64) @ _IDCT + 128), 0, 255).astype(np.int64)
            u = unit[there][:, None]
            top, left = 8 * (u // f.mx * v + np.arange(h * v) // h), 8 * (u % f.mx * h + np.arange(h * v) % h)
            cell = np.repeat(frame, h * v)[:, None] * 256 + pixels
            cut = (top + 8 > rows) | (left + 8 > cols)
            if cut.any():
                inside = (top.reshape(-1, 1) + np.arange(64) // 8 < rows) & (left.reshape(-1, 1) + np.arange(64) % 8 < cols)
                cell = cell[inside]
            counts[:, c] += np.bincount(cell.ravel(), minlength=256 * len(frames)).reshape(-1, 256)
        done[open_] += limit // nb
    good[of[~alive]] = False
    return counts, good


class Avi:
    """Header and frame index of an AVI file. Frames come from OpenDML indexes, else from idx1, else from a walk over
    the movi list; an index that doesn't point at chunks is not trusted."""

    def __init__(self, data: bytes):
        self.data, self.usec, self.width, self.height = data, 0, 0, 0
        self.stream, self.codec, self.scale, self.rate = None, b"", 0, 0
        self.movi: list[tuple[int, int]] = []
        self.idx1 = b""
        self.supers: list[tuple[int, bytes]] = []
        streams: list[bytes] = []
        if data[:4] != b"RIFF" or data[8:12] not in (b"AVI ", b"AVIX"):
            raise MediaError("no AVI")
        at = 0
        while data[at : at + 4] == b"RIFF":
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            self._list(at + 12, min(len(data), at + 8 + size), streams)
            at += 8 + size + (size & 1)
        if self.stream is None:
            raise MediaError("no video stream")
        if self.codec.upper() not in (b"MJPG", b"AVRN", b"JPEG", b"LJPG"):
            raise MediaError(f"codec {self.codec!r}")
        if self.scale and self.rate:
            self.usec = 1e6 * self.scale / self.rate
        if not self.usec:
            raise MediaError("no frame rate")

    def _list(self, at: int, end: int, streams: list) -> None:
        while at + 8 <= end:
            name, size = self.data[at : at + 4], int.from_bytes(self.data[at + 4 : at + 8], "little")
            body, stop = at + 8, min(at + 8 + size, len(self.data))
            if name == b"LIST":
                kind = self.data[body : body + 4]
                if kind == b"movi":
                    self.movi.append((body + 4, stop))
                elif kind in (b"hdrl", b"strl", b"odml"):
                    self._list(body + 4, stop, streams)
            elif name == b"avih" and size >= 40:
                self.usec = int.from_bytes(self.data[body : body + 4], "little")
                self.width, self.height = struct.unpack("<II", self.data[body + 32 : body + 40])
            elif name == b"strh" and size >= 28:
                streams.append(self.data[body : body + 4])
                if streams[-1] == b"vids" and self.stream is None:
                    self.stream = len(streams) - 1
                    self.codec = self.data[body + 4 : body + 8]
                    self.scale, self.rate = struct.unpack("<II", self.data[body + 20 : body + 28])
            elif name == b"strf" and streams and self.stream == len(streams) - 1 and size >= 20:
                code = self.data[body + 16 : body + 20]
                self.codec = code if code.strip(b"\0") else self.codec
            elif name == b"indx" and streams and self.stream == len(streams) - 1:
                self.supers.append((body, self.data[body:stop]))
            elif name == b"idx1":
                self.idx1 = self.data[body:stop]
            at = body + size + (size & 1)

    def _own(self, name: bytes) -> bool:
        return name[:2] == b"%02d" % self.stream and name[2:4] in (b"dc", b"db")

    def frames(self) -> list[tuple[int, int]]:
        """(offset, size) of every frame in order; size 0 repeats the frame before."""
        for found in (self._odml(), self._idx1()):
            if found:
                return found
        out = []
        for at, end in self.movi:
            self._walk(at, end, out)
        return out

    def _odml(self) -> list[tuple[int, int]]:
        out = []
        for _, x in self.supers:
            if len(x) < 24 or x[3] != 0:
                return []
            for k in range(int.from_bytes(x[4:8], "little")):
                entry = x[24 + 16 * k : 40 + 16 * k]
                if len(entry) < 16:
                    return []
                at = int.from_bytes(entry[:8], "little")
                chunk = self.data[at : at + 8 + int.from_bytes(entry[8:12], "little")]
                if chunk[:2] != b"ix" or len(chunk) < 32:
                    return []
                count, base = int.from_bytes(chunk[12:16], "little"), int.from_bytes(chunk[20:28], "little")
                for j in range(count):
                    e = chunk[32 + 8 * j : 40 + 8 * j]
                    if len(e) < 8:
                        return []
                    out.append((base + int.from_bytes(e[:4], "little"), int.from_bytes(e[4:], "little") & 0x7FFFFFFF))
        return out if all(o + n <= len(self.data) for o, n in out) else []

    def _idx1(self) -> list[tuple[int, int]]:
        entries = [(self.idx1[k : k + 4], *struct.unpack("<II", self.idx1[k + 8 : k + 16])) for k in range(0, len(self.idx1) - 15, 16)]
        entries = [e for e in entries if self._own(e[0])]
        if not entries or not self.movi:
            return []
        for base in (self.movi[0][0] - 4, 0):  # offsets count from the list's name, or from the file's start
            if all(self.data[base + o : base + o + 4] == name and int.from_bytes(self.data[base + o + 4 : base + o + 8], "little") == n and base + o + 8 + n <= len(self.data) for name, o, n in entries):
                return [(base + o + 8, n) for _, o, n in entries]
        return []

    def _walk(self, at: int, end: int, out: list) -> None:
        while at + 8 <= end:
            name, size = self.data[at : at + 4], int.from_bytes(self.data[at + 4 : at + 8], "little")
            if name == b"LIST":
                self._walk(at + 12, min(end, at + 8 + size), out)
            elif self._own(name) and at + 8 + size <= len(self.data):
                out.append((at + 8, size))
            at += 8 + size + (size & 1)


def _bins(bins: int) -> np.ndarray:
    """(256, bins): the shares of a pixel value in its two nearest bins."""
    x = np.arange(256) * (bins - 1) / 255
    lo, out = x.astype(np.int64), np.zeros((256, bins + 1))
    out[np.arange(256), lo] += 1 - (x - lo)
    out[np.arange(256), lo + 1] += x - lo
    return out[:, :bins]


LUMA, CHROMA = _bins(32), _bins(16)


def histogram(planes: list[np.ndarray]) -> np.ndarray:
    return histogram_of([np.bincount(p.ravel(), minlength=256) for p in planes])


def histogram_of(counts) -> np.ndarray:
    """32 luma bins and 16 for each chroma plane, shares of the pixels, from counts of pixel values. A value counts in
    its two nearest bins, so that slow drift over a bin's edge changes little."""
    out = [c @ (CHROMA if k else LUMA) / c.sum() for k, c in enumerate(counts[:3])]
    weight = [0.6, 0.2, 0.2] if len(out) == 3 else [1 / len(out)] * len(out)
    return np.concatenate([h * w for h, w in zip(out, weight)])


def cuts(hists: list[np.ndarray], window: int = WINDOW, factor: float = FACTOR, floor: float = FLOOR, min_shot: int = MIN_SHOT) -> list[int]:
    """First frames of the shots. A cut is where the histogram difference is at least `floor` and at least `factor`
    times the median of the differences within `window` frames, and is the largest within min_shot frames."""
    if not hists:
        return []
    d = np.array([0.0] + [0.5 * np.abs(a - b).sum() for a, b in zip(hists, hists[1:])])
    starts = [0]
    for t in range(1, len(d)):
        near = np.r_[d[max(1, t - window) : t], d[t + 1 : t + 1 + window]]
        level = float(np.median(near)) if len(near) else 0.0
        around = d[max(1, t - min_shot + 1) : t + min_shot]
        if d[t] >= max(floor, factor * level) and d[t] >= around.max() and t - starts[-1] >= min_shot:
            starts.append(t)
    return starts


def histograms(frames: list[bytes]) -> list[tuple[np.ndarray, tuple[int, int]] | None]:
    """(histogram, size) of each JPEG, None where it can't be decoded. Those of one layout are decoded together."""
    out: list = [None] * len(frames)
    groups: dict[tuple, list[tuple[int, Frame]]] = {}
    for i, data in enumerate(frames):
        try:
            f = Frame(data)
            groups.setdefault(f.layout(), []).append((i, f))
        except (MediaError, IndexError, ValueError):
            pass
    for group in groups.values():
        try:
            counts, good = level_counts([f for _, f in group])
        except MediaError:
            continue
        for (i, f), c, ok in zip(group, counts, good):
            if ok:
                out[i] = (histogram_of(c), f.plane(0))
    return out


_NONE = dict.fromkeys(("clip", "start_frame", "n_frames", "start_s", "end_s", "width", "height", "error"))


def _opened(data: bytes) -> tuple[Avi, list[tuple[int, int]]] | str:
    try:
        film = Avi(data)
        return film, film.frames()
    except (MediaError, struct.error, IndexError, ValueError, RecursionError) as e:
        return str(e) or type(e).__name__


def films_rows(films: list[bytes | None]) -> list[list[dict]]:
    """The rows of each film: one per shot; of media that can't be read, one row with the error. Frames of all films
    are decoded together, TOGETHER_BYTES and TOGETHER_FRAMES of them at most at a time."""
    opened = [None if d is None else _opened(d) for d in films]
    found: list[list] = [[] if isinstance(o, tuple) else None for o in opened]
    some: list[tuple[int, bytes]] = []

    def decode() -> None:
        for (i, _), h in zip(some, histograms([b for _, b in some])):
            found[i].append(h)
        some.clear()

    held = 0
    for i, o in enumerate(opened):
        for at, n in o[1] if isinstance(o, tuple) else ():
            if n:
                some.append((i, films[i][at : at + n]))
                held += n
                if held > TOGETHER_BYTES or len(some) >= TOGETHER_FRAMES:
                    decode()
                    held = 0
    decode()
    return [[] if o is None else [_NONE | {"error": o}] if isinstance(o, str) else _shots(*o, found[i]) for i, o in enumerate(opened)]


def _shots(film: Avi, frames: list[tuple[int, int]], decoded: list) -> list[dict]:
    hists: list[np.ndarray] = []
    size, bad, last, them = (0, 0), 0, None, iter(decoded)
    for _, n in frames:
        if n:
            h = next(them)
            if h is None:
                bad += 1
            else:
                last, size = h
        if last is not None:
            hists.append(last)
    if not hists:
        return [_NONE | {"error": "no frame can be decoded"}]
    starts = cuts(hists)
    return [_NONE | {"clip": k, "start_frame": a, "n_frames": b - a, "start_s": a * film.usec / 1e6, "end_s": b * film.usec / 1e6, "width": size[1], "height": size[0],
                     "error": f"{bad} frames can't be decoded" if bad else None} for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(hists)]))]


def clip_rows(data: bytes | None) -> list[dict]:
    return films_rows([data])[0]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("clip", T.IntegerType()), ("start_frame", T.IntegerType()), ("n_frames", T.IntegerType()), ("start_s", T.DoubleType()),
                                                                       ("end_s", T.DoubleType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("error", T.StringType()))])))
def clips_of(media: pd.Series) -> pd.Series:
    films, out = media.to_numpy(), []
    for a in range(0, len(films), FILMS):
        out += films_rows([bytes(b) if b is not None else None for b in films[a : a + FILMS]])
    return pd.Series(out, index=media.index, dtype=object)


def clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, clip, start_frame, n_frames, start_s, end_s, width, height, error): one row per shot of each row's AVI.

    Null media give no rows; media that are empty, broken, of another codec or without a frame give one row with the
    error and nulls. A frame that can't be decoded, or of size 0, repeats the one before; leading ones are dropped,
    and the error tells their number. Repeated rows and ids give rows each; extra columns are ignored. Row by row:
    no shuffle."""
    return media.select(F.col(id_col), F.explode(clips_of(F.col(media_col))).alias("c")).select(id_col, "c.*")


# --- Fixture: media rendered from embeddings


class _Bits:
    def __init__(self):
        self.acc = self.n = 0

    def put(self, v: int, n: int) -> None:
        self.acc, self.n = (self.acc << n) | v, self.n + n

    def done(self) -> bytes:
        pad = -self.n % 8
        return (((self.acc << pad) | ((1 << pad) - 1)).to_bytes((self.n + pad) // 8, "big")).replace(b"\xff", b"\xff\x00")


_CODES = {k: huffman_codes(t) for k, t in STANDARD.items()}


def encode_jpeg(planes: list[np.ndarray], q: int = 8, sampling: int = 2, restart: int = 0, tables: bool = False) -> bytes:
    """A baseline JPEG of Y (multiples of 8 * sampling) and, if given, Cb and Cr at 1/sampling, all quantised by q."""
    blocks = []
    for p in planes:
        h, w = p.shape
        b = p.astype(np.float64).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128
        blocks.append(np.rint((_DCT @ b @ _DCT.T / q).reshape(h // 8, w // 8, 64)[..., ZIGZAG]).astype(int))
    s = sampling if len(planes) == 3 else 1
    rows, cols = blocks[0].shape[0] // s, blocks[0].shape[1] // s
    out, bits, pred, n = b"", _Bits(), [0] * len(planes), 0
    for y in range(rows):
        for x in range(cols):
            if restart and n and n % restart == 0:
                out += bits.done() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                bits, pred = _Bits(), [0] * len(planes)
            n += 1
            for c, b in enumerate(blocks):
                f = s if c == 0 else 1
                for v in range(f):
                    for u in range(f):
                        pred[c] = _put_block(bits, b[y * f + v, x * f + u].tolist(), pred[c], _CODES[0, int(c > 0)], _CODES[1, int(c > 0)])
    h, w = planes[0].shape
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([q]) * 64
    if tables:
        for (k, t), table in STANDARD.items():
            head += b"\xff\xc4" + struct.pack(">HB", 3 + len(table), k << 4 | t) + table
    head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, h, w, len(planes)) + b"".join(bytes([c + 1, (s << 4 | s) if c == 0 else 0x11, 0]) for c in range(len(planes)))
    if restart:
        head += b"\xff\xdd\x00\x04" + struct.pack(">H", restart)
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes)) + b"".join(bytes([c + 1, 0x11 if c else 0]) for c in range(len(planes))) + b"\x00\x3f\x00"
    return head + out + bits.done() + b"\xff\xd9"


def _put_block(bits: _Bits, zz: list[int], pred: int, dc: dict, ac: dict) -> int:
    def value(v: int, size: int) -> None:
        bits.put(v if v > 0 else v + (1 << size) - 1, size)

    diff = zz[0] - pred
    size = abs(diff).bit_length()
    bits.put(*dc[size])
    if size:
        value(diff, size)
    run = 0
    for v in zz[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            bits.put(*ac[0xF0])
            run -= 16
        size = abs(v).bit_length()
        bits.put(*ac[run << 4 | size])
        value(v, size)
        run = 0
    if run:
        bits.put(*ac[0])
    return zz[0]


def write_avi(frames: list[bytes], width: int, height: int, usec: int, index: str = "idx1") -> bytes:
    """A motion-JPEG AVI. index: 'idx1' (offsets from the list), 'absolute', 'odml' or 'none'."""
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    def header(indx: bytes) -> bytes:
        avih = struct.pack("<14I", usec, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
        strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, usec, 1_000_000, 0, len(frames), 0, 0, 0, 0, 0, width, height)
        strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
        strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + (chunk(b"indx", indx) if indx else b""))
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)

    movi, spots = b"", []
    for f in frames:
        spots.append((len(movi) + 4, len(f)))
        movi += chunk(b"00dc", f)
    blank = struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + b"\0" * 16 if index == "odml" else b""
    start = 12 + len(header(blank)) + 8  # of the movi list's name
    tail, indx = b"", blank
    if index == "odml":
        ix = struct.pack("<HBBI4sQI", 2, 0, 1, len(spots), b"00dc", start, 0) + b"".join(struct.pack("<II", o + 8, n) for o, n in spots)
        indx = blank[:24] + struct.pack("<QII", start + 4 + len(movi), len(ix), len(spots))
        movi += chunk(b"ix00", ix)
    elif index in ("idx1", "absolute"):
        tail = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, o + (start if index == "absolute" else 0), n) for o, n in spots))
    body = b"AVI " + header(indx) + chunk(b"LIST", b"movi" + movi) + tail
    return b"RIFF" + struct.pack("<I", len(body)) + body


FPS_USEC = 100_000


def render(vec_id: int, vector: np.ndarray) -> bytes:
    """A film of 1 + vec_id % 4 shots, shot k of 3 + (vec_id + k) % 4 frames at 10 a second: 32 x 32 pixels with the
    vector as texture, a brightness that jumps between shots and drifts within them."""
    frames = []
    v = np.resize(np.nan_to_num(np.asarray(vector, np.float64)), 64) if len(vector) else np.zeros(64)
    for k in range(1 + vec_id % 4):
        base = 40 + 55 * ((vec_id + k) % 4)
        texture = np.kron(np.clip(np.roll(v, 16 * k)[:16].reshape(4, 4) * 40, -12, 12), np.ones((8, 8)))
        chroma = [np.full((16, 16), 128.0 + s * 6 * ((vec_id + k) % 3)) for s in (1, -1)]
        for t in range(3 + (vec_id + k) % 4):
            frames.append(encode_jpeg([np.clip(base + texture + t, 0, 255), *chroma]))
    return write_avi(frames, 32, 32, FPS_USEC)


@F.pandas_udf(T.BinaryType())
def rendered(ids: pd.Series, vectors: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or i is None or i != i else render(int(i), v) for i, v in zip(ids, vectors)], dtype=object)


ORACLE = """
WITH s AS (SELECT vec_id, k AS clip, 3 + (vec_id + k) % 4 AS n FROM embeddings, generate_series(0, 3) g(k) WHERE k <= vec_id % 4 AND embedding IS NOT NULL),
c AS (SELECT vec_id, clip, n, sum(n) OVER (PARTITION BY vec_id ORDER BY clip) - n AS a FROM s)
SELECT vec_id, CAST(clip AS INTEGER) AS clip, CAST(a AS INTEGER) AS start_frame, CAST(n AS INTEGER) AS n_frames, CAST(a AS DOUBLE) / 10 AS start_s, CAST(a + n AS DOUBLE) / 10 AS end_s,
       32 AS width, 32 AS height, CAST(NULL AS VARCHAR) AS error FROM c
"""

"""Operator 5: media columns of AVI motion-JPEG, cut into timed clips.

The RIFF structure is parsed for the time base, the stream format and the frame
indexes: idx1 (offsets from the start of the file or of the frame list), OpenDML
index chunks, and whatever frame chunks a walk through all RIFF parts finds
beyond them.  Every frame is a baseline JPEG of its own and is decoded in full:
Huffman codes, dequantisation, inverse cosine transform; frames without code
tables use the usual ones.  All frames of a batch are decoded at once: each scan
or restart interval is a lane, and one numpy step takes one symbol off every
lane.  A cut lies where the histograms of neighbouring frames differ by more than
the mean of the differences around, plus several of their deviations, by half as
much again as that mean, and by ``least`` at any rate.

Results for odd input: a null or empty medium gives no rows; one that cannot be
parsed gives one row with ``error`` and no times; a frame that is empty (dropped
by its recorder) or cannot be decoded repeats the last one, and at the start the
first good one; a file of one frame is one clip; repeated rows each give
their clips; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 0.15
DEVIATIONS = 4.0
RATIO = 1.5
AROUND = 6
#: How many media, and bytes of them, are decoded together.
MEDIA, MEDIA_BYTES = 64, 16 << 20
SCHEMA = "media_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, width int, height int, error string"

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _runs(*ranges) -> bytes:
    return bytes(x for a, b in ranges for x in range(a, b + 1))


_TAILS = [(t, t + (8 if t & 15 == 2 else 7)) for t in (0x43, 0x53, 0x63, 0x73)]
#: The code tables of most motion-JPEG files (T.81, annex K): number of codes by length, and their symbols.
TABLES = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a34353637 38393a".replace(" ", ""))
        + _runs(*_TAILS, (0x83, 0x8A), *[(t + 2, t + 10) for t in range(0x90, 0xE0, 16)], (0xE1, 0xEA), (0xF1, 0xFA)),
    ),
    (1, 1): (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a".replace(" ", ""))
        + _runs(*_TAILS, *[(t + 2, t + 10) for t in range(0x80, 0x100, 16)]),
    ),
}


@lru_cache(maxsize=256)
def _decoder(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For any next 16 bits, 256 * code length + symbol (0: no such code)."""
    table, code, k = np.zeros(65536, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            start = code << (16 - n)
            table[start : start + (1 << (16 - n))] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


@lru_cache(maxsize=8)
def _encoder(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    table, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            table[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return table


@dataclass
class Scan:
    """How the blocks of a scan follow each other, the same for all frames with one header.

    Arrays over blocks in order of coding: dc and ac (tables), part (for the last direct value), out (block of the frame).
    """

    tables: list[np.ndarray]
    dc: np.ndarray
    ac: np.ndarray
    part: np.ndarray
    out: np.ndarray
    per_restart: int


@dataclass
class Layout:
    """A frame's parts: for each of its blocks the part, its place, and its quantisation; and the parts' sizes."""

    part: np.ndarray
    row: np.ndarray
    column: np.ndarray
    quant: np.ndarray
    sizes: list[tuple[int, int]]


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _scan(parts: list, grids: list, chosen: list[tuple[int, int, int]], tables: dict, width: int, height: int, restart: int) -> Scan:
    """chosen: index of the part, and its two tables."""
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    used: dict[tuple[int, int], int] = {}
    for _, d, a in chosen:
        for key in ((0, d), (1, a)):
            used.setdefault(key, len(used))
    if len(chosen) == 1:
        # One part alone: its own blocks, row by row.
        i, d, a = chosen[0]
        h, v = parts[i][1:3]
        across, down = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
        y, x = np.divmod(np.arange(across * down), across)
        rows = [(np.full(across * down, i), y, x)]
        unit = 1
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        rows, unit = [], 0
        y, x = np.divmod(np.arange(across * down), across)
        for i, _, _ in chosen:
            h, v = parts[i][1:3]
            for dy in range(v):
                for dx in range(h):
                    rows.append((np.full(len(y), i), y * v + dy, x * h + dx))
                    unit += 1
    part, y, x = (np.stack(c, axis=1).ravel() for c in zip(*rows))
    starts = np.array([g[0] for g in grids])
    wide = np.array([g[2] for g in grids])
    of = {i: (used[0, d], used[1, a]) for i, d, a in chosen}
    pick = np.array([of.get(i, (0, 0)) for i in range(len(parts))])
    return Scan([_decoder(*tables[k]) for k in used], pick[part, 0], pick[part, 1], part, starts[part] + y * wide[part] + x, restart * unit)


def _parse(data: bytes) -> tuple[Layout, list[tuple[Scan, bytes]]]:
    """The layout of a baseline JPEG, and its scans with their coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    tables, quant, parts, grids, restart, at, scans = dict(TABLES), {}, [], [], 0, 2, []
    width = height = 0
    while at + 4 <= len(data):
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        mark = data[at + 1]
        if data[at] != 0xFF or mark == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(body[5])]
            if not parts or not width or not height:
                raise ValueError("no frame header")
            if len(parts) == 1:
                parts[0][1:3] = [1, 1]
            most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
            start = 0
            for p in parts:
                down, across = -(-height // (8 * most_v)) * p[2], -(-width // (8 * most_h)) * p[1]
                grids.append((start, down, across))
                start += down * across
        elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("no baseline JPEG")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            if not parts:
                raise ValueError("no frame header")
            names = [p[0] for p in parts]
            chosen = [(names.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            ends = _MARK.search(data, at)
            stop = ends.start() if ends else len(data)
            scans.append((_scan(parts, grids, chosen, tables, width, height, restart), data[at:stop]))
            at = stop
    if not scans:
        raise ValueError("no scan")
    part = np.repeat(np.arange(len(parts)), [d * a for _, d, a in grids])
    place = np.concatenate([np.stack(np.divmod(np.arange(d * a), a)) for _, d, a in grids], axis=1)
    q = np.zeros((len(parts), 64))
    for i, p in enumerate(parts):
        q[i, _ZIGZAG] = quant[p[3]]
    return Layout(part, place[0], place[1], q[part], [(-(-height * p[2] // most_v), -(-width * p[1] // most_h)) for p in parts]), scans


class _Parser:
    """Parses frames; those that begin with the header of the frame before, as in a film, share its layout."""

    def __init__(self):
        self.head, self.known = b"", None

    def __call__(self, data: bytes) -> tuple[Layout, list[tuple[Scan, bytes]]]:
        if self.known and data.startswith(self.head):
            end = _MARK.search(data, len(self.head))
            if end is None or data[end.start() + 1] == 0xD9:
                layout, scan = self.known
                return layout, [(scan, data[len(self.head) : end.start() if end else len(data)])]
        layout, scans = _parse(data)
        if len(scans) == 1 and (at := data.find(scans[0][1])) > 0 and scans[0][1]:
            self.head, self.known = data[:at], (layout, scans[0][0])
        return layout, scans


def _coefficients(frames: list[tuple[Layout, list[tuple[Scan, bytes]]]]) -> tuple[np.ndarray, np.ndarray]:
    """The quantised coefficients of all blocks of all frames, and which frames failed."""
    base = np.concatenate(([0], np.cumsum([len(f.part) for f, _ in frames]))).astype(np.int64)
    out = np.zeros((int(base[-1]), 64), np.int32)
    failed = np.zeros(len(frames), bool)
    numbers: dict[int, int] = {}
    tables: list[np.ndarray] = []
    kinds: dict[int, tuple[int, np.ndarray]] = {}
    blocks: list[tuple[np.ndarray, ...]] = []
    streams, lanes, at, length = [], [], 0, 0
    for i, (_, scans) in enumerate(frames):
        for scan, coded in scans:
            if id(scan) not in kinds:
                for t in scan.tables:
                    if id(t) not in numbers:
                        numbers[id(t)] = len(tables)
                        tables.append(t)
                own = np.array([numbers[id(t)] for t in scan.tables])
                kinds[id(scan)] = (length, None)
                blocks.append((own[scan.dc], own[scan.ac], scan.part, scan.out))
                length += len(scan.out)
            first, n = kinds[id(scan)][0], len(scan.out)
            pieces = _RESTART.split(coded) if scan.per_restart else [coded]
            step = scan.per_restart or n
            for k, piece in enumerate(pieces[: -(-n // step)]):
                piece = piece.replace(b"\xff\x00", b"\xff") + b"\0" * 8
                streams.append(piece)
                # First bit, first block of the scan's order, how many, frame, and where the bits end.
                lanes.append((at * 8, first + k * step, min(step, n - k * step), i, (at + len(piece) - 8) * 8))
                at += len(piece)
            failed[i] |= len(pieces) < -(-n // step)
    if not lanes:
        return out, failed
    bits = np.frombuffer(b"".join(streams), np.uint8).astype(np.int64)
    window = np.zeros(len(bits), np.int64)
    for k in range(5):
        window[: len(bits) - k] |= bits[k:] << (32 - 8 * k)
    table, flat = np.concatenate(tables), out.reshape(-1)
    dc, ac, part, where = (np.concatenate(c) for c in zip(*blocks))
    dc, ac = dc << 16, ac << 16
    pos, block, left, frame, limit = np.array(lanes, np.int64).T.copy()
    last = np.zeros((len(pos), 4), np.int64)
    k = np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    zigzag = np.concatenate((_ZIGZAG, np.zeros(32, np.int64)))
    while len(live):
        p, b, kk = pos[live], block[live], k[live]
        direct = kk == 0
        w, shift = window[p >> 3], p & 7
        x = table[np.where(direct, dc[b], ac[b]) + ((w >> (24 - shift)) & 0xFFFF)].astype(np.int64)
        size, symbol = x >> 8, x & 255
        n = np.where(direct, symbol, symbol & 15)
        run = np.where(direct, 0, symbol >> 4)
        n = np.minimum(n, 15)
        value = (w >> (40 - shift - size - n)) & ((1 << n) - 1)
        value = np.where((n > 0) & (value >> np.maximum(n - 1, 0) == 0), value - (1 << n) + 1, value)
        p = p + size + n
        part_of = part[b]
        d = np.flatnonzero(direct)
        last[live[d], part_of[d]] += value[d]
        value[d] = last[live[d], part_of[d]]
        kk = kk + run
        # No value: the rest of the block is zero, or sixteen places are.
        some = direct | (n > 0)
        bad = (x == 0) | (some & (kk > 63)) | (p > limit[live])
        keep = np.flatnonzero(some & ~bad)
        flat[(base[frame[live[keep]]] + where[b[keep]]) * 64 + zigzag[kk[keep]]] = value[keep]
        kk = np.where(some, kk + 1, np.where(run == 15, kk + 1, 64))
        done = kk > 63
        b, kk = b + done, np.where(done, 0, kk)
        left[live] -= done
        pos[live], block[live], k[live] = p, b, kk
        if bad.any():
            failed[frame[live[bad]]] = True
        live = live[~bad & (left[live] > 0)]
    return out, failed


#: The inverse cosine transform of a whole block as one matrix.
_IDCT = np.kron(_COS, _COS).astype(np.float32)


def _pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    return np.clip(np.round((coefficients * quant).astype(np.float32) @ _IDCT + 128), 0, 255).astype(np.uint8)


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The planes of a baseline JPEG, each at its own sampling."""
    layout, scans = _parse(data)
    coefficients, failed = _coefficients([(layout, scans)])
    if failed[0]:
        raise ValueError("bad code")
    pixels = _pixels(coefficients, layout.quant)
    planes = []
    for i, (height, width) in enumerate(layout.sizes):
        own = layout.part == i
        down, across = layout.row[own].max() + 1, layout.column[own].max() + 1
        plane = pixels[own].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        planes.append(plane[:height, :width])
    return planes


def histograms(frames: list[bytes], most_blocks: int = 1 << 15) -> list[np.ndarray | None]:
    """For each JPEG the shares of 32 brightness bins and of 16 for each colour plane; None if it cannot be decoded."""
    out: list[np.ndarray | None] = [None] * len(frames)
    parse = _Parser()
    held: list[tuple[int, tuple]] = []
    blocks = 0

    def flush() -> None:
        nonlocal held, blocks
        if not held:
            return
        which, parsed = [i for i, _ in held], [x for _, x in held]
        coefficients, failed = _coefficients(parsed)
        pixels = _pixels(coefficients, np.concatenate([f.quant for f, _ in parsed]))
        counts = [len(f.part) for f, _ in parsed]
        frame = np.repeat(np.arange(len(parsed)), counts)
        part, row, column = (np.concatenate([getattr(f, c) for f, _ in parsed]) for c in ("part", "row", "column"))
        n_parts = np.array([len(f.sizes) for f, _ in parsed])
        first = np.cumsum(n_parts) - n_parts
        sizes = np.array([x for f, _ in parsed for x in f.sizes])
        of = first[frame] + part
        # Pixels beyond the picture's edge don't count.
        high, wide = np.clip(sizes[of, 0] - row * 8, 0, 8), np.clip(sizes[of, 1] - column * 8, 0, 8)
        bins = (pixels >> np.where(part == 0, 3, 4)[:, None]).astype(np.int64) + of[:, None] * 32
        if (high < 8).any() or (wide < 8).any():
            inside = (np.arange(64)[None, :] // 8 < high[:, None]) & (np.arange(64)[None, :] % 8 < wide[:, None])
            bins = bins[inside]
        total = np.bincount(bins.ravel(), minlength=len(sizes) * 32).reshape(-1, 32) / sizes.prod(axis=1)[:, None]
        for i, f, n, bad in zip(which, first, n_parts, failed):
            if not bad:
                out[i] = np.concatenate([total[f + c, : 16 if c else 32] for c in range(n)]) / n
        held, blocks = [], 0

    for i, data in enumerate(frames):
        try:
            parsed = parse(data) if data else None
        except (ValueError, IndexError, KeyError, struct.error):
            parsed = None
        if parsed:
            held.append((i, parsed))
            blocks += len(parsed[0].part)
            if blocks >= most_blocks:
                flush()
    flush()
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


@lru_cache(maxsize=8)
def _codes(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of every symbol of the usual brightness table."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (c, n) in _encoder(*TABLES[kind, 0]).items():
        code[symbol], size[symbol] = c, n
    return code, size


def encode_jpegs(images: np.ndarray, step: int = 8) -> list[bytes]:
    """Grey baseline JPEGs of equal size, for media columns made from other tables and for tests; all are coded at once."""
    count, height, width = images.shape
    padded = np.pad(images, ((0, 0), (0, -height % 8), (0, -width % 8)), mode="edge").astype(float) - 128
    blocks = padded.reshape(count, padded.shape[1] // 8, 8, -1, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 64)
    values = np.round(blocks @ _IDCT.T.astype(float) / step).astype(np.int64)[:, _ZIGZAG]
    per = len(values) // count
    direct = np.diff(values[:, 0].reshape(count, per), axis=1, prepend=0).ravel()
    row, place = np.nonzero(values[:, 1:])
    place += 1
    before = np.where(np.concatenate(([True], row[1:] != row[:-1])), 0, np.concatenate(([0], place[:-1])))
    zeros = place - before - 1
    lastly = np.zeros(len(values), np.int64)
    np.maximum.at(lastly, row, place)
    bits_of = lambda v: np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    (dc, dc_n), (ac, ac_n) = _codes(0), _codes(1)
    # Every code with its block, its place there and its rank at that place: direct values, runs of sixteen, values, ends.
    v, n = values[row, place], bits_of(values[row, place])
    long = zeros // 16
    symbol = (zeros % 16) << 4 | n
    signed = lambda v, n: np.where(v > 0, v, v + (1 << n) - 1)
    dn = bits_of(direct)
    runs = np.repeat(np.arange(len(row)), long)
    ends = np.flatnonzero(lastly < 63)
    parts = [
        (np.arange(len(values)) * 64 * 4, dc[dn] << dn | signed(direct, dn), dc_n[dn] + dn),
        ((row[runs] * 64 + place[runs]) * 4, np.full(len(runs), ac[0xF0]), np.full(len(runs), ac_n[0xF0])),
        ((row * 64 + place) * 4 + 1, ac[symbol] << n | signed(v, n), ac_n[symbol] + n),
        ((ends * 64 + 63) * 4 + 2, np.full(len(ends), ac[0]), np.full(len(ends), ac_n[0])),
    ]
    key, code, size = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    frame, code, size = key[order] // (256 * per), code[order], size[order]
    total = np.bincount(frame, size, minlength=count).astype(np.int64)
    pad = -total % 8
    starts = np.cumsum(total + pad) - (total + pad)
    stream = np.ones(int((total + pad).sum()), np.uint8)
    inside = np.cumsum(size) - size
    firsts = inside - np.repeat(np.cumsum(total) - total, np.bincount(frame, minlength=count)) + starts[frame]
    at = np.arange(int(size.sum())) - np.repeat(inside, size)
    stream[np.repeat(firsts, size) + at] = (np.repeat(code, size) >> (np.repeat(size, size) - 1 - at)) & 1
    packed = np.packbits(stream).tobytes()
    head = (
        b"\xff\xd8" + _segment(0xDB, b"\0" + bytes([step]) * 64) + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + b"".join(_segment(0xC4, bytes([c << 4]) + b"".join(TABLES[c, 0])) for c in (0, 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )
    cut = zip((starts // 8).tolist(), ((starts + total + pad) // 8).tolist())
    return [head + packed[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in cut]


def encode_jpeg(image: np.ndarray, step: int = 8) -> bytes:
    return encode_jpegs(image[None], step)[0]


def write_avi(frames: list[bytes], width: int, height: int, fps: int) -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    movi, index = b"movi", b""
    for f in frames:
        index += struct.pack("<4sIII", b"00dc", 16, len(movi), len(f))
        movi += chunk(b"00dc", f)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", movi) + chunk(b"idx1", index))


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], float, int, int]:
    """Offset and size of every frame of the first video stream, seconds per frame, width, height."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    state = {"usec": 0, "width": 0, "height": 0, "video": None, "rate": None, "streams": 0, "movi": None, "index": b"", "listed": {}}
    chunks: list[tuple[bytes, int, int]] = []

    def entries_of(body: int, stop: int) -> None:
        """An OpenDML index: of chunks, by their data's offsets from a base, or of such indexes."""
        if stop - body < 24:
            return
        longs, _, kind, count, name, start = struct.unpack_from("<HBBI4sQ", data, body)
        if kind == 1 and longs == 2:
            for i in range(min(count, (stop - body - 24) // 8)):
                offset, size = struct.unpack_from("<II", data, body + 24 + 8 * i)
                if start + offset <= len(data):
                    state["listed"].setdefault((name[:2], start + offset), size & 0x7FFFFFFF)
        elif kind == 0 and longs == 4:
            for i in range(min(count, (stop - body - 24) // 16)):
                offset, size = struct.unpack_from("<QI", data, body + 24 + 16 * i)
                if data[offset : offset + 2] == b"ix" and offset + 8 <= len(data):
                    entries_of(offset + 8, min(offset + 8 + int.from_bytes(data[offset + 4 : offset + 8], "little"), len(data)))

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body, stop = at + 8, min(at + 8 + size, end)
            if name in (b"LIST", b"RIFF"):
                if data[body : body + 4] == b"movi":
                    state["movi"] = state["movi"] if state["movi"] is not None else body
                walk(body + 4, stop)
            elif name == b"avih" and stop - body >= 40:
                state["usec"], state["width"], state["height"] = (struct.unpack_from("<I", data, body + x)[0] for x in (0, 32, 36))
            elif name == b"strh" and stop - body >= 28:
                if data[body : body + 4] == b"vids" and state["video"] is None:
                    if data[body + 4 : body + 8].upper() not in (b"MJPG", b"\0\0\0\0"):
                        raise ValueError("no motion-JPEG")
                    state["video"] = state["streams"]
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                    state["rate"] = scale / rate if scale and rate else None
                state["streams"] += 1
            elif name == b"idx1":
                state["index"] = data[body:stop]
            elif name[:2] == b"ix" or name == b"indx":
                entries_of(body, stop)
            elif name[2:] in (b"dc", b"db"):
                chunks.append((name, body, stop - body))
            at += 8 + size + size % 2

    walk(0, len(data))
    if state["video"] is None or state["movi"] is None:
        raise ValueError("no video stream")
    stream = b"%02d" % state["video"]
    entries = [struct.unpack_from("<4sIII", state["index"], i) for i in range(0, len(state["index"]) - 15, 16)]
    frames = []
    for name, _, offset, size in entries:
        if name[:2] == stream and name[2:] in (b"dc", b"db"):
            place = next((p for p in (state["movi"] + offset, offset) if data[p : p + 4] == name), None)
            if place is not None:
                frames.append((place + 8, size))
    # Chunks of other parts of the file, or that the index leaves out.
    known = {a for a, _ in frames}
    more = {a: n for (which, a), n in state["listed"].items() if which == stream} | {a: n for name, a, n in chunks if name[:2] == stream}
    more = sorted((a, n) for a, n in more.items() if a not in known)
    if more:
        frames = frames + more if not frames or more[0][0] > frames[-1][0] else sorted(frames + more)
    if not any(n for _, n in frames):
        raise ValueError("no frames")
    return frames, state["rate"] or state["usec"] / 1e6 or 0.04, state["width"], state["height"]


def differences(histograms: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2


def is_cut(d: np.ndarray, film: np.ndarray, least: float = LEAST, deviations: float = DEVIATIONS, around: int = AROUND) -> np.ndarray:
    """Which of the differences between neighbouring frames are cuts; film: whose difference each is, in order."""
    steps = np.array([k for k in range(-around, around + 1) if k])
    at = np.arange(len(d))[:, None] + steps
    spot = np.clip(at, 0, max(len(d) - 1, 0))
    ok = (at >= 0) & (at < len(d)) & (film[spot] == film[:, None])
    # Other cuts nearby must not hide this one: the larger half is left out.
    near = np.sort(np.where(ok, d[spot], np.inf), axis=1)
    n = np.maximum(1, ok.sum(axis=1) // 2)
    used = np.arange(near.shape[1]) < n[:, None]
    near = np.where(used & np.isfinite(near), near, 0)
    mean = near.sum(axis=1) / n
    spread = np.sqrt((np.where(used, near - mean[:, None], 0) ** 2).sum(axis=1) / n)
    return (d >= least) & (d > mean + deviations * spread) & (d > RATIO * mean)


def cuts(histograms: np.ndarray, **options) -> list[int]:
    """Frames that begin a shot, the first included."""
    d = differences(histograms)
    return [0, *(np.flatnonzero(is_cut(d, np.zeros(len(d), np.int64), **options)) + 1).tolist()]


def clips_of(media: list[bytes], **options) -> list[tuple]:
    """Rows of the clips of some media: number of the medium, then the columns after media_id."""
    rows, frames, films = [], [], []
    for m, data in enumerate(media):
        try:
            places, *about = parse_avi(data)
        except (ValueError, IndexError, KeyError, struct.error, RecursionError) as e:
            rows.append((m, None, None, None, None, None, None, None, str(e) or type(e).__name__))
            continue
        films.append((m, len(frames), len(places), about))
        frames += [data[a : a + n] for a, n in places]
    found = histograms(frames)
    wide = max((len(h) for h in found if h is not None), default=32)
    for m, first, n, _ in films:
        own = found[first : first + n]
        last = next((h for h in own if h is not None), np.zeros(32))
        for i, h in enumerate(own):
            last = last if h is None else h
            found[first + i] = last
    table = np.zeros((len(found), wide), np.float32)
    for i, h in enumerate(found):
        table[i, : len(h)] = h
    d = differences(table.astype(float)) if len(table) > 1 else np.zeros(0)
    film = np.repeat(np.arange(len(films)), [n for _, _, n, _ in films])
    # Differences across the borders of films are of none.
    between = film[1:] != film[:-1]
    inner = np.flatnonzero(~between) if len(film) else np.zeros(0, np.int64)
    begins = np.zeros(len(found), bool)
    begins[[first for _, first, _, _ in films]] = True
    if len(inner):
        begins[inner[is_cut(d[inner], film[inner], **options)] + 1] = True
    starts = np.flatnonzero(begins)
    for m, first, n, (seconds, width, height) in films:
        own = starts[np.searchsorted(starts, first) : np.searchsorted(starts, first + n)] - first
        edges = [*own.tolist(), n]
        rows += [(m, i, a, b - a, round(a * seconds, 6), round(b * seconds, 6), width, height, None) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return rows


def clips(media: DataFrame, media_id: str = "media_id", content: str = "content", least: float = LEAST, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per clip of every medium, in one narrow pass.

    media_id, clip, first_frame, n_frames, start_s, end_s, width, height, error.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            ids, held, size = batch.column(0).to_pylist(), [], 0

            def flush():
                which, data = zip(*held)
                rows = [(which[m], *x) for m, *x in clips_of(list(data), least=least, deviations=deviations)]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

            for i, data in zip(ids, batch.column(1)):
                if data.is_valid and len(data.as_buffer()):
                    held.append((i, data.as_py()))
                    size += len(held[-1][1])
                    if len(held) >= MEDIA or size >= MEDIA_BYTES:
                        yield flush()
                        size = 0
            if held:
                yield flush()

    return media.select(media_id, content).mapInArrow(run, SCHEMA)


def film(vectors: np.ndarray, frames: int = 16, side: int = 16) -> tuple[list[bytes], list[list[int]]]:
    """Films made from vectors of 64 numbers, and where the shots of each begin.

    A shot shows the whole vector as a pattern of its own arrangement.  In restless films the light grows all the
    time, by more between two frames than ``LEAST``, so that no fixed threshold tells that from a cut.
    """
    n = len(vectors)
    v = np.asarray(vectors, float)
    v = np.pad(v, ((0, 0), (0, max(0, 64 - v.shape[1]))))[:, :64]
    v = (v - v.min(axis=1, keepdims=True)) / np.maximum(np.ptp(v, axis=1), 1e-9)[:, None]
    cut = (v[:, 0] * 1000).astype(int) % 2 * (frames // 2 - 2 + (v[:, 2] * 4).astype(int))
    ramp = np.linspace(-16, 16, side)[None, :] + np.linspace(-6, 6, side)[:, None]
    images = np.zeros((n, frames, side, side))
    begins = []
    zoom = side // 8
    for i in range(n):
        own = [0, int(cut[i])] if cut[i] else [0]
        begins.append(own)
        for s, (a, b) in enumerate(zip(own, [*own[1:], frames])):
            pattern = np.kron(np.roll(v[i], 11 * s).reshape(8, 8), np.ones((zoom, zoom)))
            t = np.arange(b - a)[:, None, None]
            if v[i, 1] > 0.5:
                images[i, a:b] = 25 + 20 * pattern + 8 * t + ramp
            else:
                images[i, a:b] = (30, 120)[s] + (40, 100)[s] * pattern + 0.3 * t + ramp
    coded = encode_jpegs(np.clip(images, 0, 255).reshape(n * frames, side, side))
    return [write_avi(coded[i * frames : (i + 1) * frames], side, side, 12) for i in range(n)], begins


def films(vectors: DataFrame) -> DataFrame:
    """A media column for the embeddings table: media_id, content."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column(1).to_pylist()
                have = [i for i, x in enumerate(rows) if x]
                content: list[bytes | None] = [None] * len(rows)
                if have:
                    wide = max(len(rows[i]) for i in have)
                    made, _ = film(np.array([[y or 0.0 for y in rows[i]] + [0.0] * (wide - len(rows[i])) for i in have]))
                    for i, x in zip(have, made):
                        content[i] = x
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(content, pa.binary())], ["media_id", "content"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "media_id long, content binary")

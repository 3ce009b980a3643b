"""JPEG: baseline, extended and progressive Huffman files to pixels, and pixels to baseline files.

Coefficients are read bit by bit; all that follows, from dequantising to colours, works on whole planes.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

# ---- fixed values of the format: the order of coefficients, and the example tables of its annex K

ZIGZAG = np.array(sorted(range(64), key=lambda n: (n // 8 + n % 8, n // 8 if (n // 8 + n % 8) % 2 else n % 8)))
QUANT_LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
QUANT_CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: (codes of each length from 1 to 16, symbols): DC then AC, of luminance and of chrominance. Files of moving pictures leave them out.
DC_LUMINANCE = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMINANCE = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMINANCE = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    [
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0,
        0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49,
        0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89,
        0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5,
        0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
        0xF9, 0xFA,
    ],
)
AC_CHROMINANCE = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    [
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0,
        0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48,
        0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87,
        0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
        0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
        0xF9, 0xFA,
    ],
)
STANDARD_TABLES = {0x00: DC_LUMINANCE, 0x01: DC_CHROMINANCE, 0x10: AC_LUMINANCE, 0x11: AC_CHROMINANCE}

# ---- common

#: Orthonormal cosine transform of eight values, for writing.
_COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
#: Steps of a whole-number transform: bits of its constants, and of a fraction between its two passes.
CONSTANT_BITS, PASS_BITS = 13, 2
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def whole_transform() -> np.ndarray:
    """The inverse cosine transform of eight values, times the square root of eight, in the whole numbers that
    decoders agree on: sums of twelve rounded constants, so that no decoder rounds another way."""
    at = lambda x: round(x * (1 << CONSTANT_BITS))
    out = np.zeros((8, 8), np.int64)
    for k, x in enumerate(np.eye(8, dtype=int).tolist()):
        turned = (x[2] + x[6]) * at(0.541196100)
        far, near = turned - x[6] * at(1.847759065), turned + x[2] * at(0.765366865)
        plus, minus = (x[0] + x[4]) << CONSTANT_BITS, (x[0] - x[4]) << CONSTANT_BITS
        even = [plus + near, minus + far, minus - far, plus - near]
        common = (x[7] + x[3] + x[5] + x[1]) * at(1.175875602)
        a, b = -(x[7] + x[1]) * at(0.899976223), -(x[5] + x[3]) * at(2.562915447)
        c, d = common - (x[7] + x[3]) * at(1.961570560), common - (x[5] + x[1]) * at(0.390180644)
        odd = [x[1] * at(1.501321110) + a + d, x[3] * at(3.072711026) + b + c, x[5] * at(2.053119869) + b + d, x[7] * at(0.298631336) + a + c]
        out[:, k] = [e + o for e, o in zip(even, odd, strict=True)] + [e - o for e, o in zip(even[::-1], odd[::-1], strict=True)]
    return out


_WHOLE = whole_transform()


def inverse_transform(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, 8, 8) of dequantised coefficients as pixels around 0: columns, then lines."""
    first, last = CONSTANT_BITS - PASS_BITS, CONSTANT_BITS + PASS_BITS + 3
    columns = (_WHOLE @ blocks + (1 << (first - 1))) >> first
    return (columns @ _WHOLE.T + (1 << (last - 1))) >> last


def codes_of(counts: list[int], symbols: list[int]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table."""
    code, at = 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            yield symbol, code, length
            code += 1
        at, code = at + n, code << 1


@lru_cache(maxsize=32)
def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: 256 times the length of the code they begin with plus its symbol; 0 for none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes_of(list(counts), list(symbols)):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table.tolist()


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    #: Blocks in a line and lines of blocks, as stored (whole units), and as they are seen.
    wide: int = 0
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    #: Coefficients of all blocks in the order of the file.
    values: array = field(default_factory=lambda: array("h"))


@dataclass
class Scan:
    parts: list[Component]
    dc: list[list[int]]
    ac: list[list[int]]
    first: int
    last: int
    high: int
    low: int


# ---- reading


def windows(part: bytes) -> list[int]:
    """32 bits from each byte on, zeros behind the end."""
    b = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + bytes(12), np.uint8).astype(np.uint32)
    return (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]).tolist()


def scan_blocks(scan: Scan, units_wide: int, units_high: int) -> tuple[list[tuple[int, int]], int]:
    """((place in scan.parts, start in its values) of each block in order, blocks of a unit)."""
    if len(scan.parts) == 1:
        c = scan.parts[0]
        starts = (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).ravel() * 64
        return [(0, s) for s in starts.tolist()], 1
    columns, places = [], []
    y, x = (a.ravel() for a in np.mgrid[:units_high, :units_wide])
    for k, c in enumerate(scan.parts):
        for dy in range(c.v):
            for dx in range(c.h):
                columns.append(((y * c.v + dy) * c.wide + x * c.h + dx) * 64)
                places.append(k)
    starts = np.stack(columns, axis=1)
    return list(zip(places * len(starts), starts.ravel().tolist(), strict=True)), len(places)


def read_sequential(scan: Scan, blocks: list[tuple[int, int]], w: list[int]) -> None:
    """All coefficients of blocks from one interval of bits."""
    p, before = 0, [0] * len(scan.parts)
    values, dcs, acs = [c.values for c in scan.parts], scan.dc, scan.ac
    for k, start in blocks:
        out, ac = values[k], acs[k]
        e = dcs[k][w[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
        p += e >> 8
        size = e & 255
        if size:
            v = w[p >> 3] >> (32 - (p & 7) - size) & ((1 << size) - 1)
            p += size
            before[k] += v if v >> (size - 1) else v - (1 << size) + 1
        elif not e:
            raise ValueError("a JPEG with bits that are no code")
        out[start] = before[k]
        i = 1
        while i < 64:
            e = ac[w[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
            p += e >> 8
            size = e & 15
            if size:
                i += e >> 4 & 15
                v = w[p >> 3] >> (32 - (p & 7) - size) & ((1 << size) - 1)
                p += size
                out[start + (i & 63)] = v if v >> (size - 1) else v - (1 << size) + 1
                i += 1
            elif e & 0xF0 == 0xF0:
                i += 16
            elif e:
                break
            else:
                raise ValueError("a JPEG with bits that are no code")


def read_progressive(scan: Scan, blocks: list[tuple[int, int]], w: list[int]) -> None:
    """The part of the coefficients that a progressive scan adds."""
    p, before, run, low = 0, [0] * len(scan.parts), 0, scan.low
    plus, minus = 1 << low, -1 << low

    def bits(n: int) -> int:
        nonlocal p
        v = w[p >> 3] >> (32 - (p & 7) - n) & ((1 << n) - 1)
        p += n
        return v

    def symbol(table: list[int]) -> int:
        nonlocal p
        e = table[w[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
        if not e:
            raise ValueError("a JPEG with bits that are no code")
        p += e >> 8
        return e & 255

    def signed(size: int) -> int:
        v = bits(size)
        return v if v >> (size - 1) else v - (1 << size) + 1

    if scan.first == 0:
        for k, start in blocks:
            out = scan.parts[k].values
            if scan.high:
                out[start] |= bits(1) << low
            else:
                size = symbol(scan.dc[k])
                before[k] += signed(size) if size else 0
                out[start] = before[k] << low
        return
    out, table = scan.parts[0].values, scan.ac[0]

    def refine(at: int) -> None:
        if bits(1):
            out[at] += plus if out[at] > 0 else minus

    for _, start in blocks:
        at, end = start + scan.first, start + scan.last
        if not run:
            while at <= end:
                s = symbol(table)
                zeros, size, value = s >> 4, s & 15, 0
                if not size and zeros < 15:
                    run = (1 << zeros) + (bits(zeros) if zeros else 0)
                    break
                if not scan.high:
                    at += zeros
                    if size:
                        out[at] = signed(size) << low
                    at += 1
                    continue
                if size:
                    value = plus if bits(1) else minus
                while at <= end:
                    if out[at]:
                        refine(at)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            out[at] = value
                        at += 1
                        break
                    at += 1
        if run:
            if scan.high:
                for i in range(at, end + 1):
                    if out[i]:
                        refine(i)
            run -= 1


class Frame:
    """What the segments of a file say."""

    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.tables = {k: lookup(*map(bytes, t)) for k, t in STANDARD_TABLES.items()}
        self.parts: list[Component] = []
        self.width = self.height = self.restart = 0
        self.progressive, self.adobe = False, None

    def tables_from(self, d: bytes) -> None:
        at = 0
        while at + 17 <= len(d):
            counts = d[at + 1 : at + 17]
            n = sum(counts)
            self.tables[d[at]] = lookup(counts, d[at + 17 : at + 17 + n])
            at += 17 + n

    def quant_from(self, d: bytes) -> None:
        at = 0
        while at < len(d):
            wide = d[at] >> 4
            self.quant[d[at] & 15] = np.frombuffer(d, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
            at += 129 if wide else 65

    def frame_from(self, d: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", d[:6])
        if depth != 8 or not self.height or not self.width:
            raise ValueError("only JPEGs of 8 bits and known size are read")
        self.parts = [Component(d[6 + 3 * k], d[7 + 3 * k] >> 4, d[7 + 3 * k] & 15, d[8 + 3 * k]) for k in range(n)]
        most_h, most_v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.units_wide, self.units_high = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        for c in self.parts:
            c.wide, c.high = self.units_wide * c.h, self.units_high * c.v
            c.own_wide, c.own_high = -(-(-(-self.width * c.h // most_h)) // 8), -(-(-(-self.height * c.v // most_v)) // 8)
            c.values = array("h", bytes(2 * 64 * c.wide * c.high))

    def scan_from(self, d: bytes, bits: bytes) -> None:
        n = d[0]
        by_name = {c.name: c for c in self.parts}
        parts = [by_name[d[1 + 2 * k]] for k in range(n)]
        chosen = [d[2 + 2 * k] for k in range(n)]
        none: list[int] = []
        first, last, steps = d[1 + 2 * n : 4 + 2 * n]
        scan = Scan(parts, [self.tables.get(t >> 4, none) for t in chosen], [self.tables.get(0x10 | t & 15, none) for t in chosen], first, last, steps >> 4, steps & 15)
        blocks, each = scan_blocks(scan, self.units_wide, self.units_high)
        step = self.restart * each or len(blocks)
        intervals = _RESTART.split(bits) if self.restart else [bits]
        read = read_progressive if self.progressive else read_sequential
        for k, at in enumerate(range(0, len(blocks), step)):
            try:
                read(scan, blocks[at : at + step], windows(intervals[k]))
            except IndexError as e:
                raise ValueError("a JPEG that ends too early") from e

    def planes(self) -> list[np.ndarray]:
        """Whole numbers from 0 to 255 of each component at the size of the image."""
        most_h, most_v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        out = []
        for c in self.parts:
            ordered = np.frombuffer(c.values, np.int16).reshape(-1, 64) * self.quant[c.quant]
            natural = np.empty_like(ordered)
            natural[:, ZIGZAG] = ordered
            plane = inverse_transform(natural.reshape(-1, 8, 8)).reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)
            plane = np.clip(plane + 128, 0, 255)
            plane = plane[: -(-self.height * c.v // most_v), : -(-self.width * c.h // most_h)]
            out.append(enlarged(plane, most_h / c.h, most_v / c.v)[: self.height, : self.width])
        return out


def between(a: np.ndarray, axis: int, early: int, late: int, shift: int) -> np.ndarray:
    """Twice as many values along an axis, each three parts its own and one part the next one's."""
    a = np.moveaxis(a, axis, 0)
    before, after = np.concatenate([a[:1], a[:-1]]), np.concatenate([a[1:], a[-1:]])
    both = np.stack([(3 * a + before + early) >> shift, (3 * a + after + late) >> shift], axis=1)
    return np.moveaxis(both.reshape(2 * len(a), *a.shape[1:]), 0, axis)


def enlarged(plane: np.ndarray, across: float, down: float) -> np.ndarray:
    """A plane at so many times its size: doubled by weights of three and one, else, and where it has less than
    three columns to double, by repeating."""
    if across == 2 and plane.shape[1] < 3:
        down_only = np.repeat(plane, 2, axis=1)
        return np.repeat(down_only, int(down), axis=0)
    if (across, down) == (2, 2):
        return between(between(plane, 0, 0, 0, 0), 1, 8, 7, 4)
    if (across, down) == (2, 1):
        return between(plane, 1, 1, 2, 2)
    if (across, down) == (1, 2):
        return between(plane, 0, 1, 2, 2)
    h, w = int(plane.shape[0] * down), int(plane.shape[1] * across)
    return plane[(np.arange(h) / down).astype(int)][:, (np.arange(w) / across).astype(int)]


def coloured(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Red, green and blue of luminance and two colour differences."""
    b, r, at = cb - 128, cr - 128, lambda x: round(x * 65536)
    red, blue = (at(1.402) * r + 32768) >> 16, (at(1.772) * b + 32768) >> 16
    green = (-at(0.34414) * b - at(0.71414) * r + 32768) >> 16
    return np.clip(np.stack([y + red, y + green, y + blue]), 0, 255)


def decode_jpeg(data: bytes) -> np.ndarray:
    """A JPEG to C x H x W, 0 to 255: one channel for grey, three for colours, also of four inks. Damaged
    files and those with arithmetic coding, without loss or with 12 bits raise a ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    frame, at, seen = Frame(), 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        if kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        d, at = data[at + 4 : at + 2 + n], at + 2 + n
        try:
            if kind == 0xC4:
                frame.tables_from(d)
            elif kind == 0xDB:
                frame.quant_from(d)
            elif kind in (0xC0, 0xC1, 0xC2):
                frame.progressive = kind == 0xC2
                frame.frame_from(d)
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only JPEGs in Huffman codes with loss are read")
            elif kind == 0xDD:
                frame.restart = int.from_bytes(d[:2], "big")
            elif kind == 0xEE and d[:5] == b"Adobe" and len(d) >= 12:
                frame.adobe = d[11]
            elif kind == 0xDA:
                end = _MARKER.search(data, at)
                stop = end.start() if end else len(data)
                frame.scan_from(d, data[at:stop])
                at, seen = stop, True
        except (KeyError, IndexError, struct.error) as e:
            raise ValueError("a damaged JPEG") from e
    if not seen or not frame.parts or any(c.quant not in frame.quant for c in frame.parts):
        raise ValueError("a JPEG without an image")
    planes = frame.planes()
    if len(planes) == 1:
        return planes[0][None].astype(np.float32)
    names = bytes(c.name for c in frame.parts)
    plain = frame.adobe == 0 or (frame.adobe is None and names[:3] == b"RGB")
    three = np.stack(planes[:3]) if plain or len(planes) == 4 and frame.adobe != 2 else coloured(*planes[:3])
    if len(planes) == 4:  # inks are stored as what they leave
        three = np.floor(three * planes[3] / 255 + 0.5)
    return three.astype(np.float32)


# ---- writing


def scaled_quant(table: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


class _Bits:
    """Bits one after the other, with a zero byte behind each of ones."""

    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, size: int) -> None:
        self.held, self.n = self.held << size | value, self.n + size
        while self.n >= 8:
            self.n -= 8
            byte = self.held >> self.n & 255
            self.out.append(byte)
            if byte == 255:
                self.out.append(0)
        self.held &= (1 << self.n) - 1

    def end(self) -> bytes:
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)
        return bytes(self.out)


def _put_block(bits: _Bits, values: list[int], before: int, dc: dict, ac: dict) -> None:
    def coded(table: dict, zeros: int, v: int) -> None:
        size = abs(v).bit_length()
        bits.put(*table[zeros << 4 | size])
        if size:
            bits.put(v if v > 0 else v + (1 << size) - 1, size)

    coded(dc, 0, values[0] - before)
    zeros = 0
    for v in values[1:]:
        if not v:
            zeros += 1
            continue
        while zeros > 15:
            bits.put(*ac[0xF0])
            zeros -= 16
        coded(ac, zeros, v)
        zeros = 0
    if zeros:
        bits.put(*ac[0x00])


@cache
def standard_codes() -> list[dict[int, tuple[int, int]]]:
    """(code, length) by symbol, of the standard tables: DC and AC of luminance, then of chrominance."""
    return [{s: (code, length) for s, code, length in codes_of(*t)} for t in (DC_LUMINANCE, AC_LUMINANCE, DC_CHROMINANCE, AC_CHROMINANCE)]


def encode_jpeg(a: np.ndarray, quality: int = 95, smaller: tuple[int, int] = (2, 2), restart: int = 0) -> bytes:
    """C x H x W, 0 to 255, as a baseline JPEG. smaller: how many times fewer columns and lines the colour
    differences have (1 or 2); restart: units between restart marks, 0: none."""
    a = np.clip(np.asarray(a, np.float64), 0, 255)
    c, h, w = a.shape
    if c == 3:
        r, g, b = a
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    elif c == 1:
        planes = [a[0]]
    else:
        raise ValueError("an image has one channel or three")
    across, down = smaller if c == 3 else (1, 1)
    units_wide, units_high = -(-w // (8 * across)), -(-h // (8 * down))
    quants = [scaled_quant(QUANT_LUMINANCE, quality), *[scaled_quant(QUANT_CHROMINANCE, quality)] * 2][: len(planes)]
    blocks = []
    for k, (plane, quant) in enumerate(zip(planes, quants, strict=True)):
        full = np.pad(plane, ((0, units_high * 8 * down - h), (0, units_wide * 8 * across - w)), mode="edge")
        sx, sy = (1, 1) if k == 0 else (across, down)
        full = full.reshape(full.shape[0] // sy, sy, full.shape[1] // sx, sx).mean(axis=(1, 3)) - 128
        cut = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2)
        rounded = np.rint((_COSINES @ cut @ _COSINES.T).reshape(*cut.shape[:2], 64) / quant).astype(int)
        blocks.append(rounded[..., ZIGZAG].tolist())
    tables = standard_codes()
    bits, before, body, n = _Bits(), [0] * len(planes), [], 0
    for uy in range(units_high):
        for ux in range(units_wide):
            if restart and n and n % restart == 0:
                body.append(bits.end() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8]))
                bits, before = _Bits(), [0] * len(planes)
            n += 1
            for k in range(len(planes)):
                bx, by = (across, down) if k == 0 else (1, 1)
                dc, ac = tables[2 * (k > 0) : 2 * (k > 0) + 2]
                for y in range(uy * by, uy * by + by):
                    for x in range(ux * bx, ux * bx + bx):
                        values = blocks[k][y][x]
                        _put_block(bits, values, before[k], dc, ac)
                        before[k] = values[0]
    body.append(bits.end())
    segment = lambda kind, d: bytes([0xFF, kind]) + struct.pack(">H", len(d) + 2) + d
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xDB, bytes([k]) + bytes(quants[k][ZIGZAG].tolist())) for k in range(min(2, len(planes)))]
    sampling = lambda k: across << 4 | down if k == 0 else 0x11
    out.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, sampling(k), min(k, 1)]) for k in range(c))))
    out += [segment(0xC4, bytes([k, *t[0], *t[1]])) for k, t in STANDARD_TABLES.items() if c == 3 or not k & 15]
    if restart:
        out.append(segment(0xDD, struct.pack(">H", restart)))
    out.append(segment(0xDA, bytes([c]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(c)) + b"\0\x3f\0"))
    return b"".join([*out, *body, b"\xff\xd9"])

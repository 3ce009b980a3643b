"""PNG: every colour type and depth, interlaced or not, to pixels; and pixels to files with a filter chosen line by line."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: channels by colour type; the passes of an interlaced image (first column and line, steps).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def nearest(a: int, b: int, c: int) -> int:
    """Of left, above and above left the one that is closest to left + above - above left."""
    p = a + b - c
    x, y, z = abs(p - a), abs(p - b), abs(p - c)
    return a if x <= y and x <= z else b if y <= z else c


def unfiltered(raw: bytes, lines: int, width: int, step: int) -> np.ndarray:
    """Lines of width bytes without their filters; step: bytes of a pixel, at least one."""
    if len(raw) < lines * (width + 1):
        raise ValueError("a PNG that ends too early")
    given = np.frombuffer(raw, np.uint8, lines * (width + 1)).reshape(lines, width + 1)
    out, above = np.zeros((lines, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(lines):
        kind, line = int(given[y, 0]), given[y, 1:]
        if kind == 2:
            line = line + above
        elif kind == 1:  # sums of each byte of a pixel along the line
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            line = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind in (3, 4):
            done, up = [0] * step + line.tolist(), [0] * step + above.tolist()
            for x in range(step, width + step):
                near = nearest(done[x - step], up[x], up[x - step]) if kind == 4 else (done[x - step] + up[x]) // 2
                done[x] = (done[x] + near) & 255
            line = np.array(done[step:], np.uint8)
        elif kind:
            raise ValueError("a PNG with an unknown filter")
        out[y] = above = line
    return out


def samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Lines of bytes as lines x width x channels of whole numbers."""
    if depth == 8:
        flat = lines
    elif depth == 16:
        flat = lines.reshape(len(lines), -1, 2).astype(np.uint16)
        flat = flat[..., 0] << 8 | flat[..., 1]
    else:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        flat = bits @ (1 << np.arange(depth)[::-1])
    return flat[:, : width * channels].reshape(len(lines), width, channels)


def decode_png(data: bytes) -> np.ndarray:
    """A PNG to C x H x W, 0 to 255: grey stays grey, alpha and transparent colours go, a palette is looked up,
    other depths are scaled. A damaged file raises a ValueError."""
    chunks = list(png_chunks(data))
    head = dict(reversed(chunks))
    if data[:8] != SIGNATURE or len(head.get(b"IHDR", b"")) < 13:
        raise ValueError("not a PNG")
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head[b"IHDR"][:13])
    if kind not in CHANNELS or depth not in (1, 2, 4, 8, 16) or not w or not h:
        raise ValueError("a PNG of an unknown kind")
    channels = CHANNELS[kind]
    try:
        raw = zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT"))
    except zlib.error as e:
        raise ValueError("a damaged PNG") from e
    step, pixels, at = max(1, channels * depth // 8), np.zeros((h, w, channels), np.int64), 0
    for left, top, across, down in PASSES if interlaced else [(0, 0, 1, 1)]:
        wide, high = -(-(w - left) // across), -(-(h - top) // down)
        if wide <= 0 or high <= 0:
            continue
        size = -(-wide * channels * depth // 8)
        lines = unfiltered(raw[at : at + high * (size + 1)], high, size, step)
        pixels[top::down, left::across] = samples(lines, wide, depth, channels)
        at += high * (size + 1)
    if kind == 3:
        palette = np.frombuffer(head.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if pixels.max() >= len(palette):
            raise ValueError("a PNG with a colour outside of its palette")
        return palette[pixels[..., 0]].transpose(2, 0, 1).astype(np.float32)
    if kind in (4, 6):
        pixels = pixels[..., :-1]
    return (pixels.transpose(2, 0, 1) * (255 / ((1 << depth) - 1))).astype(np.float32)


def filtered(lines: np.ndarray, step: int) -> bytes:
    """Lines of bytes, each with the filter that leaves the least in sum behind it."""
    above, left, corner = np.zeros_like(lines), np.zeros_like(lines), np.zeros_like(lines)
    above[1:], left[:, step:] = lines[:-1], lines[:, :-step]
    corner[1:, step:] = lines[:-1, :-step]
    a, b, c = (x.astype(np.int16) for x in (left, above, corner))
    p = a + b - c
    x, y, z = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    guess = np.where((x <= y) & (x <= z), a, np.where(y <= z, b, c)).astype(np.uint8)
    tried = np.stack([lines, lines - left, lines - above, lines - ((a + b) // 2).astype(np.uint8), lines - guess])
    best = np.abs(tried.view(np.int8).astype(np.int64)).sum(axis=2).argmin(axis=0)
    return np.concatenate([best[:, None].astype(np.uint8), tried[best, np.arange(len(lines))]], axis=1).tobytes()


def encode_png(a: np.ndarray, depth: int = 8, palette: np.ndarray | None = None, interlaced: bool = False) -> bytes:
    """C x H x W of whole numbers below 2**depth as a PNG: 1 channel grey (or places in a palette of n x 3), 2 grey
    and alpha, 3 colours, 4 colours and alpha."""
    channels, h, w = a.shape
    kind = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    if depth < 8 and channels > 1 or depth == 16 and kind == 3:
        raise ValueError("no PNG has such pixels")
    pixels, step, body = np.ascontiguousarray(a.transpose(1, 2, 0)).astype(np.int64), max(1, channels * depth // 8), []
    for left, top, across, down in PASSES if interlaced else [(0, 0, 1, 1)]:
        some = pixels[top::down, left::across]
        if not some.size:
            continue
        flat = some.reshape(len(some), -1)
        if depth == 8:
            lines = flat.astype(np.uint8)
        elif depth == 16:
            lines = flat.astype(">u2").view(np.uint8).reshape(len(some), -1)
        else:
            lines = np.packbits((flat[..., None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(len(some), -1), axis=1)
        body.append(filtered(lines, step) if kind != 3 and depth >= 8 else np.pad(lines, ((0, 0), (1, 0))).tobytes())
    chunk = lambda name, d: struct.pack(">I", len(d)) + name + d + struct.pack(">I", zlib.crc32(name + d))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(interlaced)))]
    if palette is not None:
        parts.append(chunk(b"PLTE", np.asarray(palette, np.uint8).tobytes()))
    return SIGNATURE + b"".join([*parts, chunk(b"IDAT", zlib.compress(b"".join(body), 6)), chunk(b"IEND", b"")])

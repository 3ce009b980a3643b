"""Videos by frame: containers are indexed by their headers, and only the bytes of wanted frames are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.stores import opened
from .jpeg import decode_jpeg, encode_jpeg

#: Rate of videos that don't say theirs.
RATE = 24.0


@dataclass
class Video:
    """count frames, rate a second; places: (offset, bytes) of each in the file."""

    path: str
    rate: float
    places: list[tuple[int, int]]

    @property
    def count(self) -> int:
        return len(self.places)

    def frame(self, data: bytes) -> np.ndarray:
        """C x H x W, 0 to 255, of a frame's bytes."""
        raise NotImplementedError

    def frames(self, wanted: list[int]) -> np.ndarray:
        """F x C x H x W of frames by number; one that is wanted again and again is read once."""
        with opened(self.path) as f:
            found = {}
            for k in sorted(set(wanted)):
                f.seek(self.places[k][0])
                found[k] = self.frame(f.read(self.places[k][1]))
        return np.stack([found[k] for k in wanted])


def riff_chunks(f, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, kind of a list, offset of the contents, bytes) of the chunks in a part of a file."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(12)
        if len(head) < 8:
            return
        size = int.from_bytes(head[4:8], "little")
        if head[:4] in (b"RIFF", b"LIST"):
            yield head[:4], head[8:12], at + 12, min(size - 4, end - at - 12)
        else:
            yield head[:4], b"", at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


@dataclass
class Avi(Video):
    """AVI with JPEG frames, or plain ones of 24 or 32 bits."""

    wide: int = 0
    high: int = 0
    bits: int = 0
    compression: bytes = b""

    def frame(self, data: bytes) -> np.ndarray:
        if data[:2] == b"\xff\xd8":
            a = decode_jpeg(data)
            return np.repeat(a, 3, axis=0) if a.shape[0] == 1 else a
        if self.compression.strip(b"\0") or self.bits not in (24, 32):
            raise ValueError(f"frames in the format {self.compression!r} aren't read")
        line, high = -(-self.wide * self.bits // 32) * 4, abs(self.high)
        lines = np.frombuffer(data, np.uint8, line * high).reshape(high, line)[:, : self.wide * self.bits // 8]
        pixels = lines.reshape(high, self.wide, self.bits // 8)[..., 2::-1]
        return (pixels[::-1] if self.high > 0 else pixels).transpose(2, 0, 1).astype(np.float32)

    @classmethod
    def read(cls, path: str, f, size: int) -> Avi:
        movies, index, streams, first = [], b"", [], 0
        for _, kind, at, n in riff_chunks(f, 0, size):
            if kind not in (b"AVI ", b"AVIX"):
                continue
            for name, inner, start, length in riff_chunks(f, at, at + n):
                if inner == b"hdrl":
                    for part, sort, begin, long in riff_chunks(f, start, start + length):
                        if part == b"avih":
                            f.seek(begin)
                            first = int.from_bytes(f.read(4), "little")
                        elif sort == b"strl":
                            streams.append({c: (f.seek(b), f.read(m))[1] for c, _, b, m in list(riff_chunks(f, begin, begin + long)) if c in (b"strh", b"strf")})
                elif inner == b"movi":
                    movies.append((start, length))
                elif name == b"idx1" and kind == b"AVI ":
                    f.seek(start)
                    index = f.read(length)
        number = next((k for k, s in enumerate(streams) if s.get(b"strh", b"")[:4] == b"vids"), None)
        if number is None or not movies:
            raise ValueError("an AVI without a video")
        head, form = streams[number][b"strh"], streams[number].get(b"strf", bytes(40))
        scale, rate = struct.unpack_from("<II", head, 20)
        names = {b"%02ddc" % number, b"%02ddb" % number}
        places = indexed(index, names, movies[0][0], f) if index else []
        for start, length in movies[1:] if places else movies:
            places += walked(f, start, start + length, names)
        # a frame without bytes is the one before it again
        whole: list[tuple[int, int]] = []
        for place in places:
            if place[1] or whole:
                whole.append(place if place[1] else whole[-1])
        wide, high, _, bits = struct.unpack_from("<iiHH", form, 4)
        return cls(path, rate / scale if scale and rate else 1e6 / first if first else RATE, whole, wide, high, bits, form[16:20])


def indexed(index: bytes, names: set[bytes], movie: int, f) -> list[tuple[int, int]]:
    """Places of the frames by the index at the end of a file, whose offsets count from the list of frames or from the start."""
    rows = [struct.unpack_from("<4sIII", index, at) for at in range(0, len(index) - 15, 16)]
    own = [(offset, n) for name, _, offset, n in rows if name in names]
    if not own:
        return []
    for base in (movie - 4, 0):
        f.seek(base + own[0][0])
        if f.read(4) in names:
            return [(base + offset + 8, n) for offset, n in own]
    return []


def walked(f, at: int, end: int, names: set[bytes]) -> list[tuple[int, int]]:
    """Places of the frames by the headers in front of them."""
    out = []
    for name, kind, start, n in riff_chunks(f, at, end):
        if kind == b"rec ":
            out += walked(f, start, start + n, names)
        elif name in names:
            out.append((start, n))
    return out


@dataclass
class Y4m(Video):
    """Plain frames of luminance and colour differences."""

    wide: int = 0
    high: int = 0
    #: Columns and lines that share one colour difference; none: grey alone.
    across: int = 0
    down: int = 0
    full: bool = False

    def frame(self, data: bytes) -> np.ndarray:
        n = self.wide * self.high
        y = np.frombuffer(data, np.uint8, n).reshape(self.high, self.wide).astype(np.float64)
        span, zero, colours = (255.0, 0.0, 255.0) if self.full else (219.0, 16.0, 224.0)
        y = (y - zero) / span * 255
        if not self.across:
            return np.repeat(np.clip(np.rint(y), 0, 255)[None], 3, axis=0).astype(np.float32)
        w, h = -(-self.wide // self.across), -(-self.high // self.down)
        both = np.frombuffer(data, np.uint8, 2 * w * h, n).reshape(2, h, w).astype(np.float64)
        b, r = (np.repeat(np.repeat((c - 128) / colours * 255, self.down, axis=0), self.across, axis=1)[: self.high, : self.wide] for c in both)
        three = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b])
        return np.clip(np.rint(three), 0, 255).astype(np.float32)

    @classmethod
    def read(cls, path: str, f, size: int) -> Y4m:
        f.seek(0)
        line = f.read(4096).split(b"\n", 1)[0]
        said = {p[:1]: p[1:].decode("ascii", "replace") for p in line.split(b" ")[1:] if p[:1] != b"X"}
        space = said.get(b"C", "420")
        kind = next((k for k in ("mono", "444", "422", "411", "420") if space.startswith(k)), None)
        if kind is None or "p1" in space[3:]:
            raise ValueError(f"frames in the colours {space} aren't read")
        across, down = {"mono": (0, 0), "444": (1, 1), "422": (2, 1), "411": (4, 1), "420": (2, 2)}[kind]
        wide, high = int(said[b"W"]), int(said[b"H"])
        n = wide * high + (2 * -(-wide // across) * -(-high // down) if across else 0)
        rate, scale = (int(x) for x in said.get(b"F", "24:1").split(":"))
        at, places = len(line) + 1, []
        step = len(b"FRAME\n") + n
        if (size - at) % step == 0 and all(_starts_frame(f, k) for k in (at, size - step)):
            places = [(k + 6, n) for k in range(at, size, step)]
        while not places or places[-1][0] + n < size:  # frames with words of their own
            f.seek(places[-1][0] + n if places else at)
            head = f.read(256).split(b"\n", 1)[0]
            if not head.startswith(b"FRAME"):
                break
            places.append(((places[-1][0] + n if places else at) + len(head) + 1, n))
        places = [p for p in places if p[0] + n <= size]
        return cls(path, rate / scale if scale and rate else RATE, places, wide, high, across, down, b"XCOLORRANGE=FULL" in line)


def _starts_frame(f, at: int) -> bool:
    f.seek(max(at, 0))
    return f.read(6) == b"FRAME\n"


@dataclass
class Npy(Video):
    """An array F x C x H x W."""

    shape: tuple = ()
    kind: str = ""

    def frame(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(self.shape).astype(np.float32)

    @classmethod
    def read(cls, path: str, f, size: int) -> Npy:
        f.seek(0)
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if by_column or len(shape) != 4:
            raise ValueError("a video is an array of four dimensions by rows")
        n, start = int(np.prod(shape[1:])) * kind.itemsize, f.tell()
        return cls(path, RATE, [(start + k * n, n) for k in range(shape[0])], shape[1:], kind.str)


def open_video(path: str) -> Video:
    """The video of a file, told by its contents; FileNotFoundError where there is none."""
    with opened(path) as f:
        size, start = f.size(), f.read(12)
        for kind, is_one in ((Avi, start[:4] == b"RIFF" and start[8:12] == b"AVI "), (Y4m, start[:9] == b"YUV4MPEG2"), (Npy, start[:6] == b"\x93NUMPY")):
            if is_one:
                return kind.read(path, f, size)
    raise ValueError("a file of no known video format")


def encode_avi(frames: np.ndarray, rate: int, quality: int = 95, index: bool = True) -> bytes:
    """F x C x H x W, 0 to 255, as an AVI of JPEG frames."""

    def chunk(name: bytes, d: bytes, kind: bytes = b"") -> bytes:
        return name + struct.pack("<I", len(d) + len(kind)) + kind + d + bytes(len(d) % 2)

    high, wide = frames.shape[-2:]
    coded = [encode_jpeg(f, quality) for f in frames]
    head = struct.pack("<14I", 1_000_000 // rate, 0, 0, 16, len(coded), 0, 1, 0, wide, high, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, rate, 0, len(coded), 0, 0, 0, 0, 0, wide, high)
    form = struct.pack("<IiiHH4s5I", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    body, rows = b"", b""
    for d in coded:
        rows += struct.pack("<4sIII", b"00dc", 16, 4 + len(body), len(d))
        body += chunk(b"00dc", d)
    lists = chunk(b"LIST", chunk(b"avih", head) + chunk(b"LIST", chunk(b"strh", stream) + chunk(b"strf", form), b"strl"), b"hdrl") + chunk(b"LIST", body, b"movi")
    return chunk(b"RIFF", lists + (chunk(b"idx1", rows) if index else b""), b"AVI ")


def encode_y4m(frames: np.ndarray, rate: int) -> bytes:
    """F x 1 x H x W bytes as a grey Y4M of the full range."""
    high, wide = frames.shape[-2:]
    return b"YUV4MPEG2 W%d H%d F%d:1 Ip A1:1 Cmono XCOLORRANGE=FULL\n" % (wide, high, rate) + b"".join(b"FRAME\n" + f.astype(np.uint8).tobytes() for f in frames)

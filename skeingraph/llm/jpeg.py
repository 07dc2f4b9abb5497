"""Baseline JPEG in numpy: marker parsing, Huffman decoding of scans, and a lossless DC-only grey-scale carrier.

Decoding reads the entropy-coded segments between restart markers side by side: one vectorised step takes the next
coefficient of every segment of every image in a batch, so Python's share of the work is one pass over a restart
interval, however many segments there are. An image without restart markers is one segment. Baseline files
of one interleaved scan are read (several components, subsampling, any AC content); those with a scan for each component
are an error. Only DC values are kept, which give each block's mean.

The carrier stores one byte per 8x8 block: with a DC quantiser of 8 and no AC coefficient, the block of byte v is flat
and of value v, so the file decodes to the bytes exactly, and its DC-only thumbnail is the payload itself.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLOCKS_WIDE = 24
#: Blocks in a restart interval of the carrier: one block row.
INTERVAL = BLOCKS_WIDE
#: Block rows of one image; longer payloads take several images after one another (heights are 16-bit).
MOST_ROWS = 8000

# The carrier's Huffman tables: categories 0..8 take four bits each; the only AC symbol, end of block, takes one.
_DC_BITS = [0, 0, 0, 9] + [0] * 12
_AC_BITS = [1] + [0] * 15


class JpegError(ValueError):
    pass


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _header(rows: int) -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    frame = struct.pack(">BHHB", 8, rows * 8, BLOCKS_WIDE * 8, 1) + bytes([1, 0x11, 0])
    tables = bytes([0x00, *_DC_BITS, *range(9)]) + bytes([0x10, *_AC_BITS, 0])
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


_CATEGORY = np.array([int(abs(d)).bit_length() for d in range(-255, 256)], np.uint8)


def encode_rows(values: np.ndarray) -> bytes:
    """One image of grey values, a multiple of 24 of them, at most 24 * MOST_ROWS."""
    rows = len(values) // BLOCKS_WIDE
    q = values.astype(np.int16).reshape(rows, BLOCKS_WIDE) - 128
    diff = np.diff(q, axis=1, prepend=np.int16(0)).ravel()
    category = _CATEGORY[diff + 255]
    # code of a block: four bits of category, its bits (one's complement when negative), one zero bit for the end of block
    size = category.astype(np.int64) + 5
    extra = np.where(diff < 0, diff + (1 << category.astype(np.int32)) - 1, diff).astype(np.uint32)
    code = ((category.astype(np.uint32) << category) | extra) << np.uint32(1)
    by_row = size.reshape(rows, BLOCKS_WIDE)
    row_bytes = (by_row.sum(axis=1) + 7) // 8
    begin = np.concatenate([[0], np.cumsum(row_bytes)[:-1]]) * 8
    at = (np.cumsum(by_row, axis=1) - by_row + begin[:, None]).ravel()
    total = int(row_bytes.sum())
    # at most 13 bits: a code touches three bytes at most
    shifted = code << (np.uint32(24) - (at & 7).astype(np.uint32) - size.astype(np.uint32))
    first = at >> 3
    out = np.zeros(total + 3, np.int64)
    for k in range(3):
        out += np.bincount(first + k, weights=(shifted >> np.uint32(16 - 8 * k)) & np.uint32(255), minlength=total + 3)[: total + 3].astype(np.int64)
    data = out[:total].astype(np.uint8)
    # pad each row's last byte with ones
    used = by_row.sum(axis=1) & 7
    last = np.cumsum(row_bytes) - 1
    data[last] |= np.where(used == 0, 0, (1 << (8 - used)) - 1).astype(np.uint8)
    # stuff a zero after each 0xFF, put restart markers between rows
    full = np.flatnonzero(data == 0xFF)
    marks = np.cumsum(row_bytes)[:-1]
    numbers = (np.arange(rows - 1) % 8 + 0xD0).astype(np.uint8)
    places = np.concatenate([full + 1, np.repeat(marks, 2)])
    what = np.concatenate([np.zeros(len(full), np.uint8), np.column_stack([np.full(rows - 1, 0xFF, np.uint8), numbers]).ravel()])
    order = np.argsort(places, kind="stable")  # at one place a stuffed zero comes before a marker
    return _header(rows) + np.insert(data, places[order], what[order]).tobytes() + b"\xff\xd9"


def encode(payload: bytes | np.ndarray) -> bytes:
    """Payload bytes (a positive multiple of 24) as one image or several after one another."""
    values = np.frombuffer(payload, np.uint8) if isinstance(payload, bytes) else payload
    step = MOST_ROWS * BLOCKS_WIDE
    return b"".join(encode_rows(values[k : k + step]) for k in range(0, len(values), step))


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """A parsed file: its frame, tables, and the unstuffed entropy-coded segments."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, int] = field(default_factory=dict)  # table number -> DC step
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)  # (class, number) -> 16 counts and symbols
    interval: int = 0
    segments: list[bytes] = field(default_factory=list)
    end: int = 0

    @property
    def sampling(self) -> tuple[int, int]:
        return max(c.h for c in self.components), max(c.v for c in self.components)

    @property
    def units(self) -> tuple[int, int]:
        """Minimum coded units: across, down."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = self.sampling
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def layout(self) -> list[int]:
        """The component of each block of a coded unit."""
        if len(self.components) == 1:
            return [0]
        return [k for k, c in enumerate(self.components) for _ in range(c.h * c.v)]

    @property
    def key(self) -> tuple:
        """Images with equal keys decode side by side."""
        return (tuple(self.layout), tuple(self.tables.get((0, c.dc), b"") + b"|" + self.tables.get((1, c.ac), b"") for c in self.components))


def parse(data: bytes, at: int = 0) -> Image:
    """Markers of the image that starts at ``at``."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    image, at = Image(), at + 2
    while True:
        while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        marker, (size,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                image.quant[number] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise JpegError("8-bit samples only")
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError("not a baseline file")
        elif marker == 0xDD:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            by = {c.ident: c for c in image.components}
            if body[0] != len(by):
                raise JpegError("one interleaved scan expected")
            for k in range(body[0]):
                c = by[body[1 + 2 * k]]
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            return _split(image, data, at)


def _split(image: Image, data: bytes, at: int) -> Image:
    """Cut the scan at its restart markers and take out the stuffed zeros."""
    stop = at
    while True:
        stop = data.find(b"\xff", stop)
        if stop < 0 or stop + 1 >= len(data):
            raise JpegError("the scan has no end")
        if data[stop + 1] == 0xD9:
            break
        if data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7:
            raise JpegError("a marker inside the scan")
        stop += 2
    scan = np.frombuffer(data, np.uint8, stop - at, at)
    full = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.zeros(0, np.int64)
    after = scan[full + 1]
    marks = full[after >= 0xD0]
    keep = np.ones(len(scan), bool)
    keep[full[after == 0] + 1] = False
    cuts = np.concatenate([[0], marks + 2, [len(scan) + 2]])
    kept = np.concatenate([[0], np.cumsum(keep)])
    clean = scan[keep].tobytes()
    image.segments = [clean[kept[a] : kept[min(b - 2, len(scan))]] for a, b in zip(cuts[:-1], cuts[1:])]
    image.end = stop + 2
    return image


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 leading bits: the code's length (0: no code) and its symbol."""
    length, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code, at = 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            begin = code << (16 - size)
            length[begin : begin + (1 << (16 - size))] = size
            symbol[begin : begin + (1 << (16 - size))] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length, symbol


@lru_cache(16)  # a megabyte each
def _cached_lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _lookup(table)


def decode_dc(images: list[Image]) -> list[list[np.ndarray]]:
    """DC values (before the step is applied) of images with equal keys: for each image and component, one row per coded unit."""
    layout, first = images[0].layout, images[0]
    dc = [_cached_lookup(first.tables[0, c.dc]) for c in first.components]
    ac = [_cached_lookup(first.tables[1, c.ac]) for c in first.components]
    segments = [s for image in images for s in image.segments]
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)])[:-1]
    raw = np.frombuffer(b"".join(s + b"\xff" * 8 for s in segments), np.uint8)
    units = []
    for image in images:
        total = image.units[0] * image.units[1]
        step = image.interval or total
        n = -(-total // step)
        if len(image.segments) != n:
            raise JpegError(f"{len(image.segments)} segments instead of {n}")
        units += [step] * (n - 1) + [total - step * (n - 1)]
    units = np.array(units, np.int64)
    limit = (begin + sizes + 7) * 8
    bit = begin * 8
    order = np.argsort(-units, kind="stable")  # those that go on longest first, so that live ones are a prefix
    bit, limit = bit[order], limit[order]
    live = np.searchsorted(-units[order], -np.arange(units.max()), side="left")
    out = np.zeros((units.max(), len(layout), len(segments)), np.int32)
    wide = (raw.astype(np.uint32) << np.uint32(24))
    wide[:-1] |= raw[1:].astype(np.uint32) << np.uint32(16)
    wide[:-2] |= raw[2:].astype(np.uint32) << np.uint32(8)
    wide[:-3] |= raw[3:]

    def peek(at: np.ndarray) -> np.ndarray:
        """The 25 bits from each position on, as the upper bits of 32."""
        return wide[at >> 3] << (at & 7).astype(np.uint32)

    last = np.zeros((len(first.components), len(segments)), np.int32)
    for unit in range(int(units.max())):
        n = live[unit]
        for slot, c in enumerate(layout):
            at = bit[:n]
            bits = peek(at)
            code = (bits >> np.uint32(16)).astype(np.int64)
            used, size = dc[c][0][code], dc[c][1][code]
            if not used.all() or (size > 11).any():
                raise JpegError("a code that the table lacks")
            at = at + used
            value = (peek(at).astype(np.int64) >> (32 - size)) & ((1 << size) - 1)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            last[c, :n] += value.astype(np.int32)
            out[unit, slot, :n] = last[c, :n]
            at = at + size
            # AC coefficients: skipped until the end of block
            which, k = None, None
            while True:
                code = (peek(at if which is None else at[which]) >> np.uint32(16)).astype(np.int64)
                used, symbol = ac[c][0][code], ac[c][1][code]
                if not used.all():
                    raise JpegError("a code that the table lacks")
                size, run = symbol & 15, symbol >> 4
                if which is None:
                    at = at + used + size
                    if not symbol.any():
                        break
                    which, k = np.arange(n), np.ones(n, np.int64)
                else:
                    at[which] += used + size
                k = k + np.where(size > 0, run + 1, np.where(run == 15, 16, 64))
                more = k < 64
                which, k = which[more], k[more]
                if not len(which):
                    break
            if (at > limit[:n]).any():
                raise JpegError("the scan is too short")
            bit[:n] = at
    undo = np.empty_like(order)
    undo[order] = np.arange(len(order))
    out = out[:, :, undo]
    found, at = [], 0
    for image in images:
        n = len(image.segments)
        own = [out[: units[at + s], :, at + s] for s in range(n)] if n > 1 and units[at + n - 1] != units[at] else None
        rows = np.concatenate(own) if own else out[: units[at], :, at : at + n].transpose(2, 0, 1).reshape(-1, len(layout))
        found.append([rows[:, [k for k, c in enumerate(layout) if c == component]] for component in range(len(image.components))])
        at += n
    return found


def luminance(image: Image, dc: list[np.ndarray]) -> np.ndarray:
    """The DC-only thumbnail: one grey sample per 8x8 block of the first component."""
    c = image.components[0]
    across, down = image.units
    h, v = (1, 1) if len(image.components) == 1 else (c.h, c.v)
    step = image.quant[c.quant]
    grid = dc[0].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    top_h, top_v = image.sampling
    wide = -(-(-(-image.width * (1 if len(image.components) == 1 else c.h) // (1 if len(image.components) == 1 else top_h))) // 8)
    high = -(-(-(-image.height * (1 if len(image.components) == 1 else c.v) // (1 if len(image.components) == 1 else top_v))) // 8)
    return np.clip(np.rint(grid[:high, :wide] * step / 8.0) + 128, 0, 255).astype(np.uint8)


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each file its images' (width, height, thumbnail); files with the same tables are decoded together."""
    images = []
    for number, data in enumerate(files):
        at = 0
        while at < len(data):
            images.append((number, parse(data, at)))
            at = images[-1][1].end
    found: list = [None] * len(images)
    by_key: dict[tuple, list[int]] = {}
    for k, (_, image) in enumerate(images):
        by_key.setdefault(image.key, []).append(k)
    for own in by_key.values():
        for k, dc in zip(own, decode_dc([images[k][1] for k in own])):
            found[k] = luminance(images[k][1], dc)
    out: list[list] = [[] for _ in files]
    for (number, image), thumb in zip(images, found):
        out[number].append((image.width, image.height, thumb))
    return out

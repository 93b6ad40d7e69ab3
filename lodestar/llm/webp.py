"""Lossless WebP (VP8L): encoder of stored payloads, complete decoder, pixel arrays.

The decoder reads every construct of the format: simple and normal prefix codes, meta prefix codes, back-references,
the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Files whose red, blue and alpha
have codes of one symbol (grey images) are decoded side by side: a step reads one symbol of each file, a literal or a
back-reference, and numpy does it for all files at once. Everything else goes symbol by symbol.

The encoder stores payloads as grey images of 576 pixels a row, a byte a pixel and a few rows a file. Green has prefix
codes made from counts, repeated bytes become back-references, and red and blue vanish by the subtract-green transform. For
each file the entropies of the bytes and of what two predictors leave decide whether it has a predictor transform.
Cross-colour factors have nothing to predict where red and blue are zero, and a colour cache or an unpacked palette only
rename bytes that one code stands for already; the encoder doesn't use them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import pieces, texts_of, tidy

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 1 << 14
#: Bytes, and pixels, of one stored row.
ROW_BYTES = 576
#: Rows of a file: files are decoded side by side, and no text makes them longer.
FILE_ROWS = 8
#: Longest codes that the encoder makes for green and for distances: so large are the tables of files read side by side.
GREEN_BITS, DISTANCE_BITS = 11, 8
#: Shortest repeated string that becomes a back-reference, and the longest.
LEAST_MATCH, MOST_MATCH = 6, 4096
#: Modes of the predictors that the encoder tries, the blocks (as a power of two) for which it says so, and the bits by which one must be better.
LEFT, TOP, MODE_BLOCK, LEAST_GAIN = 1, 2, 9, 64
#: Files that are encoded together: few enough for the arrays to stay in the processor's caches.
FILES_AT_ONCE = 128
#: Where the first 120 distance codes point (columns back, rows up), by rising distance: a rule of the format.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]),
)


def reversed_bits(value: int, bits: int) -> int:
    return int(format(value, f"0{bits}b")[::-1], 2) if bits else 0


REVERSED = {n: np.array([reversed_bits(b, n) for b in range(1 << n)], np.int64) for n in (GREEN_BITS, DISTANCE_BITS)}


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0  # at: bits read so far

    def peek(self, n: int) -> int:
        byte, shift = divmod(self.at, 8)
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> shift) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


class BitWriter:
    def __init__(self) -> None:
        self.value, self.bits, self.out = 0, 0, bytearray()

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n
        while self.bits >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.bits -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value]) if self.bits else b"")


class PrefixCode:
    """A canonical prefix code, read by table."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.table, self.only = 0, [(used[0][1], 0)], used[0][1]
            return
        if sum(2.0 ** -n for n, _ in used) != 1:
            raise ValueError("a prefix code that is not complete")
        self.bits, self.only = max(n for n, _ in used), None
        self.table = [(0, 0)] * (1 << self.bits)
        code = last = 0
        for n, symbol in sorted(used):
            code <<= n - last
            last = n
            low = reversed_bits(code, n)
            for high in range(1 << (self.bits - n)):
                self.table[low | high << n] = (symbol, n)
            code += 1

    def read(self, bits: BitReader) -> int:
        symbol, n = self.table[bits.peek(self.bits)]
        bits.at += n
        return symbol


@lru_cache(maxsize=256)
def prefix_code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(list(lengths))


def read_lengths(bits: BitReader, alphabet: int) -> tuple[int, ...]:
    """Code lengths of an alphabet's symbols."""
    lengths = [0] * alphabet
    if bits.read(1):  # simple: one or two symbols
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    count, of_lengths = 4 + bits.read(4), [0] * 19
    for k in CODE_LENGTH_ORDER[:count]:
        of_lengths[k] = bits.read(3)
    code = prefix_code(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits) if code.only is None else code.only
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            previous = symbol or previous
            continue
        base, extra, value = {16: (3, 2, previous), 17: (3, 3, 0), 18: (11, 7, 0)}[symbol]
        times = base + bits.read(extra)
        if at + times > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    return tuple(lengths)


def read_prefixed(bits: BitReader, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def subsampled(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def read_pixels(bits: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """One entropy-coded image, ARGB as unsigned 32 bits, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, meta = 1, 0, None
    if top and bits.read(1):
        block = bits.read(3) + 2
        meta = (read_pixels(bits, subsampled(width, block), subsampled(height, block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [[prefix_code(read_lengths(bits, n)) for n in sizes] for _ in range(groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    cache, cached = [0] * (1 << cache_bits if cache_bits else 0), 0
    across = subsampled(width, block)

    def remember(upto: int) -> None:
        for value in out[cached:upto].tolist():
            cache[(CACHE_MULTIPLIER * value & 0xFFFFFFFF) >> (32 - cache_bits)] = value

    at = 0
    while at < total:
        group = codes[0] if meta is None else codes[int(meta[(at // width >> block) * across + (at % width >> block)])]
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < LITERALS + LENGTH_CODES:
            length = read_prefixed(bits, symbol - LITERALS)
            code = read_prefixed(bits, group[4].read(bits))
            if code > len(NEAR):
                distance = code - 120
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise ValueError("a back-reference outside the image")
            for done in range(0, length, distance):
                n = min(distance, length - done)
                out[at + done : at + done + n] = out[at - distance : at - distance + n]
            at += length
        else:
            if cache_bits:
                remember(at)
                cached = at
            out[at] = cache[symbol - LITERALS - LENGTH_CODES]
            at += 1
    return out


def bytes_of(pixels: np.ndarray) -> np.ndarray:
    """Channels (blue, green, red, alpha) of ARGB values."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def predicted(mode: int, left: np.ndarray, top: np.ndarray, left_top: np.ndarray, right_top: np.ndarray) -> np.ndarray:
    """The format's 14 predictors, each channel on its own; all arguments hold signed integers of one pixel."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        # The sides swap: what matters is how far the gradient estimate lies from each neighbour.
        return left if np.abs(top - left_top).sum() < np.abs(left - left_top).sum() else top
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        middle = mean(left, top)
        return np.clip(middle + np.trunc((middle - left_top) / 2).astype(middle.dtype), 0, 255)
    return {
        0: lambda: np.array([0, 0, 0, 255]), 1: lambda: left, 2: lambda: top, 3: lambda: right_top, 4: lambda: left_top,
        5: lambda: mean(mean(left, right_top), top), 6: lambda: mean(left, left_top), 7: lambda: mean(left, top),
        8: lambda: mean(left_top, top), 9: lambda: mean(top, right_top),
        10: lambda: mean(mean(left, left_top), mean(top, right_top)),
    }.get(mode, lambda: np.array([0, 0, 0, 255]))()


def undo_predictor(pixels: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    """Add each pixel's prediction, mod 256 by channel."""
    rows = bytes_of(pixels).reshape(height, width, 4)
    modes = ((modes >> 8) & 15).reshape(-1, subsampled(width, block))
    if (modes == 2).all():  # top everywhere: sums down the first column and then down all
        rows = rows.copy()
        rows[0, 0, 3:] += 255
        rows[0] = np.cumsum(rows[0], axis=0, dtype=np.uint8)
        out = np.cumsum(rows, axis=0, dtype=np.uint8)
        return out.reshape(-1, 4).view("<u4").reshape(-1)
    out = rows.astype(np.int16)
    for y in range(height):
        if y == 0:
            out[0, 0, 3] += 255
            out[0] = np.cumsum(out[0], axis=0) & 255
            continue
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        above = np.concatenate([out[y - 1], out[y, :1]])  # right of the last pixel: this row's first
        x = 1
        while x < width:
            end = min(width, ((x >> block) + 1) << block)
            mode = int(modes[y >> block, x >> block])
            if mode == 1:
                out[y, x - 1 : end] = np.cumsum(out[y, x - 1 : end], axis=0) & 255
            elif mode in (2, 3, 4, 8, 9):
                out[y, x:end] = (out[y, x:end] + predicted(mode, out[y, x:end], above[x:end], above[x - 1 : end - 1], above[x + 1 : end + 1])) & 255
            else:
                for i in range(x, end):
                    out[y, i] = (out[y, i] + predicted(mode, out[y, i - 1], above[i], above[i - 1], above[i + 1])) & 255
            x = end
    return out.astype(np.uint8).reshape(-1, 4).view("<u4").reshape(-1)


def colour_steps(channels: np.ndarray, factors: np.ndarray, width: int, height: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Green as a signed number, and each pixel's three factors (green to red, green to blue, red to blue)."""
    f = bytes_of(factors).reshape(subsampled(height, block), subsampled(width, block), 4).astype(np.int8).astype(np.int32)
    if len(f) == 1 and f.shape[1] == 1:
        each = f[0]
    else:
        each = f[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block].reshape(-1, 4)
    return channels[:, 1].astype(np.int8).astype(np.int32), each[:, 0], each[:, 1], each[:, 2]


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    out = bytes_of(pixels).copy()
    green, to_red, to_blue, red_to_blue = colour_steps(out, factors, width, height, block)
    out[:, 2] += ((green * to_red) >> 5).astype(np.uint8)
    out[:, 0] += ((green * to_blue) >> 5).astype(np.uint8)
    out[:, 0] += ((out[:, 2].astype(np.int8).astype(np.int32) * red_to_blue) >> 5).astype(np.uint8)
    return out.view("<u4").reshape(-1)


def undo_green(pixels: np.ndarray) -> np.ndarray:
    out = bytes_of(pixels).copy()
    out[:, 0] += out[:, 1]
    out[:, 2] += out[:, 1]
    return out.view("<u4").reshape(-1)


def undo_palette(pixels: np.ndarray, width: int, height: int, packed: int, colours: np.ndarray) -> np.ndarray:
    """Indices, several to a pixel in small palettes, to colours; beyond the palette: transparent black."""
    index = ((pixels >> 8) & 255).reshape(height, -1)
    if packed:
        each, mask = 8 >> packed, (1 << (8 >> packed)) - 1
        index = (index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * each) & mask).reshape(height, -1)[:, :width]
    return np.r_[colours, np.zeros(256, np.uint32)][index].reshape(-1)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The first WebP file in ``data``: pixels (height x width, ARGB) and the file's length."""
    size = struct.unpack("<I", data[4:8])[0] + 8
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = BitReader(data[21:size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether alpha is in use: a hint
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, inner, block, read_pixels(bits, subsampled(inner, block), subsampled(height, block), False)))
        elif kind == PALETTE:
            count = bits.read(8) + 1
            colours = np.cumsum(bytes_of(read_pixels(bits, count, 1, False)), axis=0, dtype=np.uint8).view("<u4").reshape(-1)
            packed = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            transforms.append((kind, inner, packed, colours))
            inner = subsampled(inner, packed)
        else:
            transforms.append((kind, inner, 0, None))
    pixels = read_pixels(bits, inner, height, True)
    for kind, across, number, more in reversed(transforms):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, across, height, number, more)
        elif kind == CROSS_COLOUR:
            pixels = undo_cross_colour(pixels, across, height, number, more)
        elif kind == PALETTE:
            pixels = undo_palette(pixels, across, height, number, more)
        else:
            pixels = undo_green(pixels)
    return pixels.reshape(height, width), size + (size & 1)


def undo_grey(rows: np.ndarray, mode: int) -> None:
    """The pixels of a grey file in place of what the left or top predictor left: the first row is predicted from the left, the first
    column from above."""
    edge, inner = (rows[:, 0], 1) if mode == LEFT else (rows[0], 0)
    np.cumsum(edge, dtype=np.uint8, out=edge)
    np.cumsum(rows, axis=inner, dtype=np.uint8, out=rows)


class GreyFiles:
    """Grey files that are decoded side by side."""

    def __init__(self) -> None:
        self.data, self.starts, self.greens, self.distances, self.sizes, self.modes = bytearray(), [], [], [], [], []

    def add(self, data: bytes, start: int, size: int) -> bool:
        """Whether the file at ``start`` is one of these: no cache, no meta codes, nothing but green and distances coded, and
        one of the encoder's predictors everywhere or none."""
        if data[start + 20] != 0x2F:
            return False
        bits = BitReader(data[start + 21 : start + size])
        width, height, head = bits.read(14) + 1, bits.read(14) + 1, bits.read(4) >> 1
        if head or width != ROW_BYTES or bits.read(3) != (1 | SUBTRACT_GREEN << 1):
            return False
        mode = 0
        if bits.read(1):
            if bits.read(2) != PREDICTOR:
                return False
            block = bits.read(3) + 2
            told = np.unique(read_pixels(bits, subsampled(width, block), subsampled(height, block), False) >> 8 & 15)
            mode = int(told[0])
            if len(told) > 1 or mode not in (LEFT, TOP) or bits.read(1):
                return False
        if bits.read(2):
            return False
        lengths = [read_lengths(bits, n) for n in (LITERALS + LENGTH_CODES, 256, 256, 256, DISTANCE_CODES)]
        one = all(sum(map(bool, lengths[k])) == 1 and lengths[k][v] for k, v in ((1, 0), (2, 0), (3, 0 if mode else 255)))
        if not one or max(lengths[0]) > GREEN_BITS or max(lengths[4]) > DISTANCE_BITS:
            return False
        self.starts.append(8 * (len(self.data) + 21) + bits.at)
        self.data += data[start : start + size]
        self.greens.append(lengths[0])
        self.distances.append(lengths[4])
        self.sizes.append(width * height)
        self.modes.append(mode)
        return True

    @staticmethod
    def tables(lengths: list[tuple[int, ...]], bits: int) -> np.ndarray:
        """For each file, what the next ``bits`` bits begin with: symbol and code length (16 * symbol + length)."""
        rows = np.array(lengths, np.int64)
        rows[(rows > 0).sum(axis=1) == 1] *= -1  # a single symbol has no bits
        wide = np.where(rows > 0, 1 << (bits - np.maximum(rows, 0)), np.where(rows < 0, 1 << bits, 0))
        if (wide.sum(axis=1) != 1 << bits).any():
            raise ValueError("a prefix code that is not complete")
        order = np.argsort(np.where(rows == 0, 99, rows), axis=1, kind="stable")
        pick = lambda x: np.take_along_axis(x, order, axis=1).ravel()
        entry = (order.ravel() << 4 | np.maximum(pick(rows), 0)).astype(np.uint16)
        return np.repeat(entry, pick(wide)).reshape(len(rows), -1)[:, REVERSED[bits]]

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """All files' pixels, a byte each, and where each file begins in them."""
        edges = np.r_[0, np.cumsum(self.sizes)]
        out = np.zeros(edges[-1], np.uint8)
        raw = np.frombuffer(bytes(self.data) + b"\0" * 8, np.uint8)
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
        green, far = self.tables(self.greens, GREEN_BITS), self.tables(self.distances, DISTANCE_BITS)
        file, bit, at, end = np.arange(len(self.sizes)), np.array(self.starts), edges[:-1].copy(), edges[1:]
        while len(file):
            word = words[bit >> 3] >> (bit & 7).astype(np.uint64)
            entry = green[file, word & np.uint64((1 << GREEN_BITS) - 1)].astype(np.int64)
            symbol, n = entry >> 4, entry & 15
            bit += n
            copies = symbol >= LITERALS
            if not copies.any():
                out[at] = symbol
                at += 1
            else:
                literal = np.flatnonzero(~copies)
                out[at[literal]] = symbol[literal]
                at[literal] += 1
                x = np.flatnonzero(copies)
                rest = word[x] >> n[x].astype(np.uint64)
                length, used = self.prefixed(symbol[x] - LITERALS, rest)
                rest >>= used.astype(np.uint64)
                entry = far[file[x], rest & np.uint64((1 << DISTANCE_BITS) - 1)].astype(np.int64)
                rest >>= (entry & 15).astype(np.uint64)
                code, more = self.prefixed(entry >> 4, rest)
                bit[x] += used + (entry & 15) + more
                distance = np.where(code > len(NEAR), code - len(NEAR), NEAR_PLACES[np.minimum(code, len(NEAR)) - 1])
                to = at[x]
                if (distance > to - edges[file[x]]).any() or (to + length > end[file[x]]).any():
                    raise ValueError("a back-reference outside the image")
                within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                source = np.repeat(to - distance, length) + within % np.repeat(distance, length)
                out[np.repeat(to, length) + within] = out[source]
                at[x] += length
            left = at < end[file]
            if not left.all():
                file, bit, at = file[left], bit[left], at[left]
        for k in np.flatnonzero(self.modes).tolist():
            undo_grey(out[edges[k] : edges[k + 1]].reshape(-1, ROW_BYTES), self.modes[k])
        return out, edges

    @staticmethod
    def prefixed(symbol: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths or distances from prefix symbols and the bits after them, and how many bits those are."""
        extra = np.maximum(0, (symbol - 2) >> 1)
        base = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
        return base + (rest & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1, extra


#: The distances of the first 120 distance codes in rows of ``ROW_BYTES`` pixels.
NEAR_PLACES = np.array([max(1, x + y * ROW_BYTES) for x, y in NEAR])


def files_of(data: bytes) -> Iterator[tuple[int, int]]:
    """Where the WebP files begin that follow one another in ``data``, and how long they are."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = struct.unpack("<I", data[at + 4 : at + 8])[0] + 8
        yield at, size
        at += size + (size & 1)


def decode_all(data: bytes) -> list[np.ndarray]:
    """The pixels of all WebP files that follow one another in ``data``."""
    return [decode(data[at : at + size])[0] for at, size in files_of(data)]


def decode_many(blobs: list[bytes]) -> list[tuple[list[int], int, np.ndarray]]:
    """Of each blob of files: heights, channels, and pixels as bytes.

    One channel if all files are grey and as wide as the encoder's, else four (blue, green, red, alpha).
    """
    grey, own = GreyFiles(), []
    for data in blobs:
        first = len(grey.sizes)
        own.append((first, len(grey.sizes)) if all(grey.add(data, at, size) for at, size in list(files_of(data))) else None)
        if own[-1]:
            own[-1] = (first, len(grey.sizes))
    pixels, edges = grey.decode() if grey.sizes else (None, None)
    out = []
    for data, part in zip(blobs, own):
        if part:
            a, b = part
            out.append(([n // ROW_BYTES for n in grey.sizes[a:b]], 1, pixels[edges[a] : edges[b]]))
        else:
            images = decode_all(data)
            out.append(([len(x) for x in images], 4, np.concatenate([bytes_of(x).ravel() for x in images])))
    return out


def code_lengths(used: list[tuple[int, int]], limit: int) -> list[int]:
    """Lengths of a Huffman code for symbols (counts and symbols are given); none is longer than ``limit``."""
    if len(used) < 2:
        return [1] * len(used)
    least = 1
    while True:
        heap = [(max(c, least), s, (i,)) for i, (c, s) in enumerate(used)]
        heapify(heap)
        deep = [0] * len(used)
        while len(heap) > 1:
            c, s, x = heappop(heap)
            d, _, y = heap[0]
            both = x + y
            for k in both:
                deep[k] += 1
            heapreplace(heap, (c + d, s, both))
        if max(deep) <= limit:
            return deep
        least *= 2  # rare symbols count for more until the code is flat enough


def all_code_lengths(counts: np.ndarray, limit: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Code lengths for each row of counts, as a matrix, and as symbols and lengths of each row."""
    row, symbol = np.nonzero(counts)
    edges = np.searchsorted(row, np.arange(len(counts) + 1)).tolist()
    pairs = list(zip(counts[row, symbol].tolist(), symbol.tolist()))
    found = [code_lengths(pairs[a:b], limit) for a, b in zip(edges[:-1], edges[1:])]
    lengths = np.zeros(counts.shape, np.int32)
    lengths[row, symbol] = [n for one in found for n in one]
    return lengths, [[(s, n) for (_, s), n in zip(pairs[a:b], one)] for a, b, one in zip(edges[:-1], edges[1:], found)]


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value of lengths or distance codes."""
    x = value - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(0, high - 1) & 1)), extra, np.where(x < 4, 0, x & ((1 << np.maximum(extra, 0)) - 1))


def matches(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings inside each file: where they begin, how long they are and how far back they stand before.

    Each place's four bytes were last seen somewhere; neighbours that agree on how far back make one string.
    """
    file = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    place = np.arange(len(data)) - edges[file]
    inside = np.flatnonzero(place[: len(data) - 3] + 4 <= np.diff(edges)[file[: len(data) - 3]])
    word = np.ndarray((len(data) - 3,), "<u4", np.ascontiguousarray(data), strides=(1,))  # the four bytes from each place on
    # one sort: file, four bytes, place
    key = np.sort(file[inside].astype(np.uint64) << np.uint64(45) | word[inside] << np.uint64(13) | place[inside].astype(np.uint64))
    seen = edges[(key >> np.uint64(45)).astype(np.int64)] + (key & np.uint64(8191)).astype(np.int64)
    same = key[1:] >> np.uint64(13) == key[:-1] >> np.uint64(13)
    back = np.zeros(len(data), np.int64)
    back[seen[1:][same]] = seen[1:][same] - seen[:-1][same]
    fresh = (back > 0) & np.r_[True, (back[1:] != back[:-1]) | (file[1:] != file[:-1])]
    start = np.flatnonzero(fresh)
    stop = np.flatnonzero((back > 0) & np.r_[(back[1:] != back[:-1]) | (file[1:] != file[:-1]), True]) + 4
    far = back[start]
    long = stop - start >= LEAST_MATCH
    start, stop, far = start[long], stop[long], far[long]
    start = np.maximum(start, np.r_[0, np.maximum.accumulate(stop)[:-1]][: len(start)])
    length = np.minimum(stop - start, MOST_MATCH)
    good = length >= LEAST_MATCH
    return start[good], length[good], far[good]


def code_items(lengths: list[tuple[int, int]], alphabet: int) -> list[tuple[int, int]]:
    """A prefix code (symbols and lengths) as values and their bits. Lengths are written in a fixed code: 3 bits for 0 and
    18, 4 for the others."""
    if len(lengths) < 2 and (not lengths or lengths[0][0] < LITERALS):
        symbol = lengths[0][0] if lengths else 0
        return [(1 | 1 << 2 | symbol << 3, 11)] if symbol > 1 else [(1 | symbol << 3, 4)]
    items, before = [(15 << 1, 5), *LENGTH_CODE_LENGTHS, (0, 1)], -1
    for symbol, n in (*lengths, (alphabet, 0)):
        gap = symbol - before - 1
        while gap >= 11:
            items += [LENGTH_CODE[18], (min(gap, 138) - 11, 7)]
            gap -= min(gap, 138)
        if gap >= 3:
            items += [LENGTH_CODE[17], (gap - 3, 3)]
        else:
            items += [LENGTH_CODE[0]] * gap
        if n:
            items.append(LENGTH_CODE[n])
        before = symbol
    return items


def fixed_length_code() -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """The code in which code lengths are written: as the lengths of its own codes, and as codes."""
    own = {s: 3 if s in (0, 18) else 4 for s in (*range(12), 17, 18)}
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in own.items()):
        code <<= n - last
        codes[s], last = (reversed_bits(code, n), n), n
        code += 1
    return [(own.get(s, 0), 3) for s in CODE_LENGTH_ORDER], codes


LENGTH_CODE_LENGTHS, LENGTH_CODE = fixed_length_code()


def reversed_codes(lengths: np.ndarray, bits: int) -> np.ndarray:
    """The canonical codes of each row's symbols, last bit first."""
    order = np.argsort(np.where(lengths == 0, 99, lengths), axis=1, kind="stable")
    held = np.take_along_axis(np.where(lengths > 0, 1 << (bits - lengths), 0), order, axis=1)
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, REVERSED[bits][np.minimum(np.cumsum(held, axis=1) - held, (1 << bits) - 1)], axis=1)
    return out


def predicted_files(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all files, or what the left or the top predictor leaves of them, and which mode each file has (0: none).

    That with the least entropy is taken, if it is better by more than the transform's own bits. Pixels that equal their left or
    upper neighbour don't count: back-references have those."""
    rows, count = data.reshape(-1, ROW_BYTES), len(edges) - 1
    heads = edges[:-1] // ROW_BYTES
    across, down = rows.copy(), rows.copy()
    across[:, 1:] -= rows[:, :-1]
    down[1:] -= rows[:-1]
    down[heads] = across[heads]
    first = np.ones(len(rows), bool)
    first[heads] = False
    across[first, 0] = down[first, 0]
    file = np.repeat(np.arange(count) << 8, np.diff(edges) // ROW_BYTES)[:, None]
    apart = (across != 0) & (down != 0)
    where = np.broadcast_to(file, rows.shape)[apart]
    kinds = (rows, across, down)
    bits = []
    for values in kinds:
        n = np.bincount(where | values[apart], minlength=count << 8).reshape(count, 256)
        every = n.sum(axis=1)
        bits.append(every * np.log2(np.maximum(every, 1)) - (n * np.log2(np.maximum(n, 1))).sum(axis=1))
    bits[0] -= LEAST_GAIN
    mode = np.argmin(bits, axis=0)
    if not mode.any():
        return data, mode
    return np.choose(mode[file >> 8], kinds).ravel(), mode


def head_items(height: int, mode: int) -> list[tuple[int, int]]:
    """What a file begins with, up to the prefix codes: size and transforms, and neither colour cache nor meta codes."""
    items = [(0x2F, 8), (ROW_BYTES - 1, 14), (height - 1, 14), (0, 4), (1 | SUBTRACT_GREEN << 1, 3)]
    if mode:  # an image of one colour: codes of one symbol each, no bits a pixel
        green = (1 | mode << 3, 4) if mode < 2 else (1 | 1 << 2 | mode << 3, 11)
        items += [(1 | PREDICTOR << 1, 3), (MODE_BLOCK - 2, 3), (0, 1), green, (1, 4), (1, 4), (1 | 1 << 2 | 255 << 3, 11), (1, 4)]
    return [*items, (0, 3)]


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A file for each payload (bytes, whole rows, no more than a file's)."""
    edges = np.r_[0, np.cumsum([len(p) for p in payloads])]
    count = len(payloads)
    data, mode = predicted_files(np.concatenate(payloads), edges)
    start, length, far = matches(data, edges)
    covered = np.zeros(len(data) + 1, np.int8)
    covered[start] += 1
    covered[start + length] -= 1  # the next string may begin there
    single = np.cumsum(covered[:-1], dtype=np.int8) == 0
    single[start] = True
    token = np.flatnonzero(single)
    first = np.searchsorted(token, edges)
    file = np.repeat(np.arange(count), np.diff(first))
    copy = np.searchsorted(token, start)
    symbol = data[token].astype(np.int64)
    size, more, rest = prefix_of(length)
    symbol[copy] = LITERALS + size
    code = np.where(far == 1, 1 + NEAR.index((1, 0)), np.where(far == ROW_BYTES, 1 + NEAR.index((0, 1)), far + len(NEAR)))
    distance, far_more, far_rest = prefix_of(code)
    every = LITERALS + LENGTH_CODES
    green, green_codes = all_code_lengths(np.bincount(file * every + symbol, minlength=every * count).reshape(count, every), GREEN_BITS)
    counts = np.bincount(file[copy] * DISTANCE_CODES + distance, minlength=DISTANCE_CODES * count).reshape(count, DISTANCE_CODES)
    away, away_codes = all_code_lengths(counts, DISTANCE_BITS)
    # One item of bits for each token (its code, and the rest of a length), one more for each distance and its rest.
    coded = lambda lengths, bits: (np.where((lengths > 0).sum(axis=1, keepdims=True) == 1, 0, lengths), reversed_codes(lengths, bits))
    bits, codes = coded(green, GREEN_BITS)
    n, value = bits[file, symbol].astype(np.int64), codes[file, symbol].astype(np.int64)
    value[copy] = np.where(n[copy] > 0, value[copy], 0) | rest << n[copy]
    n[copy] += more
    bits, codes = coded(away, DISTANCE_BITS)
    m, other = bits[file[copy], distance].astype(np.int64), codes[file[copy], distance].astype(np.int64)
    other = np.where(m > 0, other, 0) | far_rest << m
    m += far_more
    # Where each file's bits begin, its head's and then its tokens'; files begin on a byte.
    heads = []
    for k in range(count):
        height = int(edges[k + 1] - edges[k]) // ROW_BYTES
        alpha = (1, 4) if mode[k] else (1 | 1 << 2 | 255 << 3, 11)  # opaque, or nothing left by the predictor
        heads.append([*head_items(height, int(mode[k])), *code_items(green_codes[k], every), (1, 4), (1, 4), alpha, *code_items(away_codes[k], DISTANCE_CODES)])
    head_n = np.array([b for h in heads for _, b in h])
    head_edges = np.r_[0, np.cumsum([len(h) for h in heads])]
    total = n.copy()
    total[copy] += m
    head_at, at = np.r_[0, np.cumsum(head_n)], np.r_[0, np.cumsum(total)]
    head_bits, body_bits = np.diff(head_at[head_edges]), np.diff(at[first])
    took = (head_bits + body_bits + 7) // 8
    base = 8 * (np.cumsum(took) - took)
    head_at = head_at[:-1] + np.repeat(base - head_at[head_edges[:-1]], np.diff(head_edges))
    at = at[:-1] + (base + head_bits - at[first[:-1]])[file]
    where = np.concatenate([head_at, at, at[copy] + n[copy]])
    held = np.concatenate([np.array([v for h in heads for v, _ in h]), np.where(n > 0, value, 0), other]).astype(np.uint64)
    held <<= (where & 31).astype(np.uint64)
    words = np.bincount(where >> 5, (held & np.uint64(0xFFFFFFFF)).astype(np.float64), took.sum() // 4 + 3)
    words += np.bincount((where >> 5) + 1, (held >> np.uint64(32)).astype(np.float64), took.sum() // 4 + 3)
    body = words.astype("<u4").tobytes()
    out = []
    for begin, size in zip((base // 8).tolist(), took.tolist()):
        padded = size + (size & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + padded) + b"WEBPVP8L" + struct.pack("<I", size) + body[begin : begin + size] + b"\0" * (size & 1))
    return out


def stored_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 576 bytes, at least one row) as WebP files of a few rows, one after another."""
    parts = [np.frombuffer(p, np.uint8)[i : i + FILE_ROWS * ROW_BYTES] for p in payloads for i in range(0, len(p), FILE_ROWS * ROW_BYTES)]
    files = [f for i in range(0, len(parts), FILES_AT_ONCE) for f in encode(parts[i : i + FILES_AT_ONCE])]
    out, at = [], 0
    for p in payloads:
        n = -(-len(p) // (FILE_ROWS * ROW_BYTES))
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def stored(payload: bytes) -> bytes:
    return stored_many([payload])[0]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and its payload: padded with 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b"\xff")


def features(width: int, heights: list[int], channels: int, pixels: np.ndarray) -> str:
    """Size, channel means, and whether green rises from each eighteenth of the pixels to the next."""
    each = pixels.reshape(-1, channels)
    edges = np.arange(18) * len(each) // 18
    counts = np.diff(np.r_[edges, len(each)])
    sums = np.add.reduceat(each, edges, axis=0, dtype=np.int64)
    means = (sums[counts > 0]).sum(axis=0) / len(each)
    green = sums[:, channels // 4] / np.maximum(1, counts)
    steps = int(((green[1:] > green[:-1]) << np.arange(17)).sum())
    return f"{width}x{sum(heights)} {' '.join(f'{m:.3f}' for m in means)} {steps:05x}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as lossless WebP: id, ``n_bytes`` and ``media`` (the files one after another).

    Null and empty texts give one row of padding; repeated rows give equal files; an empty table gives no rows; other
    columns, whatever their names, are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            paid = [payload_of(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in paid], pa.int64()), pa.array(stored_many([p for _, p in paid]), pa.binary())],
                ["id", "n_bytes", "media"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(tidy(run), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, carry: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """Decoded media: ``carry``, ``media``, ``width``, ``heights`` (of each file), ``channels``, ``pixels`` (bytes, row after
    row, all files: one a pixel of grey files as the encoder's, else blue, green, red, alpha) and ``feature``. Null media
    gives nulls; an empty table gives no rows; a broken file fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__media"):
            blobs = texts_of(batch, "__media")
            found = iter(decode_many([x for x in blobs if x]))
            columns: list[list] = [[], [], [], [], []]
            for data in blobs:
                row = (None,) * 5
                if data:
                    heights, channels, pixels = next(found)
                    width = len(pixels) // channels // sum(heights)
                    row = (width, heights, channels, pixels.tobytes(), features(width, heights, channels, pixels))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = [*carry, "media", "width", "heights", "channels", "pixels", "feature"]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], batch.column(0), *made], names)

    shape = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in carry)
    rows = media.selectExpr(f"`{media_col}` as __media", *(f"`{c}`" for c in carry))
    return rows.mapInArrow(tidy(run), f"{shape}, media binary, width int, heights array<int>, channels int, pixels binary, feature string")

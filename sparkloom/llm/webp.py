"""Lossless WebP (VP8L) in Python: a decoder of the whole format and an encoder for tests and for byte payloads.

Pixels are uint32 ARGB arrays of shape (height, width). The decoder handles simple and normal prefix codes,
prefix-code groups, back-references with the short-distance map, the colour cache, and the predictor,
cross-colour, subtract-green and colour-indexing transforms. Images of which only the green channel carries
bits, such as palette images, are decoded several symbols at a time with a table over bit windows.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LONGEST_CODE = 15
MAX_SIDE = 1 << 14
MAX_LENGTH = 4096


class WebPError(ValueError):
    """The bytes aren't a lossless WebP image."""


# --- bits and prefix codes -------------------------------------------------------------------------------------------


class BitReader:
    """Bits from the lowest of each byte on. Bits past the end read as 0; check() tells if any were used."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + (n >> 3) + 2], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def check(self) -> None:
        if self.at > 8 * len(self.data):
            raise WebPError("the data end too early")


def _reversed_bits(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as they lie in the stream, number of bits); one symbol alone takes no bits."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (_reversed_bits(code, n), n)
        code += 1
    if not used or code != 1 << last:
        raise WebPError("a prefix code isn't complete")
    return out


class PrefixCode:
    """Decodes one symbol by a table over the next `width` bits."""

    def __init__(self, lengths: tuple[int, ...]):
        codes = canonical(list(lengths))
        self.lengths = lengths
        self.width = max(n for _, n in codes.values())
        self.only = next(iter(codes)) if self.width == 0 else None
        self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.width)
        for s, (bits, n) in codes.items():
            for high in range(1 << (self.width - n)):
                self.table[bits | high << n] = (s, n)

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        s, n = self.table[bits.peek(self.width)]
        bits.at += n
        return s


@lru_cache(maxsize=64)
def _code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


def _read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if bits.read(1):  # simple
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            if s >= alphabet:
                raise WebPError("a symbol outside the alphabet")
            lengths[s] = 1
        return _code(tuple(lengths))
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = _code(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            before, at = n or before, at + 1
            continue
        value, times = (before, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3) if n == 17 else 11 + bits.read(7))
        if at + times > alphabet:
            raise WebPError("too many code lengths")
        lengths[at : at + times] = [value] * times
        at += times
    bits.check()
    return _code(tuple(lengths))


def _extra(prefix: int, bits: BitReader) -> int:
    """The value (from 1) of a length or distance prefix with its extra bits."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


# --- decoding --------------------------------------------------------------------------------------------------------

#: Bits of a window of the table that decodes several symbols at once.
WINDOW = 14


@lru_cache(maxsize=8)
def _window_table(lengths: tuple[int, ...]) -> tuple[list[tuple[bytes | None, int]], int]:
    """For each window of bits: the literals (below 256) whose codes lie wholly in it, and their number of
    bits; None where the first symbol is no literal. Then the most literals of a window."""
    code = _code(lengths)
    mask, table, out = (1 << code.width) - 1, code.table, []
    for v in range(1 << WINDOW):
        found, used = bytearray(), 0
        while True:
            s, n = table[(v >> used) & mask]
            if used + n > WINDOW or s > 255:
                break
            found.append(s)
            used += n
        out.append((bytes(found) or None, used))
    return out, max(1, *(len(s or b"") for s, _ in out))


def _green_only(bits: BitReader, codes: list[PrefixCode], width: int, total: int) -> bytes:
    """The green samples of an image whose other channels are constant and that has no colour cache."""
    green, distance = codes[0], codes[4]
    if green.only is not None and green.only < 256:
        return bytes([green.only]) * total
    (table, most), mask, done, data = _window_table(green.lengths), (1 << WINDOW) - 1, bytearray(), bits.data
    span = 32 * WINDOW // 8 + 2
    while len(done) < total:
        first, steps = bits.at >> 3, min(32, (total - len(done)) // most)  # so many never go past the end
        if first >= len(data):
            break
        acc, used, part, escaped = int.from_bytes(data[first : first + span], "little") >> (bits.at & 7), 0, [], False
        for _ in range(steps):
            s, n = table[acc & mask]
            if s is None:
                escaped = True
                break
            part.append(s)
            acc >>= n
            used += n
        done += b"".join(part)
        bits.at += used
        if escaped or not steps:
            s = green.read(bits)
            if s < 256:  # near the end, or a code longer than the window
                done.append(s)
                continue
            n, d = _extra(s - 256, bits), _distance(_extra(distance.read(bits), bits), width)
            if d > len(done):
                raise WebPError("a reference to before the image")
            n = min(n, total - len(done))
            while n > 0:  # what is copied may overlap with itself
                piece = done[len(done) - d : len(done) - d + n]
                done += piece
                n -= len(piece)
    if len(done) < total:
        raise WebPError("the data end too early")
    return bytes(done)


def _distance(code: int, width: int) -> int:
    if code > len(SHORT_DISTANCES):
        return code - len(SHORT_DISTANCES)
    x, y = SHORT_DISTANCES[code - 1]
    return max(1, x + y * width)


Head = tuple  # colour cache bits, groups by tile, bits of a tile's side, prefix codes


def _read_head(bits: BitReader, width: int, height: int, main: bool) -> Head:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    groups_at, tile_bits, groups = None, 0, 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles = _read_image(bits, -(-width >> tile_bits), -(-height >> tile_bits), False)
        groups_at = ((tiles >> 8) & 0xFFFF).astype(int).tolist()
        groups = max(map(max, groups_at)) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    return cache_bits, groups_at, tile_bits, [[_read_code(bits, n) for n in sizes] for _ in range(groups)]


def _read_image(bits: BitReader, width: int, height: int, main: bool, head: Head | None = None) -> np.ndarray:
    """Entropy-coded pixels, before transforms; main: with prefix-code groups. head: if it's read already."""
    cache_bits, groups_at, tile_bits, codes = head or _read_head(bits, width, height, main)
    total = width * height
    if groups_at is None and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        green = np.frombuffer(_green_only(bits, codes[0], width, total), np.uint8).astype(np.uint32)
        red, blue, alpha = (c.only for c in codes[0][1:4])
        return (green << 8 | np.uint32(alpha << 24 | red << 16 | blue)).reshape(height, width)
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    own = codes[0]
    while len(out) < total:
        i = len(out)
        if groups_at is not None:
            own = codes[groups_at[i // width >> tile_bits][i % width >> tile_bits]]
        s = own[0].read(bits)
        if s < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTHS:
            n, d = _extra(s - 256, bits), _distance(_extra(own[4].read(bits), bits), width)
            if d > i:
                raise WebPError("a reference to before the image")
            for _ in range(min(n, total - i)):
                out.append(out[-d])
        else:
            out.append(cache[s - 256 - LENGTHS])
        if cache_bits:
            for p in out[i:]:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
        if not i & 255:
            bits.check()
    bits.check()
    return np.array(out, np.uint32).reshape(height, width)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _predicted(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    out = 0
    lc, tc, rc, xc = map(_channels, (left, top, top_right, top_left))
    if mode == 11:
        to_left = sum(abs(t - x) for t, x in zip(tc, xc, strict=True))  # |left + top - top_left - left|
        to_top = sum(abs(a - x) for a, x in zip(lc, xc, strict=True))
        return left if to_left < to_top else top
    for a, t, r, x in zip(lc, tc, rc, xc, strict=True):
        if mode == 5:
            v = ((a + r >> 1) + t) >> 1
        elif mode == 6:
            v = a + x >> 1
        elif mode == 7:
            v = a + t >> 1
        elif mode == 8:
            v = x + t >> 1
        elif mode == 9:
            v = t + r >> 1
        elif mode == 10:
            v = ((a + x >> 1) + (t + r >> 1)) >> 1
        elif mode == 12:
            v = min(max(a + t - x, 0), 255)
        else:
            mean = a + t >> 1
            v = min(max(mean + int((mean - x) / 2), 0), 255)
        out = out << 8 | v
    return out


def _added(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _subtracted(a: int, b: int) -> int:
    return sum((x - y & 255) << n for x, y, n in zip(_channels(a), _channels(b), (24, 16, 8, 0), strict=True))


def _predictor(pixels: np.ndarray, modes: np.ndarray, tile_bits: int, forward: bool = False) -> np.ndarray:
    """Invert (or apply) the predictor transform."""
    height, width = pixels.shape
    rows, own = pixels.tolist(), ((modes >> 8) & 15).tolist()
    out: list[list[int]] = []
    for y, row in enumerate(rows):
        full = row if forward else []  # the true pixels of this row so far
        above = (rows if forward else out)[y - 1] if y else []
        new: list[int] = []
        for x, p in enumerate(row):
            if not y:
                guess = full[x - 1] if x else 0xFF000000
            elif not x:
                guess = above[0]
            else:
                guess = _predicted(own[y >> tile_bits][x >> tile_bits], full[x - 1], above[x], above[x + 1] if x + 1 < width else full[0], above[x - 1])
            new.append(_subtracted(p, guess) if forward else _added(p, guess))
            if not forward:
                full.append(new[-1])
        out.append(new)
    return np.array(out, np.uint32).reshape(height, width)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)


def _cross_colour(pixels: np.ndarray, elements: np.ndarray, tile_bits: int, forward: bool = False) -> np.ndarray:
    height, width = pixels.shape
    e = elements[np.arange(height)[:, None] >> tile_bits, np.arange(width)[None, :] >> tile_bits]
    to_red, to_blue, red_to_blue = _signed(e), _signed(e >> 8), _signed(e >> 16)
    green, red, blue = _signed(pixels >> 8), (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    sign = -1 if forward else 1
    new_red = red + sign * (to_red * green >> 5) & 255
    new_blue = blue + sign * (to_blue * green >> 5) + sign * (red_to_blue * _signed(red if forward else new_red) >> 5) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new_red << 16 | new_blue).astype(np.uint32)


def _green_added(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64)
    red, blue = ((pixels >> 16 & 255) + sign * green) & 255, ((pixels & 255) + sign * green) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (red << 16 | blue).astype(np.uint32)


def _running_sum(table: np.ndarray) -> np.ndarray:
    """Colours of a palette from their differences, channel by channel."""
    parts = [(table.ravel() >> n & 255).cumsum() & 255 for n in (24, 16, 8, 0)]
    return (parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]).astype(np.uint32)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _coloured(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = (pixels >> 8 & 255).astype(np.uint8)
    if n := _bundle_bits(len(palette)):
        each = 8 >> n
        index = np.stack([index >> (each * i) & ((1 << each) - 1) for i in range(1 << n)], -1).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def _chunks(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no RIFF WEBP header")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise WebPError("no lossless image")


def _read_all_heads(bits: BitReader, full_width: int, height: int) -> tuple[list, int, Head]:
    """Transforms, the width of the coded image, and its head."""
    width, todo, seen = full_width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = bits.read(3) + 2
            todo.append((kind, _read_image(bits, -(-width >> n), -(-height >> n), False), n))
        elif kind == PALETTE:
            palette = _running_sum(_read_image(bits, bits.read(8) + 1, 1, False))
            todo.append((kind, palette, width))
            width = -(-width >> _bundle_bits(len(palette)))
        else:
            todo.append((kind, None, 0))
    return todo, width, _read_head(bits, width, height, True)


def decode(data: bytes, memo: dict | None = None) -> np.ndarray:
    """The pixels of a lossless WebP file, as uint32 ARGB of shape (height, width).

    memo: keeps what the bits before the pixels mean, for many files that begin alike; at most 16 beginnings
    are kept, and only those that don't depend on the height."""
    body = _chunks(data)
    if body[:1] != b"\x2f":
        raise WebPError("no VP8L signature")
    bits = BitReader(body, 8)
    full_width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    start = bits.at
    for (own, n, value), heads in (memo or {}).items():
        if own == full_width and bits.peek(n) == value:
            bits.at += n
            break
    else:
        heads = _read_all_heads(bits, full_width, height)
        if memo is not None and len(memo) < 16 and heads[2][1] is None and all(k in (PALETTE, SUBTRACT_GREEN) for k, _, _ in heads[0]):
            n, bits.at = bits.at - start, start
            memo[full_width, n, bits.read(n)] = heads
    todo, width, head = heads
    pixels = _read_image(bits, width, height, True, head)
    for kind, table, n in reversed(todo):
        if kind == PREDICTOR:
            pixels = _predictor(pixels, table, n)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, table, n)
        elif kind == PALETTE:
            pixels = _coloured(pixels, table, n)
        else:
            pixels = _green_added(pixels)
    return pixels


# --- encoding --------------------------------------------------------------------------------------------------------


def limited_lengths(counts: dict[int, float], most: int = LONGEST_CODE) -> dict[int, int]:
    """Lengths of a Huffman code of at most `most` bits: rare symbols are counted as less rare until it fits."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    floor = 0.0
    total = sum(counts.values())
    while True:
        heap = [(max(c, floor), s, (s,)) for s, c in sorted(counts.items())]
        heapq.heapify(heap)
        lengths = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            (a, s, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for z in (*x, *y):
                lengths[z] += 1
            heapq.heappush(heap, (a + b, s, x + y))
        if max(lengths.values()) <= most:
            return lengths
        floor = max(2 * floor, total / 2 ** (most + 4))


def _string(value: int, n: int) -> str:
    return format(value, f"0{n}b") if n else ""


class _Writer:
    """Collects bit strings, each as a number's binary digits; later ones are higher bits."""

    def __init__(self):
        self.parts: list[str] = []

    def write(self, value: int, n: int) -> None:
        self.parts.append(_string(value, n))

    def bytes(self) -> bytes:
        digits = "".join(reversed(self.parts))
        return int(digits or "0", 2).to_bytes(-(-len(digits) // 8), "little")


def _write_code(out: _Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        out.write(1, 1), out.write(len(used) == 2, 1), out.write(1, 1)
        for s in used or [0]:
            out.write(s, 8)
        return
    out.write(0, 1)
    ops, i = [], 0  # (symbol, extra, extra bits)
    while i < len(lengths):
        n = next((j for j in range(i, len(lengths)) if lengths[j]), len(lengths)) - i  # zeros from here
        if n >= 11:
            n = min(n, 138)
            ops.append((18, n - 11, 7))
        elif n >= 3:
            ops.append((17, n - 3, 3))
        else:
            n = 1
            ops.append((lengths[i], 0, 0))
            while lengths[i] and lengths[i + n : i + n + 3] == [lengths[i]] * 3:
                more = 3 + next((j for j in range(3) if lengths[i + n + 3 + j : i + n + 4 + j] != [lengths[i]]), 3)
                ops.append((16, more - 3, 2))
                n += more
        i += n
    counts: dict[int, float] = {}
    for s, _, _ in ops:
        counts[s] = counts.get(s, 0) + 1
    own = limited_lengths(counts, 7)
    most = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if s in own) + 1
    out.write(max(most, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(most, 4)]:
        out.write(own.get(s, 0), 3)
    out.write(0, 1)
    codes = canonical([own.get(s, 0) for s in range(19)])
    for s, extra, n in ops:
        out.write(*codes[s])
        out.write(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """The prefix, extra bits and their number of a length or distance (from 1)."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


Token = tuple  # ("p", argb) | ("c", cache index) | ("r", length, distance code)


def _tokens(flat: list[int], width: int, cache_bits: int, references: bool) -> list[Token]:
    """Greedy: a back-reference to the last place with the same three pixels, else the cache, else a literal."""
    out: list[Token] = []
    cache: dict[int, int] = {}
    last: dict[tuple, int] = {}
    short = {max(1, x + y * width): i + 1 for i, (x, y) in reversed([*enumerate(SHORT_DISTANCES)])}
    i = 0
    while i < len(flat):
        n, start = 0, last.get(tuple(flat[i : i + 3]), -1) if references else -1
        if start >= 0:
            while i + n < len(flat) and n < MAX_LENGTH and flat[start + n] == flat[i + n]:
                n += 1
        if n >= 3:
            out.append(("r", n, short.get(i - start, i - start + len(SHORT_DISTANCES))))
        else:
            n = 1
            key = (flat[i] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
            out.append(("c", key) if cache_bits and cache.get(key) == flat[i] else ("p", flat[i]))
        for j in range(i, i + n):
            last[tuple(flat[j : j + 3])] = j
            if cache_bits:
                cache[(flat[j] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[j]
        i += n
    return out


def _write_image(out: _Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, groups: np.ndarray | None = None, tile_bits: int = 2) -> None:
    height, width = pixels.shape
    out.write(cache_bits > 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(groups is not None, 1)
        if groups is not None:
            out.write(tile_bits - 2, 3)
            _write_image(out, groups.astype(np.uint32) << 8, False)
    tokens = _tokens(pixels.ravel().tolist(), width, cache_bits, references)
    many = 1 if groups is None else int(groups.max()) + 1
    counts: list[list[dict[int, float]]] = [[{} for _ in range(5)] for _ in range(many)]
    coded, at = [], 0
    for t in tokens:
        g = 0 if groups is None else int(groups[at // width >> tile_bits, at % width >> tile_bits])
        if t[0] == "p":
            a, r, gr, b = _channels(t[1])
            symbols = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif t[0] == "c":
            symbols = [(0, 256 + LENGTHS + t[1], 0, 0)]
        else:
            (p, e, n), (q, f, m) = _prefix(t[1]), _prefix(t[2])
            symbols = [(0, 256 + p, e, n), (4, q, f, m)]
        at += t[1] if t[0] == "r" else 1
        for k, s, _, _ in symbols:
            counts[g][k][s] = counts[g][k].get(s, 0) + 1
        coded.append((g, symbols))
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = []
    for own in counts:
        codes.append([])
        for c, size in zip(own, sizes, strict=True):
            lengths = limited_lengths(c or {0: 1})
            full = [lengths.get(s, 0) for s in range(size)]
            _write_code(out, full)
            codes[-1].append(canonical(full))
    for g, symbols in coded:
        for k, s, extra, n in symbols:
            out.write(*codes[g][k][s])
            out.write(extra, n)


def _file(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _header(out: _Writer, width: int, height: int, alpha: bool) -> None:
    out.write(0x2F, 8), out.write(width - 1, 14), out.write(height - 1, 14), out.write(alpha, 1), out.write(0, 3)


def _differences(palette: np.ndarray) -> np.ndarray:
    flat = palette.tolist()
    return np.array([[_subtracted(b, a) for a, b in zip([0, *flat], flat, strict=False)]], np.uint32)


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = True, groups: np.ndarray | None = None, tile_bits: int = 2) -> bytes:
    """A lossless WebP file of uint32 ARGB pixels.

    transforms, in the order in which they are applied: ("predictor", modes), ("cross", elements), each with an
    array of ARGB values for tiles of 2**tile_bits pixels; "green"; "palette". groups: a prefix-code group for
    each tile of the image as it is coded.
    """
    height, width = pixels.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise ValueError("a side must be 1 to 16384 pixels")
    out = _Writer()
    _header(out, width, height, bool((pixels >> 24 != 255).any()))
    for t in transforms:
        out.write(1, 1)
        if t == "green":
            out.write(SUBTRACT_GREEN, 2)
            pixels = _green_added(pixels, -1)
        elif t == "palette":
            out.write(PALETTE, 2)
            palette, index = np.unique(pixels, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            out.write(len(palette) - 1, 8)
            _write_image(out, _differences(palette), False)
            index = index.reshape(height, width).astype(np.uint32)
            if n := _bundle_bits(len(palette)):
                wide = np.zeros((height, -(-width >> n) << n), np.uint32)
                wide[:, :width] = index
                index = sum(wide[:, i :: 1 << n] << (i * (8 >> n)) for i in range(1 << n))
            pixels = np.uint32(0xFF000000) | index << 8
        else:
            kind, table = t
            out.write(PREDICTOR if kind == "predictor" else CROSS_COLOUR, 2)
            out.write(tile_bits - 2, 3)
            _write_image(out, table.astype(np.uint32), False)
            pixels = (_predictor if kind == "predictor" else _cross_colour)(pixels, table.astype(np.uint32), tile_bits, True)
    out.write(0, 1)
    _write_image(out, pixels.astype(np.uint32), True, cache_bits, references, groups, tile_bits)
    return _file(out.bytes())

"""Media columns: byte payloads stored as lossless WebP images, read back as pixel arrays, with features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import webp
from sparkloom.llm.common import Columns, arrow_map, as_bytes, tune, written

#: A payload is padded to whole rows of so many samples, one byte a pixel.
ROW = 192
#: Samples of one image; a longer payload is stored as several images, one after another.
TILE = ROW * webp.MAX_SIDE
#: A line of at least so many bytes that has been there before is stored as a back-reference.
REPEATED = 24
#: Code lengths of literals stay within the decoder's window of bits.
LONGEST = 12
_LETTERS = b"etaonirshdlucmpfgwybvkjxqz"  # fixed value: letters of European languages, most frequent first


def _expected(kind: str) -> np.ndarray:
    """Relative frequencies of the 256 bytes: a rule, not a fit, so that equal texts are always stored alike."""
    if kind == "flat":
        return np.ones(256)
    f = np.full(256, 0.01)
    f[128:192], f[0xC3] = 0.1, 1.5
    for i, c in enumerate(_LETTERS):
        f[c] += 100 / (i + 4)
        f[c - 32] += (60 if kind == "upper" else 3) / (i + 4)
    f[32], f[10], f[46], f[44] = 45, 1.5, 2.5, 1
    f[48:58] += 0.3
    if kind == "upper":
        f[list(b"!#$%&*|")] += 5
    return f


@lru_cache(maxsize=8)
def _style(kind: str) -> tuple:
    """How a kind of payload is stored: its palette (the bytes by value), code lengths, prefix codes, and the
    digits of all bits between the image's size and its pixels."""
    f = _expected(kind)
    if kind == "flat":
        palette = np.arange(256)
    else:
        palette = np.array([9, 10, 13, *range(32, 127), *range(128, 198)])
    counts = {i: float(f[v]) for i, v in enumerate(palette)}
    counts |= {256 + p: float(f.sum()) / 20_000 for p in range(webp.LENGTHS)}
    lengths = webp.limited_lengths(counts, LONGEST)
    green = [lengths.get(s, 0) for s in range(256 + webp.LENGTHS)]
    distance = [5] * 24 + [6] * (webp.DISTANCES - 24)
    out = webp._Writer()
    out.write(1, 1), out.write(webp.PALETTE, 2), out.write(len(palette) - 1, 8)
    webp._write_image(out, webp._differences(0xFF000000 | palette.astype(np.uint32) << 8), False)
    out.write(0, 1), out.write(0, 1), out.write(0, 1)  # no more transforms, no cache, no groups
    constant = [[int(s == c) for s in range(256)] for c in (0, 0, 255)]
    for own in (green, *constant, distance):
        webp._write_code(out, own)
    codes = {s: webp._string(*c) for s, c in webp.canonical(green).items()}
    literals = [""] * 256
    for i, v in enumerate(palette):
        literals[v] = codes[i]
    pairs = [b + a for b in literals for a in literals]  # by the pair as a little-endian number: the first byte is low
    return np.array([len(x) or 999 for x in literals]), literals, pairs, codes, {s: webp._string(*c) for s, c in webp.canonical(distance).items()}, "".join(reversed(out.parts))


def _repeats(payload: bytes) -> list[tuple[int, int, int]]:
    """(from, to, earlier) of whole lines that stood in the payload before."""
    found, seen, at = [], {}, 0
    for line in payload.split(b"\n"):
        end = at + len(line) + 1
        if len(line) >= REPEATED:
            if line in seen and end <= len(payload):
                found.append((at, end - 1, seen[line]))
            seen[line] = at
        at = end
    return found


def _digits(style: tuple, payload: bytes) -> list[str]:
    """The bits of literals, as strings of digits in order of writing."""
    even = len(payload) & ~1
    out = list(map(style[2].__getitem__, np.frombuffer(payload, "<u2", even // 2).tolist()))
    if even < len(payload):
        out.append(style[1][payload[-1]])
    return out


def _reference(style: tuple, n: int, d: int) -> str:
    (p, e, m), (q, f, k) = webp._prefix(n), webp._prefix(d + len(webp.SHORT_DISTANCES))
    return webp._string(f, k) + style[4][q] + webp._string(e, m) + style[3][256 + p]  # the last is written first


def _store_tile(payload: bytes) -> bytes:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    kind = min(("prose", "upper", "flat"), key=lambda k: int(counts @ _style(k)[0]))
    style, parts, at = _style(kind), [], 0
    for start, end, earlier in _repeats(payload):
        parts += _digits(style, payload[at:start])
        at = start
        while at < end:
            n = min(end - at, webp.MAX_LENGTH)
            parts.append(_reference(style, n, start - earlier))
            at += n
    parts += _digits(style, payload[at:])
    parts.reverse()
    parts.append(style[5])
    out = webp._Writer()
    webp._header(out, ROW, len(payload) // ROW, False)
    parts += reversed(out.parts)
    digits = "".join(parts)
    return webp._file(int(digits, 2).to_bytes(-(-len(digits) // 8), "little"))


def store(payload: bytes) -> bytes:
    """The stored form of a payload (a multiple of ROW bytes, not empty): one WebP file for each TILE."""
    return b"".join(_store_tile(payload[i : i + TILE]) for i in range(0, len(payload), TILE))


def padded(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of ROW bytes."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")


def images(media: bytes, memo: dict | None = None) -> Iterator[np.ndarray]:
    """The ARGB pixel arrays of the images that lie one after another in stored media."""
    at = 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at : at + n], memo)
        at += n


def load(media: bytes, memo: dict | None = None) -> np.ndarray:
    """The pixels of stored media, as an ARGB array; all images of a payload have the same width."""
    return np.vstack(list(images(media, memo)))


def samples(pixels: np.ndarray) -> np.ndarray:
    """The 8-bit samples: each pixel's green channel."""
    return (pixels >> np.uint32(8)).astype(np.uint8)


def feature_of(sample: np.ndarray) -> str:
    """Mean, deviation, mean step along rows, and shares of eight equal ranges of values."""
    n = np.bincount(sample.ravel(), minlength=256)
    value, total = np.arange(256), sample.size
    mean = int(n @ value) / total
    deviation = (max(int(n @ value**2) / total - mean**2, 0.0)) ** 0.5
    step = np.abs(np.diff(sample.astype(np.int16), axis=1)).mean() if sample.shape[1] > 1 else 0.0
    return f"mean={mean:.4f};std={deviation:.4f};step={step:.4f};hist=" + ",".join(f"{x / total:.4f}" for x in n.reshape(8, 32).sum(1))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a WebP image of 8-bit samples. A null text counts as empty and is
    stored as one row of spaces. No shuffle; one text at a time is in memory beside its batch."""
    tune(docs.sparkSession)

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            for i in range(0, len(b["t"]), 200):
                part = b["t"][i : i + 200]
                yield {id_col: b["id"][i : i + 200], "n_bytes": list(map(len, part)), "media": [store(padded(t)) for t in part]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), as_bytes(text_col).alias("t")), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode a media column and describe it: the payload's and the stored form's digests and a feature string."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        memo: dict = {}
        for b in batches:
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in b["media"]:
                sample = samples(load(m, memo))
                payload = sample.tobytes()
                for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(sample)), strict=True):
                    out[k].append(v)
            yield {id_col: b[id_col], "n_bytes": b["n_bytes"]} | out

    kind = stored.schema[id_col].dataType.simpleString()
    return arrow_map(stored, run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_pixels(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, image, height, width, pixels): the pixel array of each lossless WebP image of a media column, whatever transforms it has,
    as 32-bit ARGB numbers, little end first, row by row. image counts the images of one value from 0. Null and empty media have
    no rows; what is no WebP is a WebPError; other columns are not read. One image is in memory beside its batch."""
    tune(media.sparkSession)

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        memo: dict = {}
        for b in batches:
            for id_, m in zip(b["id"], b["m"], strict=True):
                for i, pixels in enumerate(images(m, memo)):
                    yield {id_col: [id_], "image": [i], "height": [pixels.shape[0]], "width": [pixels.shape[1]], "pixels": [pixels.astype("<u4").tobytes()]}

    kind = media.schema[id_col].dataType.simpleString()
    own = media.where(media[media_col].isNotNull()).select(media[id_col].alias("id"), media[media_col].alias("m"))
    return arrow_map(own, run, f"`{id_col}` {kind}, image int, height int, width int, pixels binary")


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as media in the shared folder, read the stored bytes back and describe them.

    Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload's last 16 bytes), media_bytes,
    media_sha256, feature; equal texts give equal values. Null and empty texts have a payload of ROW spaces; ids may be
    null or repeated; an empty table gives an empty result; other columns are not read.
    """
    tune(docs.sparkSession)
    return media_features(written(store_media(docs, id_col, text_col), "media"), id_col)

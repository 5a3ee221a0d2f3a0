"""Images: sizes from headers, a PNG codec, Lanczos resizing, and batched encoding.

PNG (8 bits a sample, not interlaced) is read and written here with zlib and numpy.  Other
formats take a codec, an object with ``decode(bytes) -> RGB array`` and ``encode(array, format,
quality) -> bytes``, which is pickled to the workers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Resolutions are drawn in multiples of this.
STEP = 32


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG or JPEG; None for anything else."""
    if not data:
        return None
    if data[:8] == SIGNATURE and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "height")]))
def resolution(content: pd.Series) -> pd.DataFrame:
    """Width and height of image bytes, nulls where they cannot be read."""
    return pd.DataFrame([header_size(x) or (None, None) for x in content], columns=["width", "height"]).astype("Int32")


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """PNG scan lines without their filters; rows: bytes as stored."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.int64)
    for y, kind in enumerate(kinds):
        line = rows[y].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, bpp), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for x in range(len(line)):
                left = line[x - bpp] if x >= bpp else 0
                if kind == 3:
                    line[x] = (line[x] + (left + above[x]) // 2) & 255
                    continue
                corner = above[x - bpp] if x >= bpp else 0
                p = left + above[x] - corner
                near = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))
                line[x] = (line[x] + near[2]) & 255
        elif kind:
            raise ValueError("unknown filter")
        out[y], above = line, line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The RGB array, height x width x 3; transparency is dropped."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    head, packed, palette = None, b"", None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("only 8 bits a sample without interlace")
    w, h, _, colour = head[:4]
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * n)
    pixels = _unfiltered(lines[:, 1:], lines[:, 0], n).reshape(h, w, n)
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, 2) if n < 3 else pixels[..., :3].copy()


def encode_png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb, np.uint8).reshape(h, -1)], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


class PngCodec:
    """The built-in codec."""

    def decode(self, data: bytes) -> np.ndarray:
        return decode_png(data)

    def encode(self, rgb: np.ndarray, format: str = "png", quality: int = 95) -> bytes:
        if format != "png":
            raise ValueError(f"the built-in codec writes png, not {format}")
        return encode_png(rgb)


def _weights(old: int, new: int) -> np.ndarray:
    """new x old weights of a Lanczos kernel of three lobes, widened when shrinking."""
    scale = max(1.0, old / new)
    x = (np.arange(old)[None] + 0.5 - (np.arange(new)[:, None] + 0.5) * old / new) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling."""
    if rgb.shape[:2] == (height, width):
        return rgb
    out = np.einsum("yh,hwc->ywc", _weights(rgb.shape[0], height), rgb.astype(float))
    out = np.einsum("xw,ywc->yxc", _weights(rgb.shape[1], width), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def fit_square(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized to a square of the longer side, of which the centre is cut."""
    side = max(width, height)
    left, top = (side - width) // 2, (side - height) // 2
    return resize(rgb, side, side)[top : top + height, left : left + width]


def drawn_size(key: Column, least: tuple[int, int], most: tuple[int, int], seed: int = 0) -> Column:
    """struct(width, height): multiples of STEP within the range, drawn by a keyed hash, so the same on every run."""
    one = lambda axis: ((F.pmod(F.xxhash64(key, F.lit(seed), F.lit(axis)), F.lit(most[axis] // STEP - least[axis] // STEP + 1)) + least[axis] // STEP) * STEP).cast("int")
    return F.struct(one(0).alias("width"), one(1).alias("height"))


def encoded(images: DataFrame, size: tuple[int, int] | None = None, format: str = "png", quality: int = 95, codec=None) -> DataFrame:
    """Adds ``image`` (encoded bytes, null on failure), ``width`` and ``height`` to rows with ``content``.

    With ``size`` every image gets it; with columns want_width and want_height each gets its own
    by ``fit_square``; else it keeps its size.  Each task handles its rows one by one.
    """
    own = codec or PngCodec()
    each = {"want_width", "want_height"} <= set(images.columns)

    @F.pandas_udf("image binary, width int, height int")
    def run(content: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for data, width, height in zip(content, w, h, strict=True):
            try:
                rgb = own.decode(data)
                if each:
                    rgb = fit_square(rgb, int(width), int(height))
                elif size:
                    rgb = resize(rgb, *size)
                out.append((own.encode(rgb, format, quality), rgb.shape[1], rgb.shape[0]))
            except Exception:  # a broken image is a null, whatever the codec raises
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["image", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    want = ("want_width", "want_height") if each else (F.lit(0), F.lit(0))
    return images.withColumn("_x", run("content", *want)).select(*images.columns, "_x.*")

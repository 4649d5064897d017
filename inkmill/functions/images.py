"""PNG images as bytes: enough of the format to see whether anything is drawn, to trim a margin and to lay an image on white."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import _c

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class ImageError(ValueError):
    pass


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of rows x columns x channels (1 to 4) of bytes."""
    height, width, channels = pixels.shape
    kind = {n: k for k, n in CHANNELS.items()}[channels]
    raw = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns x channels of a PNG with 8 bits a channel that is neither interlaced nor indexed; others raise ImageError."""
    if not data or data[:8] != SIGNATURE:
        raise ImageError("no PNG")
    at, head, packed = 8, None, []
    try:
        while at < len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif name == b"IDAT":
                packed.append(body)
            at += 12 + size
        width, height, depth, kind, _, _, interlaced = head
        if depth != 8 or kind not in CHANNELS or interlaced:
            raise ImageError("only 8 bits a channel, not interlaced")
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * CHANNELS[kind])
    except (struct.error, TypeError, zlib.error, ValueError) as e:
        raise e if isinstance(e, ImageError) else ImageError(str(e)) from e
    return _unfiltered(raw[:, 0], raw[:, 1:], CHANNELS[kind]).reshape(height, width, CHANNELS[kind])


def _unfiltered(filters: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(rows.shape, np.uint8)
    above = np.zeros(rows.shape[1], np.int64)
    for y, (kind, line) in enumerate(zip(filters.tolist(), rows)):
        now = line.astype(np.int64)
        if kind == 1:
            now = np.cumsum(now.reshape(-1, step), axis=0).ravel() & 255
        elif kind == 2:
            now = (now + above) & 255
        elif kind in (3, 4):
            for x in range(len(now)):
                left, corner = (now[x - step], above[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    reach = left + above[x] - corner
                    guess = min((abs(reach - left), 0, left), (abs(reach - above[x]), 1, above[x]), (abs(reach - corner), 2, corner))[2]
                now[x] = (now[x] + guess) & 255
        elif kind:
            raise ImageError(f"unknown filter: {kind}")
        out[y] = now
        above = now
    return out


def on_white(pixels: np.ndarray) -> np.ndarray:
    """Rows x columns x 3: grey as three equal channels, and what is transparent laid on white."""
    channels = pixels.shape[2]
    colour = pixels[:, :, : channels - 1 if channels in (2, 4) else channels]
    colour = np.repeat(colour, 3, axis=2) if colour.shape[2] == 1 else colour
    if channels not in (2, 4):
        return colour
    alpha = pixels[:, :, -1:].astype(np.float64) / 255
    return np.round(colour * alpha + 255 * (1 - alpha)).astype(np.uint8)


def box_of(pixels: np.ndarray) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom) of what differs from the colour of the first pixel; None if nothing does."""
    seen = (pixels != pixels[0, 0]).any(axis=2)
    if not seen.any():
        return None
    rows, columns = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    return int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1


def _each(kind: pa.DataType, name: str, of):
    @F.arrow_udf(name)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for data in column.to_pylist():
            try:
                out.append(None if data is None else of(on_white(decode_png(data))))
            except ImageError:
                out.append(None)
        return pa.array(out, kind)

    return run


def is_single_colour(png: Column | str) -> Column:
    """F-25: whether an image has one colour only; null for nulls and for what cannot be read."""
    return _each(pa.bool_(), "boolean", lambda p: box_of(p) is None)(_c(png))


def content_box(png: Column | str) -> Column:
    """M-09: array(left, top, right, bottom) of an image without its margin; null if nothing is left, or for what cannot be read."""
    return _each(pa.list_(pa.int32()), "array<int>", lambda p: None if (b := box_of(p)) is None else list(b))(_c(png))


def trimmed(png: Column | str) -> Column:
    """M-09: the image on white and without its margin, as PNG; an image of one colour stays whole; null for what cannot be read."""

    def cut(p: np.ndarray) -> bytes:
        left, top, right, bottom = box_of(p) or (0, 0, p.shape[1], p.shape[0])
        return encode_png(p[top:bottom, left:right])

    return _each(pa.binary(), "binary", cut)(_c(png))

"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area, kept as NPY tiles.

decode() reads P1 to P6 and uncompressed BMP of 1, 4, 8, 24 and 32 bits. Resizing averages each
target cell's area exactly, from an integral image: the sum over any rectangle, fractional edges
included, is four readings of the summed table, interpolated. A difference hash compares
neighbours of a 9 x 8 resized image, one bit for each of 64 pairs.

media_of_texts() stores any text as an 8-bit image without loss: its UTF-8 bytes, then bytes 0 up
to a positive multiple of 64, are the samples of a PGM that is 64 wide.

Defined results: null and empty texts are one row of 64 zero samples; repeated rows get equal
results; bytes that are no image get a null array and the reason; an empty table gives an empty
result; other columns are never read. Memory follows the largest image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import docs_of, map_rows

WIDTH = 64
#: Side of the square tile kept of each image.
TILE = 32


class NotAnImage(ValueError):
    """The bytes are of no form that decode() reads."""


def netpbm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    """n decimal numbers from place 2 on, comments left out, and the place after the one white space that ends them."""
    at, found = 2, []
    while len(found) < n:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            if end < 0:
                raise NotAnImage("comment has no end")
            at = end + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise NotAnImage("header lacks a number")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """Rows x columns, with a third axis of 3 for colour; uint8 or, above 255 levels, uint16. Bitmaps give 0 and 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise NotAnImage("no Netpbm mark")
    bitmap = kind in b"14"
    fields, at = netpbm_fields(data, 2 if bitmap else 3)
    width, height = fields[:2]
    levels = 1 if bitmap else fields[2]
    if not 0 < levels < 65536:
        raise NotAnImage("number of levels is out of range")
    shape = (height, width, 3) if kind in b"36" else (height, width)
    n = int(np.prod(shape))
    if kind == b"1":
        digits = np.frombuffer(data[at - 1 :], dtype=np.uint8)
        values = digits[(digits == 48) | (digits == 49)] - 48
    elif kind in b"23":
        values = np.array(data[at - 1 :].split(), dtype=np.int64)
    elif kind == b"4":
        row = (width + 7) // 8
        if len(data) - at < row * height:
            raise NotAnImage("samples are missing")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        values = bits[:, :width].ravel()
    else:
        sample = np.dtype(">u2" if levels > 255 else np.uint8)
        if len(data) - at < n * sample.itemsize:
            raise NotAnImage("samples are missing")
        values = np.frombuffer(data, sample, n, at)
    if len(values) < n:
        raise NotAnImage("samples are missing")
    values = values[:n].reshape(shape)
    if bitmap:
        return ((1 - values) * 255).astype(np.uint8)
    return values.astype(np.uint16 if levels > 255 else np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise NotAnImage("no BMP mark")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, depth, packing, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", data, 14)
    if head < 40 or packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise NotAnImage("this kind of BMP isn't read")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(data) - start < rows * stride:
        raise NotAnImage("samples are missing")
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if depth >= 24:
        return raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1].copy()
    if depth == 8:
        index = raw[:, :width]
    else:
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
        index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :width]
    n = colours or 1 << depth
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)
    if index.size and int(index.max()) >= n:
        raise NotAnImage("a colour isn't in the palette")
    colour = palette[index][:, :, 2::-1]
    grey = (palette[:, 0] == palette[:, 1]) & (palette[:, 1] == palette[:, 2])
    return colour[:, :, 0].copy() if grey.all() else colour.copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey, bottom row first."""
    rows, width = image.shape
    stride = (width + 3) // 4 * 4
    padded = np.zeros((rows, stride), np.uint8)
    padded[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    size = start + padded.size
    head = struct.pack("<2sIHHI", b"BM", size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, rows, 1, 8, 0, padded.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + padded.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """One channel, by the integer luma weights 299, 587, 114."""
    if image.ndim == 2:
        return image
    return (image[:, :, :3].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def resize_area(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over each target cell's area, from the integral image; float64."""
    if not image.size:
        return np.zeros((rows, columns))
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])

    def at_edges(table: np.ndarray, n: int) -> np.ndarray:
        size = table.shape[0] - 1
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(int), size - 1)
        part = (edge - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corner = at_edges(at_edges(table, rows).T, columns).T
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums * (rows * columns / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: is each of 8 x 8 cells less than its right neighbour."""
    small = np.round(resize_area(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


def tile_of(image: np.ndarray, side: int = TILE) -> bytes:
    """The NPY bytes of the image resized to a square of 8-bit samples."""
    return npy(np.clip(np.floor(resize_area(image, side, side) + 0.5), 0, 255).astype(np.uint8))


def features(df: DataFrame, media: str | Column = "media", key: str = "doc_id", side: int = TILE) -> DataFrame:
    """key, shape, tile (NPY), dhash and error of a column of Netpbm or BMP bytes."""
    def start():
        def one(data):
            try:
                image = decode(data or b"")
            except (NotAnImage, ValueError, struct.error) as e:
                return None, None, None, str(e)
            plain = grey(image)
            return list(image.shape), tile_of(plain, side), difference_hash(plain), None

        return lambda keys, blobs: (keys, *zip(*map(one, blobs), strict=True))

    media = F.col(media) if isinstance(media, str) else media
    return map_rows(
        df.select(F.col(key).cast("bigint").alias("doc_id"), media.cast("binary").alias("media")),
        start,
        "doc_id bigint, shape array<int>, tile binary, dhash string, error string",
    )


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def store_text(data: bytes) -> bytes:
    """The PGM that holds the bytes and their padding."""
    return encode_pgm(np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH))


def media_of_texts(df: DataFrame, key: str = "doc_id", text: str = "text", side: int = TILE) -> DataFrame:
    """doc_id, n_bytes, media (the PGM), and what its samples give when read back: payload, tile (NPY) and dhash."""

    def start():
        def one(data):
            data = data or b""
            media = store_text(data)
            image = decode(media)
            return len(data), media, image.tobytes(), tile_of(image, side), difference_hash(image)

        return lambda keys, texts: (keys, *zip(*map(one, texts), strict=True))

    return map_rows(
        docs_of(df, key, text), start, "doc_id bigint, n_bytes bigint, media binary, payload binary, tile binary, dhash string"
    )


def crc32_tail(payload: bytes) -> int:
    return zlib.crc32(payload[-64:])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

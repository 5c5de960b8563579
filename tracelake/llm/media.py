"""Media columns (operator 4): Netpbm and BMP images as rows, decoded to arrays, resized, written as NPY tiles."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

_number = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
#: Rows and columns of a tile; a difference hash compares neighbours in a row, so it has 64 bits.
TILE = (8, 9)


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """(height x width x channels, white) of a P1 to P6 image; uint8, or uint16 where white (the header's largest sample) is over 255."""
    if not (m := re.match(rb"P[1-6]", data)):
        raise ValueError("not a Netpbm image")
    kind, at, numbers = m[0][1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        if not (m := _number.match(data, at)):
            raise ValueError("bad Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = numbers[0], numbers[1], (numbers + [1])[2]
    if not (width and height and 0 < top < 1 << 16):
        raise ValueError("empty Netpbm image or bad largest sample")
    channels, dtype = 3 if kind in b"36" else 1, np.uint8 if top < 256 else np.uint16
    if kind == b"1":
        bits = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*\n?", b"", data[at:])), np.uint8) - 48
        return (1 - bits[: width * height]).astype(np.uint8).reshape(height, width, 1), 1
    if kind in b"23":
        values = np.array(re.sub(rb"#[^\n]*\n?", b"", data[at:]).split(), np.int64)[: width * height * channels]
        if len(values) and not 0 <= values.min() <= values.max() <= top:
            raise ValueError("sample out of range")
        return values.astype(dtype).reshape(height, width, channels), top
    at += 1  # one white space ends the header
    if kind == b"4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width])[:, :, None], 1
    samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", width * height * channels, at)
    return samples.astype(dtype).reshape(height, width, channels), top


def decode_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """(height x width x 3, 255) of an uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits in RGB order; 16 and 32 bits may have masks."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    number = lambda at, n, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, width, height, depth, coding = number(10, 4), number(14, 4), number(18, 4, True), number(22, 4, True), number(28, 2), number(30, 4)
    if coding not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or (coding == 3 and depth not in (16, 32)):
        raise ValueError("compressed or unknown BMP")
    if width <= 0 or height == 0:
        raise ValueError("empty BMP image")
    stride = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if depth == 24:
        return rows[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1], 255
    if depth in (16, 32):
        # The masks of red, green and blue where the file names none.
        masks = [number(54 + 4 * k, 4) for k in range(3)] if coding == 3 else [0x7C00, 0x3E0, 0x1F] if depth == 16 else [0xFF0000, 0xFF00, 0xFF]
        pixels = np.ascontiguousarray(rows).view("<u2" if depth == 16 else "<u4")[:, :width].astype(np.int64)
        tops = [m // (m & -m) if m else 1 for m in masks]
        bands = [(pixels & m) // (m & -m or 1) * 255 / t for m, t in zip(masks, tops, strict=True)]
        return np.rint(np.stack(bands, axis=2)).astype(np.uint8), 255
    colours = number(46, 4) or 1 << depth
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, [2, 1, 0]]
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    index = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :width]
    if index.max() >= len(palette):
        raise ValueError("colour out of the palette")
    return palette[index], 255


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples, the sample of white) of an image."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_ppm(payload: bytes, width: int = 64) -> bytes:
    """A binary Netpbm image whose samples are the payload; its size is a multiple of 3 * width."""
    return b"P6\n%d %d\n255\n" % (width, len(payload) // (3 * width)) + payload


def area_resize(grey: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the area that each cell covers, with shares of the pixels on its edges, from an integral image."""

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(cells + 1) * n
        return at // cells, (at % cells) / cells

    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(grey, axis=0, out=table[1:, 1:], dtype=np.float64)
    np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
    (y, fy), (x, fx) = edges(grey.shape[0], rows), edges(grey.shape[1], cols)
    down = table[y] + fy[:, None] * (table[np.minimum(y + 1, grey.shape[0])] - table[y])
    both = down[:, x] + fx * (down[:, np.minimum(x + 1, grey.shape[1])] - down[:, x])
    cell = grey.shape[0] / rows * grey.shape[1] / cols
    return np.diff(np.diff(both, axis=0), axis=1) / cell


def tile_of(image: np.ndarray, white: int = 255) -> np.ndarray:
    """The 8 by 9 grey tile of an image (all channels count alike), scaled so that white is 255 and rounded to uint8."""
    return np.rint(np.minimum(area_resize(image.sum(2, dtype=np.int64), *TILE) * (255 / white / image.shape[2]), 255)).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """Hex digits of 64 bits: whether each cell is darker than its right neighbour."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tile)
    return out.getvalue()


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded by spaces to a positive multiple of 192, as a P6 image."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        media = [encode_ppm(x.ljust(max(192, -(-len(x) // 192) * 192), b" ")) for x in texts]
        return pa.record_batch([batch.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, encode, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def media_tiles(media: DataFrame) -> DataFrame:
    """For each row (id, n_bytes, media): digests of the stored form and of its decoded samples, an NPY tile and its
    difference hash. Images are decoded a batch at a time; a media value that is null or no such image fails the row:
    its `error` says why, and its other columns are null. Repeated rows give a row each; other columns are ignored."""
    kept = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("npy", pa.binary()), ("error", pa.string())]

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for n, data in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                image, white = decode(data or b"")
                samples = image.tobytes()
                tile = tile_of(image, white)
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tile), npy(tile), None))
            except (ValueError, OverflowError, MemoryError) as e:
                rows.append((n, None, None, None, None, None, None, None, str(e) or type(e).__name__))
        columns = list(zip(*rows, strict=True)) or [[] for _ in kept]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, (_, t) in zip(columns, kept, strict=True))], ["id", *(n for n, _ in kept)])

    names = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, npy binary, error string"
    return map_arrow(media.select("id", F.col("n_bytes").cast("long"), "media"), features, f"id {media.schema['id'].dataType.simpleString()}, {names}")


def store_and_tile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as images in the shared folder, read back, and their tiles written there: the tile table."""
    stored = written(text_images(docs, id_col, text_col), "media")
    return written(media_tiles(stored), "tiles")

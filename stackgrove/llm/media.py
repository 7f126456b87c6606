"""Media columns (operator 5): Netpbm and BMP to numpy, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import rowwise, texts_of

#: Samples in a row of a text's image, and so what payloads are padded to.
ROW = 64
#: Rows and columns of a tile, and of the grid whose neighbours the hash compares.
TILE, HASH_ROWS, HASH_COLUMNS = (16, 16), 8, 9


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The first `fields` numbers after the magic, and where the samples begin; '#' starts a comment."""
    at, found = 2, []
    while len(found) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        stop = at
        while data[stop : stop + 1].isdigit():
            stop += 1
        if stop == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[at:stop]))
        at = stop
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (rows, columns) or (rows, columns, 3); bitmaps as 0 (black) and 1."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, colours = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (width, height, *most), at = _header(data, 2 if bitmap else 3)
    n, top = width * height * colours, most[0] if most else 1
    if not 0 < top < 1 << 16 or n > 8 * len(data):
        raise ValueError("a Netpbm header that its bytes don't bear out")
    if kind == b"P4":
        stride = -(-width // 8)
        rows = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        return 1 - rows[:, :width]
    if kind == b"P1":
        digits = [c - 48 for c in data[at:] if c in b"01"]
        return 1 - np.array(digits[:n], np.uint8).reshape(height, width)
    if kind in (b"P2", b"P3"):
        samples = [int(x) for x in data[at:].split()[:n]]
        if samples and not 0 <= min(samples) <= max(samples) <= top:
            raise ValueError("a Netpbm sample out of range")
        flat = np.array(samples, np.uint16 if top > 255 else np.uint8)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    return flat.reshape((height, width, 3) if colours == 3 else (height, width))


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as binary Netpbm."""
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + image.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (rows, columns, 3) in red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    at, size, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("BMP kind not supported")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if width <= 0 or rows * stride > len(data):
        raise ValueError("a BMP header that its bytes don't bear out")
    raw = np.frombuffer(data, np.uint8, stride * rows, at).reshape(rows, stride)
    raw = raw if height < 0 else raw[::-1]
    if bits == 8:
        colours = struct.unpack_from("<46xI", data)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)
        return palette[raw[:, :width]][:, :, 2::-1]
    return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def encode_bmp(image: np.ndarray) -> bytes:
    """A (rows, columns, 3) image as 24-bit BMP, bottom row first."""
    height, width, _ = image.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the exact area that each target cell covers, from a table of sums; grows or shrinks."""
    for axis, count in ((0, rows), (1, columns)):
        n = image.shape[axis]
        sums = np.concatenate([np.zeros_like(image.take([0], axis), np.float64), np.cumsum(image, axis, np.float64)], axis)
        edges = np.arange(count + 1) * (n / count)
        low = np.minimum(edges.astype(int), n - 1)
        shape = [-1 if a == axis else 1 for a in range(image.ndim)]
        at = sums.take(low, axis) + (edges - low).reshape(shape) * (sums.take(low + 1, axis) - sums.take(low, axis))
        image = np.diff(at, axis=axis) / (n / count)
    return image


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: 64 comparisons of a cell of an 8 by 9 grid with its right neighbour."""
    cells = np.round(area_resize(grey(image), HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, rows: int = TILE[0], columns: int = TILE[1]) -> bytes:
    """The image resized to one tile, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(grey(image), rows, columns)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, rows, columns, feature (difference hash) and tile (NPY bytes) of a column of images.

    Null, unreadable, cut or empty images, and those whose header or samples are out of range, keep their
    row with nulls in all columns but the id. Other columns are not read. No rows: no rows.
    """

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                try:
                    image = decode_image(row["media"] or b"")
                    out.append((row["doc_id"], *image.shape[:2], difference_hash(image), npy_tile(image)))
                except (ValueError, IndexError, OverflowError, struct.error):
                    out.append((row["doc_id"], None, None, None, None))
            return out

        return work

    return rowwise(df.selectExpr(f"`{id_col}` as doc_id", f"`{media_col}` as media"), "doc_id long, rows int, columns int, feature string, tile binary", step)


def text_image(text: str) -> tuple[bytes, int]:
    """The text's UTF-8 with zero bytes up to a positive multiple of ROW, as a grey image; and its unpadded size."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(ROW, -(-len(raw) // ROW) * ROW)
    return encode_pgm(np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)), len(raw)


def text_media(docs: DataFrame) -> DataFrame:
    """Each document's text stored as an image, read back, and described.

    A null or empty text is one row of zero samples. Equal texts have equal values in every column
    but doc_id; rows that share a doc_id each have a row. Other columns are not read.
    """

    def step():
        def work(rows: list[dict]) -> list[tuple]:
            out = []
            for row in rows:
                media, n = text_image(row["text"])
                image = decode_netpbm(media)
                payload, tile = image.tobytes(), npy_tile(image)
                out.append((row["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(tile).hexdigest()))
            return out

        return work

    return rowwise(texts_of(docs), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string", step)

"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles and difference hashes.

Every step is per row and in one pass without a shuffle; memory is bounded by the rows of an Arrow slice.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import lean

SIDE = 24
BLOCK = SIDE * SIDE


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) uint8 array as binary Netpbm (P5 or P6)."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A grey (h, w) uint8 array as an 8-bit BMP with a grey palette, or a colour (h, w, 3) array as a 24-bit one."""
    height, width = pixels.shape[:2]
    colour = pixels.ndim == 3
    rows = (pixels[:, :, ::-1].reshape(height, width * 3) if colour else pixels)[::-1]
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).astype(np.uint8).tobytes()
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    if not colour:
        palette[:, 3] = 0
        palette = palette.tobytes()
    offset = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", offset + len(body), 0, 0, offset)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24 if colour else 8, 0, len(body), 2835, 2835, 0 if colour else 256, 0) + palette + body


def decode(data: bytes) -> np.ndarray:
    """The uint8 array of a binary Netpbm (P5, P6 at 255) or an uncompressed 8- or 24-bit BMP image."""
    if data[:2] == b"BM":
        offset, header = struct.unpack_from("<II", data, 10)
        width, height = struct.unpack_from("<ii", data, 18)
        depth, packing = struct.unpack_from("<HI", data, 28)
        if depth not in (8, 24) or packing:
            raise ValueError("only uncompressed 8- and 24-bit BMP")
        used = width * depth // 8
        stride = -(-used // 4) * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, :used]
        rows = rows[::-1] if height > 0 else rows
        if depth == 24:
            return rows.reshape(abs(height), width, 3)[:, :, ::-1]
        palette = np.frombuffer(data, np.uint8, 1024, 14 + header).reshape(256, 4)
        return palette[:, 0][rows]
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("not a Netpbm or BMP image")
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    if top != 255:
        raise ValueError("only 8-bit samples")
    depth = 3 if data[:2] == b"P6" else 1
    flat = np.frombuffer(data, np.uint8, width * height * depth, at + 1)
    return flat.reshape(height, width, 3) if depth == 3 else flat.reshape(height, width)


BAND = 4096


def _rows_at(pixels: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The integral image's rows at fractional heights ``at`` (ascending): sums of all pixels above, by column up to each place.

    The image is read in bands, so that no more than a band is held as floating point numbers.
    """
    h, w = pixels.shape
    low = np.minimum(at.astype(np.int64), h - 1)
    need = np.unique(np.r_[low, low + 1])
    table = np.zeros((len(need), w))
    above = np.zeros(w)
    for a in range(0, h, BAND):
        sums = np.cumsum(pixels[a : a + BAND], 0, dtype=np.float64) + above
        here = (need > a) & (need <= a + len(sums))
        table[here] = sums[need[here] - a - 1]
        above = sums[-1]
    part = (at - low)[:, None]
    rows = table[np.searchsorted(need, low)] * (1 - part) + table[np.searchsorted(need, low + 1)] * part
    return np.cumsum(np.pad(rows, ((0, 0), (1, 0))), 1)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, with fractional borders, from the integral image. Grey (h, w) in, float64 out."""
    h, w = pixels.shape
    rows = _rows_at(pixels, np.arange(height + 1) * (h / height))
    at = np.arange(width + 1) * (w / width)
    low = np.minimum(at.astype(np.int64), w - 1)
    part = at - low
    cells = rows[:, low] * (1 - part) + rows[:, low + 1] * part
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    return sums / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: each of 8 x 8 cells is set if it is darker than its right neighbour in the 8 x 9 area-resized image."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return int(np.packbits((small[:, :-1] < small[:, 1:]).ravel()).view(">u8")[0])


def npy_tile(pixels: np.ndarray, side: int = 16) -> bytes:
    """The area-resized image, rounded to uint8, in NPY format."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.rint(area_resize(pixels, side, side)), 0, 255), np.uint8))
    return out.getvalue()


def grey(pixels: np.ndarray) -> np.ndarray:
    """A colour image's mean channel; a grey one as it is."""
    return pixels if pixels.ndim == 2 else pixels.mean(2)


def text_image(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 length, image) of a text: rows of 24 samples, padded with 255 to a positive multiple of 576.

    An odd number of 576-byte blocks is stored as Netpbm, an even one as BMP.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    pixels = np.frombuffer(raw.ljust(size, b"\xff"), np.uint8).reshape(-1, SIDE)
    return len(raw), (encode_pgm if size // BLOCK % 2 else encode_bmp)(pixels)


def media_columns(docs: DataFrame, tile_side: int = 16) -> DataFrame:
    """Every whole text as an image, read back: (doc_id, n_bytes, media, payload, dhash, tile).

    Null texts count as empty (one block of padding), equal texts give equal values, repeated rows stay, extra columns
    are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "media", "payload", "dhash", "tile"]
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                out: list[list] = [[], [], [], [], []]
                for text in b["text"].to_pylist():
                    n, media = text_image(text)
                    pixels = decode(media)
                    for to, value in zip(out, (n, media, pixels.tobytes(), f"{difference_hash(pixels):016x}", npy_tile(pixels, tile_side)), strict=True):
                        to.append(value)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, out, kinds)], names)

    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, dhash string, tile binary")


def payload_digests(media: DataFrame) -> DataFrame:
    """The digest columns of ``media_columns``: built-in hashes of the payload read back and of the stored form."""
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", "dhash", F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )


def check_payload(payload: bytes) -> tuple[str, int]:
    """SHA-256 and the CRC-32 of the last 32 bytes, for tests."""
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

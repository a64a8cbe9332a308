"""Media columns: PNG images in binary columns, and perceptual hashes of them.

The encoder writes 8-bit grey, grey-alpha, RGB or RGBA samples: signature, IHDR, zlib IDAT chunks and IEND, each with its CRC.  The
decoder tests signature, order, lengths and CRC of the chunks and the zlib stream's own checksum, and undoes all five scan-line filters with numpy.  The
feature is a 64-bit hash: brightness averaged to 32 x 32, its two-dimensional cosine transform, and the signs of the 8 x 8
lowest frequencies against their median.

Damaged images raise ValueError.  Null text counts as empty; equal texts give equal values; rows are never merged.  Long texts are
stored whole in more rows of pixels; extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, session, text_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
COLOUR = {n: c for c, n in CHANNELS.items()}
#: A payload row: 64 RGB pixels.
WIDTH, SAMPLES = 64, 3
IDAT_BYTES = 1 << 16
GRID, LOW = 32, 8


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Scan lines with their filter bytes: Up where at least half of a row repeats the row above, else None."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 1:] = rows
    if len(rows) > 1:
        up = rows[1:] - rows[:-1]
        use = np.count_nonzero(up == 0, axis=1) * 2 >= rows.shape[1]
        out[1:][use, 0] = 2
        out[1:][use, 1:] = up[use]
    return out


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """A PNG of ``pixels`` (height x width x channels, uint8)."""
    height, width, channels = pixels.shape
    packed = zlib.compress(filtered(np.ascontiguousarray(pixels).reshape(height, width * channels)).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR[channels], 0, 0, 0)
    body = b"".join(chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + chunk(b"IHDR", head) + body + chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; ValueError for a bad signature, length or CRC."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters of scan lines (first byte: filter); ``step`` is the number of bytes of a pixel."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    done = 0
    while done < len(rows):
        kind = kinds[done]
        until = done + 1
        while until < len(rows) and kinds[until] == kind and kind in (0, 1, 2):
            until += 1
        part = rows[done:until]
        above = rows[done - 1] if done else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:  # Sub: running sums along the pixels
            pixels = part.reshape(len(part), -1, step)
            part[:] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:  # Up: running sums down the rows
            part[:] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):  # Average and Paeth need the pixel to the left before the next
            row, up = part[0].reshape(-1, step).astype(np.int64), above.reshape(-1, step).astype(np.int64)
            left = corner = np.zeros(step, np.int64)
            for x in range(len(row)):
                guess = (left + up[x]) // 2 if kind == 3 else _paeth(left, up[x], corner)
                row[x] = (row[x] + guess) & 0xFF
                left, corner = row[x], up[x]
            part[0] = row.reshape(-1)
        done = until
    return rows


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    base = left + up - corner
    by_left, by_up, by_corner = abs(base - left), abs(base - up), abs(base - corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def decode_png(data: bytes) -> np.ndarray:
    """The pixels (height x width x channels); ValueError where anything is wrong."""
    parts = list(chunks(data))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("chunks are out of order")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit images without palette or interlace are read")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != height * (width * step + 1):
        raise ValueError("image data has another length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), step).reshape(height, width, step)


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    """The ``LOW`` lowest rows of the cosine transform of ``GRID`` samples."""
    return np.cos(np.pi / GRID * (np.arange(GRID) + 0.5)[None, :] * np.arange(LOW)[:, None])


def averaged(grey: np.ndarray) -> np.ndarray:
    """``grey`` as means over a ``GRID`` x ``GRID`` raster; short sides repeat their samples."""
    for axis in (0, 1):
        n = grey.shape[axis]
        cut = np.arange(GRID) * n // GRID
        until = np.maximum(np.arange(1, GRID + 1) * n // GRID, cut + 1)
        total = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
        shape = [1, 1]
        shape[axis] = GRID
        grey = (total.take(until, axis) - total.take(cut, axis)) / (until - cut).reshape(shape)
    return grey


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which low frequencies are above their median (the mean itself isn't counted for it)."""
    grid = averaged(pixels.mean(axis=2))
    low = np.round(cosines() @ grid @ cosines().T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload(text: bytes) -> bytes:
    """``text`` with blanks up to a positive multiple of a payload row."""
    row = WIDTH * SAMPLES
    return text.ljust(max(1, -(-len(text) // row)) * row, b" ")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG of 64 pixels width in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(text_bytes(batch.column(1).to_pylist()))
            media = [encode_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH, SAMPLES)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kept = session(docs.sparkSession) and docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Decodes (doc_id, n_bytes, media) and digests what was stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                pixels = decode_png(data)
                own = pixels.tobytes()
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image in the shared folder, reads the stored bytes back and digests them."""
    return features(materialize(encode(docs, id_col, text_col), "media", codec="none"))

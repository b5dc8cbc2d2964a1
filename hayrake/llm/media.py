"""Media columns: Netpbm and BMP images, area resizing by integral images, NPY tiles and difference hashes.

Defined results: null or undecodable content gives null size, tile and hash;
an empty image gives a tile of zeros; images of any height are handled in
strips. Equal bytes give equal values.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrake.session import prepare, work_path

TILE = 32
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_netpbm(samples: np.ndarray) -> bytes:
    """Binary PGM of a height x width, or PPM of a height x width x 3, array of 8-bit samples."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit grey palette for two dimensions, 24-bit for three."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples[::-1] if grey else samples[::-1, :, ::-1]
    rows = rows.astype(np.uint8).reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    table = palette.tobytes() if grey else b""
    at = 54 + len(table)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + table + rows.tobytes()


def decode(content: bytes) -> np.ndarray:
    """Samples of a Netpbm (P1 to P6) or uncompressed 8, 24 or 32-bit BMP file; ValueError for others.

    Samples above the stated maximum count as the maximum.
    """
    try:
        return _decode_bmp(content) if content[:2] == b"BM" else _decode_netpbm(content)
    except (IndexError, OverflowError, TypeError, struct.error) as e:
        raise ValueError(f"undecodable image: {e}") from e


def _decode_netpbm(content: bytes) -> np.ndarray:
    if not re.match(rb"P[1-6]", content):
        raise ValueError("neither Netpbm nor BMP")
    kind, at, head = content[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(content, at)
        if not m:
            raise ValueError("cut header")
        if not m[1].isdigit():
            raise ValueError("a size is no number")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = (*head, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    shape = (h, w, 3) if depth == 3 else (h, w)
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", content[at:])
        values = np.array([c - 48 for c in body if c in b"01"] if kind == 1 else body.split(), dtype=np.int64)
    elif kind == 4:
        rows = np.frombuffer(content, dtype=np.uint8, count=h * -(-w // 8), offset=at + 1).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w]
    else:
        values = np.frombuffer(content, dtype=np.uint8 if most < 256 else ">u2", count=h * w * depth, offset=at + 1)
    values = np.clip(values.reshape(-1)[: h * w * depth].reshape(shape), 0, max(most, 1))
    if kind in (1, 4):
        return ((1 - values) * 255).astype(np.uint8)
    return values.astype(np.uint8) if most == 255 else (values.astype(np.int64) * 255 // max(most, 1)).astype(np.uint8)


def _decode_bmp(content: bytes) -> np.ndarray:
    if len(content) < 54:
        raise ValueError("cut header")
    at, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", content, 10)
    if packed or bits not in (8, 24, 32) or w < 0:
        raise ValueError("this kind of BMP is not supported")
    step = -(-w * bits // 32) * 4
    rows = np.frombuffer(content, dtype=np.uint8, count=step * abs(h), offset=at).reshape(abs(h), step)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        size = struct.unpack_from("<I", content, 14)[0]
        palette = np.frombuffer(content, dtype=np.uint8, count=(at - 14 - size) // 4 * 4, offset=14 + size).reshape(-1, 4)
        colours = palette[rows][:, :, 2::-1]
        return colours[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else colours
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means, as doubles. The integral image is kept only at the rows that bound an area."""
    grey = samples if samples.ndim == 2 else samples.reshape(samples.shape[0], -1)
    h, w = samples.shape[:2]
    deep = 1 if samples.ndim == 2 else samples.shape[2]
    if not h or not w:
        return np.zeros((height, width) if deep == 1 else (height, width, deep))
    edges = np.linspace(0, h, height + 1)
    need = np.unique(np.concatenate([np.floor(edges), np.ceil(edges)]).astype(np.int64))
    total, rows = np.zeros(grey.shape[1], dtype=np.int64), []
    for a, b in zip([0, *need[:-1]], need):
        for at in range(a, b, 1 << 14):
            total = total + grey[at : min(b, at + (1 << 14))].sum(axis=0, dtype=np.int64)
        rows.append(total)
    integral = np.zeros((len(need), w + 1, deep))
    integral[:, 1:] = np.cumsum(np.array(rows, dtype=np.float64).reshape(len(need), w, deep), axis=1)

    def at(table: np.ndarray, where: np.ndarray, places: np.ndarray) -> np.ndarray:
        low = np.searchsorted(places, np.floor(where))
        high = np.searchsorted(places, np.ceil(where))
        part = (where - np.floor(where)).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[high] * part

    columns = np.linspace(0, w, width + 1)
    table = at(integral, edges, need)
    table = at(table.transpose(1, 0, 2), columns, np.arange(w + 1)).transpose(1, 0, 2)
    area = np.diff(np.diff(table, axis=0), axis=1) / ((h / height) * (w / width))
    return area[:, :, 0] if deep == 1 else area


def difference_hash(samples: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 x 9 area means is less than the one on its right."""
    small = np.round(resize(samples if samples.ndim == 2 else samples.mean(axis=2), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int = TILE) -> bytes:
    """A tile of side x side area means, 8-bit (to six places first, so that halves are halves), as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.rint(np.round(resize(samples, side, side), 6)), 0, 255), dtype=np.uint8), allow_pickle=False)
    return out.getvalue()


def media_columns(media: DataFrame, id_col: str, content_col: str, side: int = TILE) -> DataFrame:
    """The id with width, height, channels, tile (NPY bytes) and feature (difference hash) of each image."""
    prepare(media.sparkSession)
    kind = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, width int, height int, channels int, tile binary, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for content in batch.column(1):
                try:
                    image = decode(content.as_py() or b"")
                    row = (image.shape[1], image.shape[0], 1 if image.ndim == 2 else image.shape[2], npy_tile(image, side), difference_hash(image))
                except ValueError:
                    row = (None,) * 5
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], [id_col, "width", "height", "channels", "tile", "feature"])

    return media.select(id_col, content_col).mapInArrow(run, kind)


def text_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """Each text as an 8-bit greyscale image: doc_id, n_bytes, media (PGM bytes).

    The UTF-8 bytes, zero-padded to whole rows (one at least), are the samples.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                raw += bytes(max(width, -(-len(raw) // width) * width) - len(raw))
                out.append(encode_netpbm(np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back, compressed by zstd: images and tiles are most of the bytes."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """Digests of the texts' images and tiles, both written to the shared folder and read back.

    The columns of `media_digests`, with tile_bytes and tile_sha256 for the tile.
    """
    media = _written(text_media(docs, width), "media")
    tiles = _written(media_digests(media), "tiles")
    return tiles.select(*[c for c in tiles.columns if c != "tile"], F.octet_length("tile").cast("bigint").alias("tile_bytes"), F.sha2("tile", 256).alias("tile_sha256"))


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of stored media: doc_id, n_bytes, the payload's and the file's columns, and the tile."""
    import hashlib
    import zlib

    prepare(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for content in batch.column(2):
                raw = content.as_py()
                image = decode(raw)
                payload = image.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(image), npy_tile(image))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols, kinds)], names)

    kind = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, kind)

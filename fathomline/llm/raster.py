"""Media columns: Netpbm and BMP images in a binary column, decoded, resized and tiled.

Images are decoded to numpy arrays, area-resized through integral images, written
as NPY tiles (one binary column) and given difference hashes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm._shared import by_bytes, stage, unstage

#: Width in samples of the images that payloads are stored in.
WIDTH = 64
#: Rows and columns of the area-resized tile; one more column than bits in a row of the hash.
TILE = (8, 9)


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey uint8 array (rows x columns) as binary Netpbm."""
    rows, cols = image.shape
    return b"P5\n%d %d\n255\n" % (cols, rows) + image.tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    """A colour uint8 array (rows x columns x 3) as binary Netpbm."""
    rows, cols, _ = image.shape
    return b"P6\n%d %d\n255\n" % (cols, rows) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A colour uint8 array (rows x columns x 3, RGB) as an uncompressed 24-bit BMP."""
    rows, cols, _ = image.shape
    line = cols * 3 + -cols * 3 % 4
    body = np.zeros((rows, line), np.uint8)
    body[:, : cols * 3] = image[::-1, :, ::-1].reshape(rows, cols * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, cols, rows, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


_SPACE = re.compile(rb"[ \t\n\v\f\r]*")
_DIGITS = re.compile(rb"\d{1,18}")
#: Samples that an image may claim to have, at most.
MOST_SAMPLES = 1 << 31


def _header(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n whole numbers from a place on, each after white space or comments, and the place after them. Each byte is looked at once."""
    out = []
    while len(out) < n:
        first = at
        at = _SPACE.match(data, at).end()
        while data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1
            if not at:
                raise ValueError("Netpbm comment without an end")
            at = _SPACE.match(data, at).end()
        found = _DIGITS.match(data, at)
        if at == first or not found:
            raise ValueError("Netpbm image without its sizes")
        out.append(int(found[0]))
        at = found.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, 8 bits a sample at most: rows x columns, or rows x columns x 3 for P3 and P6."""
    if len(data) < 2 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm image")
    kind = data[1] - 48
    (cols, rows, *top), at = _header(data, 2, 2 if kind in (1, 4) else 3)
    most, depth = top[0] if top else 1, 3 if kind in (3, 6) else 1
    if not 0 < most < 256:
        raise ValueError("more than 8 bits a sample")
    if not 0 < rows * cols * depth <= MOST_SAMPLES:
        raise ValueError("Netpbm image without samples, or with too many")
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.frombuffer(bytes(c - 48 for c in body if c in b"01"), np.uint8) if kind == 1 else np.array([int(x[:4]) if x.isdigit() else 999 for x in body.split()[: rows * cols * depth]], np.int64)
        flat = values[: rows * cols * depth]
    elif kind == 4:
        line = (cols + 7) // 8
        bits = np.frombuffer(data[at + 1 : at + 1 + rows * line], np.uint8)
        if bits.size != rows * line:
            raise ValueError("Netpbm image is cut off")
        flat = np.unpackbits(bits.reshape(rows, line), axis=1)[:, :cols].reshape(-1)
    else:
        flat = np.frombuffer(data[at + 1 : at + 1 + rows * cols * depth], np.uint8)
    if flat.size != rows * cols * depth:
        raise ValueError("Netpbm image is cut off")
    if flat.max() > most:
        raise ValueError("sample beyond the largest value")
    flat = flat.astype(np.uint8)
    if kind in (1, 4):
        flat = 1 - flat
    return flat.reshape((rows, cols, 3) if depth == 3 else (rows, cols))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits: rows x columns x 3, RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    at, size, cols, rows, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    height, line = abs(rows), (cols * bits + 31) // 32 * 4
    if cols <= 0 or not height or height * line > len(data) - at:
        raise ValueError("BMP image without samples, or cut off")
    body = np.frombuffer(data, np.uint8, height * line, at).reshape(height, line)[:, : cols * bits // 8]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        if n > 256 or 14 + size + 4 * n > len(data) or body.max() >= n:
            raise ValueError("BMP palette is cut off or too small")
        image = np.frombuffer(data, np.uint8, n * 4, 14 + size).reshape(n, 4)[:, 2::-1][body]
    else:
        image = body.reshape(height, cols, bits // 8)[:, :, 2::-1]
    return image if rows < 0 else image[::-1]


def decode(data: bytes) -> np.ndarray:
    """Netpbm or BMP, by its first bytes; ValueError for everything else."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over equal areas, edges in fractions of a sample, by an integral image; uint8."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, k], rows, cols) for k in range(image.shape[2])], axis=2)
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)

    def at(table, edges):
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    y, x = np.linspace(0, image.shape[0], rows + 1), np.linspace(0, image.shape[1], cols + 1)
    corner = at(at(total, y).T, x).T
    area = (image.shape[0] / rows) * (image.shape[1] / cols)
    means = (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area
    return np.clip(np.rint(means), 0, 255).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image in whole numbers; a grey image as it is."""
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """64 bits in hex: is a sample of the 8 x 9 tile larger than the one to its right."""
    return np.packbits(tile[:, :-1] > tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    """A tile in NPY form."""
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def media_tiles(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """One row per image: id, rows, cols, tile (NPY bytes), dhash, error.

    Edges: null, empty or broken media give null results and a reason in error
    (null where all is well); ids may be null or repeated; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, out = b.slice(i, 256), []
                for data in part.column(1).to_pylist():
                    try:
                        image = decode(data or b"")
                        small = area_resize(grey(image), *tile)
                        out.append((image.shape[0], image.shape[1], npy(small), difference_hash(small), None))
                    except ValueError as e:
                        out.append((None, None, None, None, str(e)))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "rows", "cols", "tile", "dhash", "error"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, f"doc_id {kind}, rows int, cols int, tile binary, dhash string, error string").withColumnRenamed("doc_id", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, media: its UTF-8 bytes as the samples of a grey Netpbm image of 64 columns.

    The bytes are padded with 0 to a positive multiple of 64. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            raw = [x.encode() for x in b.column(1).fill_null("").to_pylist()]
            out = []
            for x in raw:
                x += bytes(-len(x) % WIDTH or (0 if x else WIDTH))
                out.append(encode_pgm(np.frombuffer(x, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary").withColumnRenamed("doc_id", id_col)


def media_digests(stored: DataFrame) -> DataFrame:
    """What is read back from stored images (doc_id, n_bytes, media): payload and media digests, and the NPY tile with its difference hash.

    A null, empty or broken image gives nulls; ids may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, out = b.slice(i, 512), []
                for data in part.column(2).to_pylist():
                    try:
                        image = decode(data or b"")
                    except ValueError:
                        out.append((None,) * 7)
                        continue
                    payload = image.tobytes()
                    tile = area_resize(grey(image), *TILE)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), npy(tile), difference_hash(tile)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash"]
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string")


def tile_features(tiled: DataFrame) -> DataFrame:
    """tiled with its written NPY tiles loaded again and replaced by feature: the difference hash, made anew, and a digest of the samples. A tile that doesn't give its hash again is an error."""
    at = [tiled.columns.index(c) for c in ("tile", "dhash")]
    rest = [k for k in range(len(tiled.columns)) if k not in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, own in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()):
                if raw is None:
                    out.append(None)
                    continue
                tile = np.load(io.BytesIO(raw), allow_pickle=False)
                if difference_hash(tile) != own:
                    raise ValueError("a tile was not read as it was written")
                out.append(f"{own}:{zlib.crc32(tile.tobytes()):08x}")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(out, pa.string())], [*(b.schema.names[k] for k in rest), "feature"])

    schema = T.StructType([*(tiled.schema.fields[k] for k in rest), T.StructField("feature", T.StringType())])
    return tiled.mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Store whole texts as images in the shared folder, read them back, digest them, write their NPY tiles and read these back.

    Nulls and edges: a null text is empty, one row of 64 zero bytes; equal texts
    have equal values; ids may be null or repeated, each row has its own result; an
    empty table gives no row.
    """
    stored = stage(store_texts(docs), "media")
    tiled = stage(media_digests(stored), "tiles")
    unstage(stored)
    return tile_features(tiled)

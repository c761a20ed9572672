"""Uncompressed rasters (BMP of 24 or 32 bits a pixel) as bands of pixel rows.

Files are read by byte ranges: a large image is many partitions, many small images are one, and planning needs file sizes
only. Inline payloads are cut where they lie. Bands are expanded to pixels by ``images.band_pixels``. What cannot be read
stays as one row with ``error``.

The module is pickled by value, so executors do not need the package installed.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import spread_by
from .files import Draft, opened

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "tintlake_raster"
# Bytes of one input partition.
SPLIT_BYTES = 32 << 20
# Pixels of one band; a band is at least one row.
BAND_PIXELS = 1 << 16
# Longest header that is looked at.
HEAD_BYTES = 138

BAND_FIELDS = "w int, h int, channels int, y int, n int, data binary, error string"
_KINDS = [("w", pa.int32()), ("h", pa.int32()), ("channels", pa.int32()), ("y", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("error", pa.string())]

NOT_A_RASTER = "cannot decode"
TRUNCATED = "truncated"


@dataclass
class Layout:
    """Where the pixel rows of a raster lie; ``stored`` bytes a pixel, of which ``channels`` count."""

    w: int
    h: int
    stored: int
    channels: int
    stride: int
    start: int
    top_down: bool

    def rows_from(self, byte: int) -> int:
        """Stored rows that begin before a byte of the file."""
        return min(max(-(-(byte - self.start) // self.stride), 0), self.h)

    def cut(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        """Stored rows ``first`` to ``last`` in bands."""
        high = max(BAND_PIXELS // self.w, 1)
        for at in range(first, last, high):
            yield at, min(at + high, last)

    def band(self, raw: bytes, first: int, last: int) -> tuple:
        """Row (w, h, channels, y, n, data, error) of the stored rows ``first`` to ``last``, top row first."""
        rows = np.frombuffer(raw, np.uint8).reshape(last - first, self.stride)[:, : self.w * self.stored]
        pixels = rows.reshape(last - first, self.w, self.stored)[:, :, : self.channels]
        y = first
        if not self.top_down:
            pixels, y = pixels[::-1], self.h - last
        return self.w, self.h, self.channels, y, (last - first) * self.w, pixels.tobytes(), None


def layout_of(head: bytes, size: int) -> Layout | str:
    """Layout by the first bytes and the size of a raster, or what is wrong with it."""
    if len(head) < 54 or head[:2] != b"BM":
        return NOT_A_RASTER
    start, header, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", head, 10)
    masks = struct.unpack_from("<4I", head, 54) if header >= 56 and len(head) >= 70 else (0, 0, 0, 0)
    usual = packing == 0 or (packing == 3 and bits == 32 and masks[:3] == (0xFF0000, 0xFF00, 0xFF))
    if header < 40 or w < 1 or h == 0 or bits not in (24, 32) or not usual:
        return NOT_A_RASTER
    stored = bits // 8
    channels = 4 if packing == 3 and masks[3] == 0xFF000000 else 3
    found = Layout(w, abs(h), stored, channels, (w * stored + 3) // 4 * 4, start, h < 0)
    return found if start + found.stride * found.h <= size else TRUNCATED


def header_of(w: int, h: int) -> bytes:
    """Header of a raster of 32 bits a pixel with alpha, top row first."""
    size = 14 + 108
    head = struct.pack("<2sIHHI", b"BM", min(size + 4 * w * h, 0xFFFFFFFF), 0, 0, size)
    return head + struct.pack("<IiiHHIIiiII4I", 108, w, -h, 1, 32, 3, 0, 2835, 2835, 0, 0, 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"sRGB"[::-1] + bytes(48)


def _error(text: str) -> tuple:
    return (*(None,) * 6, text)


# --- files ----------------------------------------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, size, first byte, end) of one task."""

    parts: list[tuple[str, int, int, int]]


def ranges_of(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Files with their sizes dealt to partitions of about ``split`` bytes; an empty file is one empty range."""
    out, parts, held = [], [], 0
    for path, size in files:
        for lo in range(0, max(size, 1), split):
            hi = min(lo + split, size)
            if parts and held + hi - lo > split:
                out.append(Ranges(parts))
                parts, held = [], 0
            parts.append((path, size, lo, hi))
            held += hi - lo
    return [*out, Ranges(parts)] if parts else out


class RasterReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Ranges]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return ranges_of(sorted(files), self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, size, lo, hi in partition.parts:
            with system.open_input_file(path) as file:
                found = layout_of(file.read_at(min(HEAD_BYTES, size), 0), size)
                if isinstance(found, str):
                    rows = iter([_error(found)] if lo == 0 else [])
                else:
                    spans = found.cut(found.rows_from(lo), found.rows_from(hi))
                    rows = (found.band(file.read_at((b - a) * found.stride, found.start + a * found.stride), a, b) for a, b in spans)
                for row in rows:
                    yield pa.record_batch([pa.array([path]), *[pa.array([v], t) for v, (_, t) in zip(row, _KINDS)]], names=["image_id", *[n for n, _ in _KINDS]])


class RasterSource(DataSource):
    """``spark.read.format("tintlake_raster").load(path)``: bands of the rasters under a path (option ``split_bytes``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"image_id string, {BAND_FIELDS}"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_rasters(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Bands (image_id = file path, w, h, channels, y, n, data, error) of all rasters under ``path``.

    A file that is no raster, or shorter than its header says, is one row with ``error``. Names that begin with ``_`` or
    ``.`` are left out.
    """
    spark.dataSource.register(RasterSource)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).load(path)


# --- payloads -------------------------------------------------------------------------------------------------------


def _payload_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, value in enumerate(batch.column(1)):
            raw = value.as_buffer()
            found = layout_of(raw[:HEAD_BYTES].to_pybytes(), raw.size) if raw is not None else NOT_A_RASTER
            if isinstance(found, str):
                rows = iter([_error(found)])
            else:
                at = found.start
                rows = (found.band(raw[at + a * found.stride : at + b * found.stride], a, b) for a, b in found.cut(0, found.h))
            for row in rows:
                yield pa.record_batch([batch.column(0).slice(i, 1), *[pa.array([v], t) for v, (_, t) in zip(row, _KINDS)]], names=["image_id", *[n for n, _ in _KINDS]])


def payload_bands(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Bands of the rasters in a binary column, one payload a time; a null or unreadable payload is one row with ``error``."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInArrow(_payload_bands, f"image_id {kind}, {BAND_FIELDS}")


# --- writing --------------------------------------------------------------------------------------------------------


def _file_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        draft, key = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            w, h, *bgra = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7)]
            pixels = np.stack(bgra, axis=1).astype(np.uint8)
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(ids)]):
                if draft is None or ids[lo] != key:
                    if draft is not None:
                        yield draft.publish()
                    key, draft = ids[lo], Draft(system, root, f"{quote(str(ids[lo]), safe='')}.bmp")
                    draft.add(header_of(int(w[lo]), int(h[lo])))
                draft.add(pixels[lo:hi].tobytes())
        if draft is not None:
            yield draft.publish()

    return run


def write_rasters(pixels: DataFrame, folder: str) -> DataFrame:
    """Write one raster an image from dense rows (image_id, w, h, idx, r, g, b, a); a row (name, path, bytes) a file.

    An image streams through one task in raster order, whatever its size. A file gets its name when it is whole, so that
    a lost task leaves no half file. Runs when the result is evaluated.
    """
    rows = pixels.select("image_id", "w", "h", "b", "g", "r", "a", "idx")
    ordered = spread_by(rows, "image_id").sortWithinPartitions("image_id", "idx").drop("idx")
    return ordered.mapInArrow(_file_writer(folder), "name string, path string, bytes bigint")

"""Token ids in compressed files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents, as numbers in the shard's own alphabet (its distinct ids in ascending
order). Its bit planes are stored from the highest bit down; at each plane the numbers are stably parted by the bit,
zeros first. With counts of ones before every 512 bits a reader finds the id at
a position, the occurrences of an id before a position, and the position of its k-th occurrence, without decoding.

A data set is a folder of Parquet files with one shard a row (part, before, first_id, tokens, shard): Spark's commit
protocol writes it, so a lost executor leaves no half-written shard, and any store that Spark reaches will do. The
``shard`` bytes are the format itself: ``WVM1``, version, plane count, id count, document count, zeros per plane, then
Zstandard frames of document ids, document lengths, alphabet, rank counts and planes, each with its length.

Nulls: a null text is an empty document. Null document ids come first and are kept. Rows repeated in full are written
each. An empty table gives a folder without shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintlake.llm.common import ids_and_texts, row_key, small_batches
from tintlake.llm.tokens import encode_in_blocks, encoder

SHARD_TOKENS = 1 << 18
_BLOCK = 512
_HEAD = "<4sHHQQ"
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
NULL_ID = -(1 << 63)


class WaveletMatrix:
    """Succinct sequence of unsigned ids."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int], samples: list[np.ndarray]):
        self.n, self.alphabet, self.planes, self.zeros, self.samples = n, alphabet, planes, zeros, samples

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        levels = max(1, (len(alphabet) - 1).bit_length())
        number = (np.cumsum(present) - 1).astype(np.uint16 if levels <= 16 else np.uint32)
        v = number[ids]
        planes, zeros, samples = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (v & v.dtype.type(1 << level)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            samples.append(cls._sample(packed))
            low, high = np.compress(~bit, v), np.compress(bit, v)
            zeros.append(len(low))
            v = np.concatenate((low, high))
        return cls(len(ids), alphabet, planes, zeros, samples)

    @staticmethod
    def _sample(packed: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits."""
        step = _BLOCK // 8
        ones = np.add.reduceat(_ONES[packed], np.arange(0, len(packed), step), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _BLOCK
        packed = self.planes[level]
        got = int(self.samples[level][block]) + int(_ONES[packed[block * (_BLOCK // 8) : i // 8]].sum())
        return got + (int(_ONES[packed[i // 8] >> (8 - i % 8)]) if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[out])

    def _number(self, token: int) -> int:
        """The token's number in the alphabet; -1 if it does not occur."""
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        token = self._number(token)
        if token < 0:
            return 0
        lo, hi = 0, i
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        token, lo = self._number(token), 0
        path = []
        for level in range(len(self.planes)):
            a, bit = self._ones(level, lo), token >> (len(self.planes) - 1 - level) & 1
            lo = self.zeros[level] + a if bit else lo - a
            path.append(bit)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            at = self._select_bit(level, path[level], at - self.zeros[level] if path[level] else at)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th bit of a kind in a plane."""
        counts = self.samples[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * _BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)])[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            merged = np.empty_like(out)
            merged[np.flatnonzero(~bit)] = out[: self.zeros[level]]
            merged[np.flatnonzero(bit)] = out[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            out = merged
        return self.alphabet[out] if self.n else out.astype(np.uint32)


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """One shard file."""
    m = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [
        np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8"), np.array(lengths, dtype="<u4"), m.alphabet.astype("<u4"),
        np.concatenate(m.samples).astype("<u4"), np.concatenate(m.planes),
    ]
    frames = [pack(p.tobytes()) for p in parts]
    head = struct.pack(_HEAD, b"WVM1", 1, len(m.planes), m.n, len(doc_ids)) + struct.pack(f"<{len(m.zeros)}Q", *m.zeros)
    return head + b"".join(struct.pack("<Q", len(f)) + f for f in frames)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """Matrix, document ids and document lengths of a shard file."""
    magic, version, levels, n, docs = struct.unpack_from(_HEAD, data)
    if magic != b"WVM1" or version != 1:
        raise ValueError("not a shard of this format")
    at = struct.calcsize(_HEAD)
    zeros = list(struct.unpack_from(f"<{levels}Q", data, at))
    at += 8 * levels
    frames = []
    unpack = zstandard.ZstdDecompressor().decompress
    for _ in range(5):
        (size,) = struct.unpack_from("<Q", data, at)
        frames.append(unpack(data[at + 8 : at + 8 + size]))
        at += 8 + size
    doc_ids = [None if d == NULL_ID else d for d in np.frombuffer(frames[0], "<i8").tolist()]
    samples = np.split(np.frombuffer(frames[3], "<u4"), levels)
    planes = np.split(np.frombuffer(frames[4], np.uint8), levels)
    return WaveletMatrix(n, np.frombuffer(frames[2], "<u4"), planes, zeros, samples), doc_ids, np.frombuffer(frames[1], "<u4")


def _shards(path: str, end_id: int, drops_space: bool, shard_tokens: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path, drops_space)
        part, before = TaskContext.get().partitionId(), 0
        doc_ids, lengths, chunks, size = [], [], [], 0

        def shard():
            ids = np.frombuffer(b"".join(chunks), dtype="<u4")
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([to_bytes(ids, doc_ids, lengths)], pa.binary())],
                names=["part", "before", "first_id", "tokens", "shard"],
            )

        for batch in batches:
            for doc, raw in zip(batch.column("_id").to_pylist(), encode_in_blocks(enc, batch.column("_text").to_pylist())):
                doc_ids.append(doc)
                lengths.append(len(raw) // 4 + 1)
                chunks += (raw, end)
                size += lengths[-1]
                if size >= shard_tokens:
                    yield shard()
                    before += size
                    doc_ids, lengths, chunks, size = [], [], [], 0
        if doc_ids:
            yield shard()

    return run


SHARD_FIELDS = "part int, before long, first_id long, tokens long, shard binary"


def write_token_shards(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, drops_space: bool = True, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of document ids."""
    rows = ids_and_texts(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long")).select("_id", "_text", *row_key()).drop("_k2")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    ordered = rows.repartitionByRange(width, "_id", "_k1").sortWithinPartitions("_id", "_k1").select("_id", "_text")
    shards = ordered.mapInArrow(_shards(path, end_id, drops_space, shard_tokens), SHARD_FIELDS)
    shards.write.option("compression", "none").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``, the number of ids in all shards before."""
    small_batches(spark)
    shards = spark.read.schema(SHARD_FIELDS).parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.min("first_id").alias("first_id"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))  # one row a range partition
    return shards.join(F.broadcast(offsets), "part").select("part", (F.col("base") + F.col("before")).alias("start"), "tokens", "shard")


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("shard")):
                matrix, doc_ids, lengths = from_bytes(data.as_py())
                raw = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                cuts = list(zip((4 * begins).tolist(), (4 * ends).tolist()))
                out = [pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64())]
                names = ["_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([raw[a:b] for a, b in cuts], pa.binary()))
                    names.append("ids")
                yield pa.record_batch(out, names=names)

    return run


def read_documents(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of a data set: id, start, n_tokens, ids_crc32 and, if asked for, ids as little-endian 32-bit bytes."""
    fields = "_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    shards = read_shards(spark, folder).select("start", "shard")
    return shards.mapInArrow(_documents(with_ids), fields).withColumnRenamed("_id", id_col)


def _occurrences(token: int):
    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("shard")):
                matrix, _, _ = from_bytes(data.as_py())
                at = [start + matrix.select(token, k) for k in range(matrix.count(token))]
                yield pa.record_batch([pa.array(at, pa.int64())], names=["position"])

    return run


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Global positions of one id."""
    return read_shards(spark, folder).select("start", "shard").mapInArrow(_occurrences(token), "position long")

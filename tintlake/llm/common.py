"""What the operators share: table access, stored intermediates, words and hashes of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintlake.runtime import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written as Parquet below ``spark.checkpoint.dir`` and read back: lineage ends here, columns stay prunable."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """The stem, with underscores added until no column of ``df`` has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# Bytes of the Arrow batches that tasks exchange with Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: their default bound by rows lets long texts fill an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names given along the way cannot meet the input's; ``_row.*`` restores them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under fixed names, so that further columns of the input cannot clash; null texts are empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))


def row_key() -> list[Column]:
    """128 bits that tell rows with different id or text apart; rows repeated in full share them."""
    return [F.xxhash64("_id", "_text").alias("_k1"), F.xxhash64(F.lit(71), "_text", "_id").alias("_k2")]


def worker_memory(owner: str) -> dict:
    """A dictionary that outlives tasks in one Python worker.

    A worker serves one operator after another; what the one before kept is let go, and freed memory goes back."""
    name = "_tintlake_worker_memory"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].owner, sys.modules[name].kept = owner, {}
    memory = sys.modules[name]
    if memory.owner != owner:
        memory.owner, memory.kept = owner, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)
    return memory.kept


# Bytes of text that are worked on at once in a task (a longer text is one block).
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_M = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


_ROOT = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    memory = worker_memory("words")
    have = memory.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 64)
        pair = []
        for base in (_ROOT, pow(_ROOT, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = memory["powers"] = tuple(pair)
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums ``S`` with which ``span_hash`` gives the hash of any range of ``values``."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal ranges have equal hashes wherever they lie."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_blocks(batch, id_names: tuple[str, ...] = (), text: str = "_text"):
    """Blocks of an Arrow batch of about ``BLOCK_BYTES``: (first row, row count, bytes, row offsets into them)."""
    col = batch.column(batch.schema.get_field_index(text)).fill_null("")
    n = len(col)
    if n == 0:
        return
    wide = np.int64 if str(col.type).startswith("large") else np.int32
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=wide)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last - row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """Start and end bytes of the words of all rows of a block, and the first word's number of each row."""
    word = ~space[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] |= word[first]
    end[last] |= word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(rolling(data.astype(np.uint64) + _M(1)), starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

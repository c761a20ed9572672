"""Best-fit packing of token sequences, matched on the driver over the histogram of their lengths.

Pieces of equal length are interchangeable and so are sequences with equal gaps, so the matching works on sizes: at
most ``capacity`` lengths with a count each, whatever the corpus. The matching is a loop on the driver, not distributed;
one step takes one length, from long to short: its pieces go to the smallest gaps that fit (the j-th piece to the j-th
free place), gaps are updated, and pieces that found no gap open new sequences. Spark counts lengths, ranks the pieces of a length in salted buckets and turns ranks into
places; only counts and the plan (at most ``capacity``^2 rows, at most one a piece) pass the driver.

Nulls: a null text is an empty document (its end id only). Null ids are kept. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import ids_and_texts, stored
from tintlake.llm.tokens import encode_in_blocks, encoder
from tintlake.runtime import dense_position

CAPACITY = 2048


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path, drops_space=False)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, raw in enumerate(encode_in_blocks(enc, batch.column("_text").to_pylist())):
                raw += end
                n, at, k = len(raw) // 4, 0, 0
                while at < n:
                    size = capacity if k or n % capacity == 0 else n % capacity
                    part = raw[4 * at : 4 * (at + size)]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    at, k = at + size, k + 1
            out = [batch.column("_id").take(pa.array(rows, type=pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.record_batch(out, names=names)

    return run


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: _id, piece, start, length, ids_crc32 and, if asked for, ids.

    Only documents longer than the capacity are cut; their first piece takes what is over.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    fields = f"_id {dict(rows.dtypes)['_id']}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_pieces(path, end_id, capacity, with_ids), fields)


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all pieces, as rows (length, first rank, pieces, per sequence, first sequence, offset), and the
    number of sequences. ``counts`` has the number of pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put_back(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n == 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        if gaps[gap] and gaps[gap][-1][0] + gaps[gap][-1][1] == first:
            first, n = gaps[gap][-1][0], gaps[gap].pop()[1] + n
        gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(gap: int, first: int, free: int) -> int:
            """Fill sequences of one gap; the number of sequences that got a piece."""
            nonlocal rank, left
            each = gap // length
            now = min(left, free * each)
            full, over = divmod(now, each)
            plan.append((length, rank, now, each, first, capacity - gap))
            changed.append((gap - each * length, first, full))
            if over:
                changed.append((gap - over * length, first + full, 1))
            rank, left = rank + now, left - now
            return full + (over > 0)

        changed: list[tuple[int, int, int]] = []
        while left and (i := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[i]
            first, free = gaps[gap].pop()
            got = place(gap, first, free)
            if got < free:
                gaps[gap].append((first + got, free - got))
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
        if left:
            need = -(-left // (capacity // length))
            place(capacity, sequences, need)
            sequences += need
        for gap, first, n in changed:
            put_back(gap, first, n)
    return np.array(plan, dtype=np.int64).reshape(-1, 6), sequences


def _places(plan):
    def run(batches):
        rows = plan.value
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            p = rows[at]
            j = rank - p[:, 1]
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_rank"]
            names = [name for name in batch.schema.names if name != "_rank"]
            yield pa.record_batch([*keep, pa.array(p[:, 4] + j // p[:, 3]), pa.array(p[:, 5] + j % p[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity`` (and _id, piece, for a stable order)."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan, _ = best_fit_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    spark = pieces.sparkSession
    salts = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in pieces.columns if c in ("_id", "piece", "start", "ids_crc32")]
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    ranked = dense_position(pieces, ["length"], salt, order, "_rank").select(*pieces.columns, "_rank")
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_places(spark.sparkContext.broadcast(plan)), fields)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    ``path`` names the vocabulary file of a byte-level tokenizer; ``ids`` are little-endian unsigned 32-bit ids.
    """
    pieces = stored(token_pieces(docs, path, id_col, text_col, end_id, capacity, with_ids), "pieces")
    return pack(pieces, capacity).withColumnRenamed("_id", id_col)

"""Hard negatives by rotated one-bit codes with exact intervals.

Rows are packed into shards as they are read. A shard keeps its rows' integer vectors and, of their differences from
the shard's mean turned by a fixed rotation, one sign bit a component, the length and the alignment: the cosine between
the difference and its own sign vector. For an anchor, popcounts of its eight bit-planes against the sign bits (summed by
one product of its levels and the bits) estimate the part of the inner product along the sign vector. The rest of a difference is orthogonal to it and its length is
known from the alignment, so the Cauchy-Schwarz inequality bounds what it can add; likewise for what the anchor loses in
eight bits. The interval is certain, not likely: a row whose interval lies outside what is looked for is dropped, every
other row is scored in integers. No row is lost, whatever the data; only the number of rows scored depends on them.

Anchors meet shards in cells of a grid (part of the shards, group of the anchors): both sides are dealt out by row
number, so labels, ids or vectors that repeat very often fill no cell. A cell keeps the best rows of each anchor, and
the last of them raises the bar for the cell's next shards. Cells' bests are merged exactly.

Nulls: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows with a
component of 2^24 or more in size after scaling. Null ids take part as rows, after all ids on ties, but not as anchors
unless the condition says so. Rows of different vector lengths do not meet. A repeated row is a row of its own (as an
anchor, too); rows equal in score and id come in the order in which they are stored. An empty table has no result.
Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintlake.llm.common import small_batches, stored, worker_memory

SHARD_ROWS = 1024
# Expected rows and anchors of a cell; more make more cells.
CELL_ROWS, CELL_ANCHORS = 16 * SHARD_ROWS, 8192
# Anchors worked at once against a shard, and survivors scored at once.
ANCHORS_AT_ONCE, SCORED_AT_ONCE = 64, 1 << 16
WHOLE = 32  # all pairs are scored in one product where more than one of so many survives
PLANES = 8
LARGEST = 1 << 24


def rotation(dim: int) -> np.ndarray:
    memory = worker_memory("hard negatives")
    if dim not in memory:
        memory[dim] = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
    return memory[dim]


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    words = np.zeros((len(flags), 8 * max(1, -(-flags.shape[1] // 64))), dtype=np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view(np.uint64)


def sign_codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sign bits, alignments and lengths of the differences from the mean."""
    dim = vectors.shape[1]
    centre = vectors.mean(axis=0)
    turned = (vectors - centre) @ rotation(dim)
    length = np.sqrt((turned * turned).sum(axis=1))
    align = np.abs(turned).sum(axis=1) / np.where(length > 0, length * np.sqrt(max(dim, 1)), 1.0)
    return centre, _bits(turned >= 0), np.minimum(align, 1.0), length


def intervals(anchors: np.ndarray, centre: np.ndarray, codes: np.ndarray, align: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchors x rows) that hold the inner products."""
    dim = max(anchors.shape[1], 1)
    t = anchors @ rotation(anchors.shape[1])
    low = t.min(axis=1, initial=0.0)
    step = np.maximum(t.max(axis=1, initial=0.0) - low, 1e-30) / ((1 << PLANES) - 1)
    level = np.rint((t - low[:, None]) / step[:, None]).astype(np.uint8)
    lost = np.sqrt(((t - low[:, None] - step[:, None] * level) ** 2).sum(axis=1))[:, None]
    # the popcounts of all planes, weighted and summed, are one product of the levels and the bits; it is exact
    kind = np.float32 if anchors.shape[1] << PLANES < 1 << 24 else np.float64
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")[:, : anchors.shape[1]]
    matched = (level.astype(kind) @ bits.T.astype(kind)).astype(np.float64)
    signs = 2 * np.bitwise_count(codes).sum(axis=1, dtype=np.int32) - anchors.shape[1]
    level_dot = 2 * matched - level.sum(axis=1, dtype=np.int32)[:, None]
    along = (low[:, None] * signs + step[:, None] * level_dot) / np.sqrt(dim)
    size2 = (t * t).sum(axis=1)[:, None]
    across = np.sqrt(np.maximum(size2 - np.maximum(np.abs(along) - lost, 0.0) ** 2, 0.0))
    middle = (anchors @ centre)[:, None] + length * align * along
    slack = 1e-9 * np.sqrt(size2) * (np.sqrt(centre @ centre) + length) + 1e-6  # of floating point
    half = length * (align * lost + np.sqrt(np.maximum(1.0 - align * align, 0.0)) * across) + slack
    return middle - half, middle + half


def _most(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if _most(a, b) < 2.0**53:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)


# ---------------------------------------------------------------- shards

SHARD = "shard bigint, dim int, ids binary, known binary, labels binary, chosen binary, centre binary, codes binary, align binary, length binary, wide int, vectors binary"


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the rows of each batch, rows of one label side by side."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        out = []
        lists = batch.column(3)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, begin = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        ids, labels = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        chosen = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            rows = rows[np.argsort(labels[rows], kind="stable")]
            for at in range(0, len(rows), SHARD_ROWS):
                r = rows[at : at + SHARD_ROWS]
                v = flat[begin[r][:, None] + np.arange(dim)].reshape(len(r), dim)
                centre, codes, align, length = sign_codes(v)
                wide = 2 if np.abs(v).max(initial=0) < 1 << 15 else 4
                out.append((number, dim, _blob(ids[r]), _blob(known[r]), _blob(labels[r]), _blob(chosen[r]), _blob(centre), _blob(codes), _blob(align), _blob(length), wide, _blob(v.astype(f"i{wide}"))))
                number += 1
        if out:
            schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "known", "labels", "chosen", "centre", "codes", "align", "length")], ("wide", pa.int32()), ("vectors", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


class Shard:
    def __init__(self, row: dict):
        self.shard, self.dim = row["shard"], row["dim"]
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.ids, self.known, self.labels, self.chosen = read("ids", np.int64), read("known", bool), read("labels", np.int64), read("chosen", bool)
        self.centre, self.align, self.length = read("centre", np.float64), read("align", np.float64), read("length", np.float64)
        self.codes = read("codes", np.uint64).reshape(len(self.ids), -1)
        self.vectors = read("vectors", f"i{row['wide']}").reshape(len(self.ids), self.dim)

    @staticmethod
    def each(table: pa.Table | pa.RecordBatch) -> Iterator[Shard]:
        for k in range(table.num_rows):
            yield Shard({c: table.column(c)[k].as_py() for c in table.schema.names})


def build_shards(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column | None, scale: float) -> DataFrame:
    """The rows that take part, packed where they are read, components ``floor(scale * x)``."""
    small_batches(rows.sparkSession)
    if anchors is None:
        anchors = F.lit(False)
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fits = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LARGEST))
    valid = rows.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & fits)
    plain = valid.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long"), anchors.cast("boolean"), v)
    return stored(plain.toDF("id", "label", "chosen", "v").mapInArrow(_pack, SHARD), "shards")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in Shard.each(batch):
            at = np.flatnonzero(s.chosen)
            ids = pa.array(s.ids[at], mask=~s.known[at])
            vectors = pa.array([_blob(s.vectors[i].astype(np.int32)) for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s.shard)), pa.array(at.astype(np.int32)), ids, pa.array(s.labels[at]), vectors], ["a_shard", "a_pos", "anchor_id", "label", "v"])


# ---------------------------------------------------------------- cells


class Best:
    """The first ``k`` rows of each slot: greatest score, then smallest id, then storage order."""

    def __init__(self, slots: int, k: int):
        self.k, self.bar, self.count = k, np.full(slots, -np.inf), np.zeros(slots, dtype=np.int64)
        self.kept = [np.zeros((slots, k), t) for t in (np.int64, bool, np.int64, np.int64, np.int64)]

    @property
    def rows(self) -> list[np.ndarray]:
        """Slot, score, null id, id, shard and place of all rows."""
        held = np.nonzero(np.arange(self.k) < self.count[:, None])
        return [held[0], *[x[held] for x in self.kept]]

    def add(self, slot, *row) -> None:
        """Rows (score, null id, id, shard, place); only the slots that they come to are sorted."""
        if not len(slot):
            return
        touched = np.unique(slot)
        at = np.nonzero(np.arange(self.k) < self.count[touched, None])
        old = touched[at[0]]
        slot, score, unknown, ids, shard, pos = row = [np.concatenate(x) for x in ((old, slot), *((x[old, at[1]], y) for x, y in zip(self.kept, row)))]
        order = np.lexsort((pos, shard, ids, unknown, -score, slot))
        first = np.searchsorted(slot[order], slot[order], side="left")
        place = np.arange(len(order)) - first
        kept, place = order[place < self.k], place[place < self.k]
        for x, y in zip(self.kept, row[1:]):
            x[slot[kept], place] = y[kept]
        self.count[touched] = np.bincount(np.searchsorted(touched, slot[kept]), minlength=len(touched))
        last = kept[place == self.k - 1]
        self.bar[slot[last]] = score[last]


def _kth(bounds: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; -inf if there are fewer."""
    if bounds.shape[1] < k:
        return np.full(len(bounds), -np.inf)
    return np.partition(bounds, bounds.shape[1] - k, axis=1)[:, -k]


def _bars(bar: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """What rows have to reach: the bar, and where there is none yet the k-th largest of the lower bounds."""
    none = np.flatnonzero(np.isneginf(bar))
    if len(none):
        bar[none] = _kth(bounds[none], k)
    return bar


def _scored(s: Shard, vectors: np.ndarray, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    who, row = np.nonzero(keep)
    if len(who) * WHOLE > keep.size and _most(vectors, s.vectors) < 2.0**53:  # then cheaper and as exact
        scores = (vectors.astype(np.float64) @ s.vectors.T.astype(np.float64))[keep].astype(np.int64)
        yield who, row, scores
        return
    for lo in range(0, len(who), SCORED_AT_ONCE):
        w, r = who[lo : lo + SCORED_AT_ONCE], row[lo : lo + SCORED_AT_ONCE]
        yield w, r, products(vectors[w], s.vectors[r])


def _vectors(anchors: pa.Table) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """Anchors by vector length, and each one's vector."""
    v = [np.frombuffer(x.as_py(), dtype=np.int32) for x in anchors.column("v")]
    sizes = np.array([len(x) for x in v])
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}, v


def _at_once(shards: pa.Table, anchors: pa.Table):
    """(shard, numbers of some anchors, their vectors, lower and upper bounds) of every meeting in a cell."""
    by_size, v = _vectors(anchors)
    for s in Shard.each(shards):
        rows = by_size.get(s.dim, ())
        for lo in range(0, len(rows), ANCHORS_AT_ONCE):
            some = rows[lo : lo + ANCHORS_AT_ONCE]
            vectors = np.array([v[i] for i in some]).reshape(len(some), s.dim)
            yield s, some, vectors, *intervals(vectors.astype(np.float64), s.centre, s.codes, s.align, s.length)


def _ids(unknown: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=unknown)


POSITIVE = "a_shard bigint, a_pos int, id bigint, score bigint, shard bigint, pos bigint"


def _positives(k: int):
    def run(shards: pa.Table, anchors: pa.Table) -> pa.Table:
        a_shard, a_pos, label = (anchors.column(c).to_numpy() for c in ("a_shard", "a_pos", "label"))
        best = Best(anchors.num_rows, k)
        for s, some, vectors, low, high in _at_once(shards, anchors):
            fits = label[some][:, None] == s.labels
            own = np.flatnonzero(a_shard[some] == s.shard)
            fits[own, a_pos[some][own]] = False
            bar = _bars(best.bar[some], np.where(fits, low, -np.inf), k)
            for w, r, score in _scored(s, vectors, fits & (high >= bar[:, None])):
                x = np.flatnonzero(score >= best.bar[some[w]])
                best.add(some[w[x]], score[x], ~s.known[r[x]], s.ids[r[x]], np.full(len(x), s.shard), r[x])
        slot, score, unknown, ids, shard, pos = best.rows
        return pa.table({"a_shard": a_shard[slot], "a_pos": a_pos[slot].astype(np.int32), "id": _ids(unknown, ids), "score": score, "shard": shard, "pos": pos})

    return run


NEGATIVE = "a_shard bigint, a_pos int, anchor_id bigint, place int, positive_id bigint, positive_score bigint, id bigint, score bigint, shard bigint, pos bigint"


def _negatives(positives: int, k: int, low_share: int, high_share: int):
    def run(shards: pa.Table, anchors: pa.Table) -> pa.Table:
        a_shard, a_pos, label = (anchors.column(c).to_numpy() for c in ("a_shard", "a_pos", "label"))
        found = anchors.column("positives").to_pylist()
        target = np.zeros((len(found), positives), dtype=np.int64)
        given = np.zeros(target.shape, dtype=bool)
        for i, row in enumerate(found):
            target[i, : len(row)], given[i, : len(row)] = [p["score"] for p in row], True
        best = Best(target.size, k)
        for s, some, vectors, low, high in _at_once(shards, anchors):
            other = label[some][:, None] != s.labels
            least, most = np.full(len(some), np.inf), np.full(len(some), -np.inf)  # of what can be among the rows of any positive
            for j in range(positives):
                t = np.where(given[some, j], target[some, j].astype(np.float64), np.nan)
                floor, roof = low_share / 100 * t, high_share / 100 * t
                bar = best.bar[some * positives + j]
                fresh = np.flatnonzero(np.isneginf(bar) & given[some, j])
                if len(fresh):
                    certain = other[fresh] & (low[fresh] >= floor[fresh, None]) & (high[fresh] <= roof[fresh, None])
                    bar[fresh] = _kth(np.where(certain, low[fresh], -np.inf), k)
                floor = np.fmax(floor, bar)
                can = given[some, j] & (floor <= roof + np.abs(roof) * 1e-12 + 1)
                least, most = np.where(can, np.minimum(least, floor), least), np.where(can, np.maximum(most, roof), most)
            keep = other & (high >= least[:, None]) & (low <= most[:, None])
            for w, r, score in _scored(s, vectors, keep):
                near = np.flatnonzero((score >= least[w] - np.abs(least[w]) * 1e-12 - 1) & (score <= most[w] + np.abs(most[w]) * 1e-12 + 1))  # of any positive
                w, r, score = w[near], r[near], score[near]
                for j in range(positives):
                    t, slot = target[some[w], j], some[w] * positives + j
                    fits = given[some[w], j] & (score >= best.bar[slot]) & (low_share * t <= 100 * score) & (100 * score <= high_share * t)
                    x = r[fits]
                    best.add(slot[fits], score[fits], ~s.known[x], s.ids[x], np.full(len(x), s.shard), x)
        slot, score, unknown, ids, shard, pos = best.rows
        a, j = slot // positives, slot % positives
        pair = [found[x][y] for x, y in zip(a.tolist(), j.tolist())]
        return pa.table(
            {
                "a_shard": a_shard[a], "a_pos": a_pos[a].astype(np.int32), "anchor_id": anchors.column("anchor_id").combine_chunks().take(pa.array(a)), "place": j.astype(np.int32),
                "positive_id": pa.array([p["id"] for p in pair], pa.int64()), "positive_score": target[a, j], "id": _ids(unknown, ids), "score": score, "shard": shard, "pos": pos,
            }
        )

    return run


def _meet(shards: DataFrame, anchors: DataFrame, parts: int, groups: int, work, schema: str) -> DataFrame:
    """Every shard meets every anchor: shards are repeated per group of anchors, anchors per part of the shards."""
    left = shards.drop("chosen").withColumns({"part": F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int"), "grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    right = anchors.withColumns({"grp": F.pmod(F.xxhash64("a_shard", "a_pos"), F.lit(groups)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        chosen = pa.array([b""] * a.num_rows, pa.binary())
        return work(a.append_column("chosen", chosen), b)

    # an explicit width, as the cells are much work for few bytes; few cells go to more partitions, so that hashes put few together
    width = 4 * parts * groups if parts * groups < 512 else parts * groups
    left, right = (side.repartition(width, "part", "grp") for side in (left, right))
    return left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp")).applyInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """For each anchor row and each of its ``positives`` best other rows of its label, the ``negatives`` best rows of
    other labels whose score is ``low`` to ``high`` per cent of the positive's.

    Scores are inner products of ``floor(scale * component)``; ties go to the smaller id. ``anchors`` is a condition on
    ``rows``; labels are integers. Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("positives and negatives must be at least 1")
    shards = build_shards(rows, id_col, vector_col, label_col, anchors, scale)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = shards.agg(F.sum(F.length("known")).alias("n")).first()["n"] or 0
    parts = max(width, -(-size // CELL_ROWS))
    asked = stored(shards.mapInArrow(_chosen, "a_shard bigint, a_pos int, anchor_id bigint, label bigint, v binary"), "anchors")
    groups = max(1, -(-asked.count() // CELL_ANCHORS))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "shard", "pos"]
    near = _meet(shards, asked, parts, groups, _positives(positives), POSITIVE)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("a_shard", "a_pos").orderBy(*order))).filter(F.col("place") <= positives)
    listed = near.groupBy("a_shard", "a_pos").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))  # at most ``positives``
    aimed = stored(asked.join(listed, ["a_shard", "a_pos"]), "positives")
    far = _meet(shards, aimed, parts, groups, _negatives(positives, negatives, low, high), NEGATIVE)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("a_shard", "a_pos", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

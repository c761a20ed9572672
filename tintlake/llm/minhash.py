"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

Documents are multisets of word shingles. A signature register holds the first point of a Poisson process whose rate
is the document's weight, so two registers agree with the weighted Jaccard similarity as probability. Weights are
discretised to whole numbers and their axis is cut hierarchically: (0, 1], (1, 2], (2, 4], (4, 8], ... each carry a
process of their own, and a point inside a partly covered interval falls into one of its unit cells. All registers of
a shingle share one process, and points later than the slowest register are never drawn, so a document costs about
``m ln m`` points however long it is.

1. Rows with the same words are one node (a group of copies shrinks to one row before anything is compared).
2. Nodes that share a band are candidates. In each band bucket all members are compared with one leader, the member
   with most bucket mates; links give components.
3. Whatever bucket still holds several components is compared across them, so every candidate pair ends up inside
   one component or verified. No cap on bucket sizes. A crowd of texts that each differ from a common source by edits
   of their own is not compared all with all: shingles that at most ``RARE`` nodes of these buckets have are rare, and
   pairs that share a rare shingle are found through it. Two nodes without a common one overlap in their other
   shingles at most, which leaves a node only partners in a narrow range of sizes, often none.
4. Candidates whose signatures differ in far more bits than 0.8 allows (five deviations) are left out; the rest is
   verified on the texts.

Nulls: a null text counts as empty; texts without words form one class. Texts shorter than a shingle are one shingle.
Null ids are kept; a class without any id has a null class id. Repeated rows get the same class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import ids_and_texts, mix, rolling, row_key, signed, small_batches, span_hash, stored, text_blocks, whole_row, word_bounds, word_hashes
from tintlake.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
BAND_ROWS = 4
# Bits of two 128-bit sketches that may differ (12.8 are expected at 0.8, deviation 3.4).
FAR_BITS = 32
# Nodes that a rare shingle has at most, and the logarithm of the ratio of neighbouring size classes.
RARE = 16
SIZE_STEP = 0.03

_U = np.uint64
_ROW_BITS = 50
_SCALE = float(1 << 30)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and the shingle's count, for rows whose words begin at ``first`` (with an end mark)."""
    prefix, n = rolling(words), np.diff(first)
    full = np.maximum(n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), full)
    at = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full) + first[row]
    h = span_hash(prefix, at, np.minimum(at + size, first[row + 1]))
    key = np.sort((row.astype(_U) << _U(_ROW_BITS)) | (h >> _U(64 - _ROW_BITS)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(key)))
    return (key[begin] >> _U(_ROW_BITS)).astype(np.int64), key[begin] & _U((1 << _ROW_BITS) - 1), count


def bag_minhash(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """Signature registers (rows x m) of weighted sets; infinite for rows without shingles."""
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    each = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
    lower = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    width = np.maximum(lower, 1)
    doc, weight = row[each], count[each]
    seed = mix(shingle[each] + (level.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
    registers = np.full((rows, m), np.inf)
    flat = registers.reshape(-1)
    total = np.bincount(row, weights=count, minlength=rows)
    with np.errstate(divide="ignore"):
        horizon = (np.log(m) + 6) * _SCALE * m / total  # all registers are very likely filled before it
    time, drawn = np.zeros(len(each)), 0
    while len(each):
        chunk = 1 if len(each) > 4096 else 64
        z = mix(seed[:, None] + (np.arange(drawn + 1, drawn + chunk + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[None, :])
        gap = np.rint(-np.log(((z >> _U(11)).astype(np.float64) + 1) * 2.0**-53) * _SCALE) / width[:, None]
        gap[:, 0] += time
        x = np.cumsum(gap, axis=1)  # whole multiples of a power of two: exact
        spot = mix(z ^ _U(0xA5A5A5A5DEADBEEF))
        cell = ((spot >> _U(16)) & (width.astype(_U) - _U(1))[:, None]).astype(np.int64)
        hit = (lower[:, None] + cell < weight[:, None]) & (x < horizon[doc][:, None])
        where = doc[:, None] * m + (spot & _U(m - 1)).astype(np.int64)
        np.minimum.at(flat, where[hit], x[hit])
        drawn += chunk
        time = x[:, -1]
        worst = registers.max(axis=1)
        stay = time < np.minimum(worst, horizon)[doc]
        each, doc, lower, width, weight, seed, time = (v[stay] for v in (each, doc, lower, width, weight, seed, time))
    late = np.flatnonzero(np.isinf(registers).any(axis=1) & (total > 0))
    for d in late:  # rare: a register is filled beyond the horizon
        mine = row == d
        registers[d] = _without_horizon(shingle[mine], count[mine], m)
    return registers


def _without_horizon(shingle: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    best = np.full(m, np.inf)
    active = [(int(s), int(c), lv) for s, c in zip(shingle, count) for lv in range((int(c) - 1).bit_length() + 1)]
    for s, c, lv in active:
        lower = 1 << (lv - 1) if lv else 0
        width = max(lower, 1)
        seed = mix(np.array([s], dtype=_U) + _U((lv + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        t, start = 0.0, 0
        while t < best.max():
            z = mix(seed + np.arange(start + 1, start + 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
            gap = np.rint(-np.log(((z >> _U(11)).astype(np.float64) + 1) * 2.0**-53) * _SCALE) / width
            gap[0] += t
            x = np.cumsum(gap)
            spot = mix(z ^ _U(0xA5A5A5A5DEADBEEF))
            hit = lower + ((spot >> _U(16)) & _U(width - 1)).astype(np.int64) < c
            np.minimum.at(best, (spot & _U(m - 1)).astype(np.int64)[hit], x[hit])
            t, start = x[-1], start + 256
    return best


def _signatures(size: int, m: int, band_rows: int):
    def run(batches):
        for batch in batches:
            for at, n, data, offsets in text_blocks(batch):
                starts, ends, first = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends)
                a, b = rolling(words), rolling(mix(words ^ _U(0x5851F42D4C957F2D)))
                node, check = span_hash(a, first[:-1], first[1:]), span_hash(b, first[:-1], first[1:])
                row, shingle, count = shingles(words, first, size)
                registers = bag_minhash(row, shingle, count, n, m)
                bits = mix(registers.view(_U))
                bands = bits.reshape(n, m // band_rows, band_rows)
                value = np.broadcast_to(np.arange(m // band_rows, dtype=_U)[None, :], bands.shape[:2])
                for k in range(band_rows):
                    value = mix(value * _U(0x9E3779B97F4A7C15) + bands[:, :, k])
                one = (bits >> _U(20)) & _U(1)
                half = [(one[:, i : i + 64] << np.arange(min(64, m - i), dtype=_U)).sum(axis=1, dtype=_U) for i in (0, 64)]
                rows = pa.array(np.arange(at, at + n))
                total = np.bincount(row, weights=count, minlength=n).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * (m // band_rows) + 1, m // band_rows, dtype=np.int32)), pa.array(signed(np.ascontiguousarray(value)).reshape(-1)))
                yield pa.record_batch(
                    [batch.column("_id").take(rows), batch.column("_k1").take(rows), batch.column("_k2").take(rows), pa.array(signed(node)), pa.array(signed(check)), pa.array(total), pa.array(signed(half[0])), pa.array(signed(half[1])), lists],
                    names=["_id", "_k1", "_k2", "node", "check", "n", "s1", "s2", "bands"],
                )

    return run


def _overlap(size: int):
    """Multiset Jaccard of the shingles of two texts."""

    def bag(text: str):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, first = word_bounds(data, np.array([0, len(data)]))
        _, s, c = shingles(word_hashes(data, starts, ends), first, size)
        return s, c

    def run(frames):
        last, left = None, None
        for df in frames:
            out = []
            for a, x, y in zip(df["a"], df["ta"], df["tb"]):
                if a != last:
                    last, left = a, bag(x)
                s, c = bag(y)
                _, i, j = np.intersect1d(left[0], s, assume_unique=True, return_indices=True)
                both = int(np.minimum(left[1][i], c[j]).sum())
                whole = int(left[1].sum() + c.sum()) - both
                out.append(both / whole if whole else 1.0)
            yield pd.DataFrame({"a": df["a"], "b": df["b"], "similarity": np.array(out, dtype=float)})

    return run


def _close(threshold: float):
    """Sizes and sketches under which two nodes can reach the threshold."""
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    far = F.bit_count(F.col("s1").bitwiseXOR(F.col("other_s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("other_s2")))
    return (small >= large * F.lit(threshold)) & (far <= FAR_BITS)


def _shingle_rows(size: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column("node")
            for at, n, data, offsets in text_blocks(batch):
                starts, ends, first = word_bounds(data, offsets)
                row, shingle, count = shingles(word_hashes(data, starts, ends), first, size)
                yield pa.record_batch([nodes.take(pa.array(row + at)), pa.array(signed(shingle)), pa.array(count.astype(np.int64))], names=["node", "shingle", "count"])

    return run


def _rare_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingle, count, nodes) of the shingles that at most ``RARE`` nodes of ``texts`` have."""
    rows = texts.mapInArrow(_shingle_rows(size), "node long, shingle long, count long")
    few = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes")).filter(F.col("nodes") <= RARE)
    return rows.join(few, "shingle")


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / F.lit(SIZE_STEP)).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: id and class_id, the smallest id among the documents that near-duplicate links connect."""
    rows = ids_and_texts(docs, id_col, text_col).select("_id", "_text", *row_key())
    members, classes = _classes(rows, threshold, shingle_words)
    return members.join(classes, "node").select(F.col("_id").alias(id_col), F.col("head._id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id (null ids last)."""
    small_batches(docs.sparkSession)
    keyed = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    keyed = keyed.select("*", *row_key())
    _, classes = _classes(keyed.select("_id", "_text", "_k1", "_k2"), threshold, shingle_words)
    heads = classes.select("head._k1", "head._k2").distinct()
    return keyed.join(heads, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*")


def _classes(rows: DataFrame, threshold: float, shingle_words: int) -> tuple[DataFrame, DataFrame]:
    """(_id, node) of every row, and (node, head): the class's first row as (none, _id, _k1, _k2)."""
    kind = dict(rows.dtypes)["_id"]
    fields = f"_id {kind}, _k1 long, _k2 long, node long, check long, n long, s1 long, s2 long, bands array<long>"
    signed_rows = stored(rows.mapInArrow(_signatures(shingle_words, REGISTERS, BAND_ROWS), fields), "signatures")
    nodes = signed_rows.groupBy("node").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2")).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands"),
    )
    nodes = stored(nodes, "nodes")
    members = nodes.filter("n > 0").select("node", "copies", "n", "s1", "s2", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(members.join(sizes, "bucket"), "buckets")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "node")
    leader = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "copies", "node", "n", "s1", "s2")).alias("top"))
    leader = leader.select("bucket", F.col("top.node").alias("leader"), F.col("top.n").alias("other_n"), F.col("top.s1").alias("other_s1"), F.col("top.s2").alias("other_s2"))
    star = members.join(leader, "bucket").filter((F.col("node") != F.col("leader")) & _close(threshold))
    pairs = star.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()

    wanted = members.select("node").distinct().join(nodes.select("node", "head"), "node").select("node", "head._k1", "head._k2")
    texts = rows.select("_k1", "_k2", "_text").join(wanted, ["_k1", "_k2"]).select("node", "_text")
    # A row repeated in full gives its node's text more than once.
    texts = stored(texts.dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        full = pairs.join(texts.select(F.col("node").alias("b"), F.col("_text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("_text").alias("ta")), "a")
        return full.select("a", "b", "ta", "tb").mapInPandas(_overlap(shingle_words), "a long, b long, similarity double").filter(F.col("similarity") >= threshold)

    links = stored(verified(pairs), "verified")
    label = components(links)
    placed = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Buckets whose members are not all in one component: members outside the leader's component against all.
    main = leader.select("bucket", F.col("leader").alias("node")).join(label, "node", "left").select("bucket", F.coalesce("label", "node").alias("main"))
    placed = placed.join(main, "bucket")
    mixed = placed.filter("label <> main").select("bucket").distinct()
    placed = stored(placed.join(mixed, "bucket"), "mixed")
    columns = ("node", "n", "s1", "s2", "label")
    facts = placed.select(*columns).distinct()
    rare = stored(_rare_shingles(texts.join(facts.select("node"), "node"), shingle_words), "rare")
    differs = F.col("label") != F.col("other_label")
    common = rare.groupBy("node").agg(F.sum("count").alias("rare"))
    with_common = lambda df: df.join(common, "node", "left").withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0))).drop("rare")
    # Pairs without a common rare shingle.
    placed = with_common(placed).join(nodes.select("node", "bands"), "node")
    odd = placed.filter("label <> main").select("bucket", *[F.col(c).alias(f"other_{c}") for c in (*columns, "common", "bands")])
    least = F.lit(threshold) * F.col("other_n") - 1e-6
    most = F.col("other_common") * F.lit((1 + threshold) / threshold) - F.col("other_n") + 1e-6
    sizes = F.sequence(_size_class(least), _size_class(F.least(most, F.col("other_n") / F.lit(threshold) + 1e-6)))
    odd = odd.filter(most >= least).withColumn("class", F.explode(sizes))
    reach = F.least("common", "other_common") >= (F.col("n") + F.col("other_n")) * F.lit(threshold / (1 + threshold)) - 1e-6
    # Of the buckets that two nodes share, the first gives the pair.
    first_shared = F.element_at(F.array_intersect("bands", "other_bands"), 1) == F.col("bucket")
    once = (F.col("label") == F.col("main")) | (F.col("node") < F.col("other_node"))
    across = placed.withColumn("class", _size_class(F.col("n"))).join(odd, ["bucket", "class"]).filter(differs & once & reach & _close(threshold) & first_shared)
    # Pairs with some: their other shingles and these bound the overlap.
    shared = rare.filter("nodes > 1").select("node", "shingle", "count").join(with_common(facts), "node")
    other = shared.select("shingle", *[F.col(c).alias(f"other_{c}") for c in (*columns, "common", "count")])
    through = shared.join(other, "shingle").filter((F.col("node") < F.col("other_node")) & differs & _close(threshold))
    pair = ("node", "other_node", "n", "other_n", "common", "other_common")
    through = through.groupBy(*pair).agg(F.sum(F.least("count", "other_count")).alias("both"))
    enough = F.least("common", "other_common") + F.col("both") >= (F.col("n") + F.col("other_n")) * F.lit(threshold / (1 + threshold)) - 1e-6
    through = through.filter(enough)
    rest = across.select("node", "other_node").union(through.select("node", "other_node"))
    rest = rest.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
    more = stored(verified(rest), "verified")
    label = components(links.union(more))

    heads = nodes.select("node", "head").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    linked = heads.join(label.select("node"), "node", "left_semi").groupBy("label").agg(F.min("head").alias("class_head"))
    classes = heads.join(linked, "label", "left").select("node", F.coalesce("class_head", "head").alias("head"))
    return signed_rows.select("_id", "node"), classes

"""The registered k-means queries run to rest: labels against brute force over the points they cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tintlake.functions import constants as K
from tintlake.operators import clusters as cl

SF = "/root/testdata/sf0.001"


def settled(f, w, pos, k):
    """Labels of plain Lloyd rounds until nothing moves, at most 50, from the operators' seeds."""
    f, near = np.round(f, 6), lambda c: ((f[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
    heavy = lambda mass: max((int(np.floor(np.log(m + 1.0) * 1e6)), -p, i) for i, (m, p) in enumerate(zip(mass, pos)) if m > 0)[2] if (mass > 0).any() else None
    lead = f[heavy(w)]
    centres = [lead]
    for _ in range(1, k):
        far = heavy(w * near(centres).min(axis=1))
        if far is None:
            break
        centres.append(f[far])
    used = 0
    for used in range(1, K.LLOYD_ROUNDS + 1):
        c = near(centres).argmin(axis=1)
        moved = [np.round((f[c == j] * w[c == j, None]).sum(axis=0) / w[c == j].sum(), 6) if (c == j).any() else lead for j in range(len(centres))]
        if np.allclose(moved, centres, atol=1e-9, rtol=0):
            break
        centres = moved
    return near(centres).argmin(axis=1), used


@pytest.mark.parametrize("name, k", [("c6_kmeans", 5), ("c7_okkmeans", 5), ("c8_wkmeans", 25), ("c9_soft", 25), ("c10_softk", 25), ("c16_grouped_lloyd", 8), ("c19_corpus_kmeans", 5)])
def test_rounds_go_on_to_rest(spark, monkeypatch, name, k):
    seen, plain = [], cl.cluster_points

    def watched(points, n, rounds=K.LLOYD_ROUNDS, key="image_id"):
        assert (n, rounds) == (k, K.LLOYD_ROUNDS)
        seen.append((key, plain(points, n, rounds, key)))
        return seen[0][1]

    monkeypatch.setattr(cl, "cluster_points", watched)
    assert queries()[name](spark, SF).count() > 0
    key, labelled = seen[0]
    table = labelled.select(key, "pos", "w", *cl.FEATURES, "c").toPandas()
    longest = 0
    for _, image in table.groupby(key):
        want, used = settled(image[cl.FEATURES].to_numpy(float), image["w"].to_numpy(float), image["pos"].to_numpy(), k)
        assert (image["c"].to_numpy() == want).all()
        longest = max(longest, used)
    assert longest > 1
    print(name, "rounds", longest)


def spots(palette):
    return sorted(tuple(x) for x in palette.collect())


def test_spread_rounds_give_the_same(spark, monkeypatch):
    """Images cut into many blocks against images settled in one, with and without states that are broadcast."""
    names = ("c7_okkmeans", "c8_wkmeans")
    want = {name: spots(queries()[name](spark, SF)) for name in names}
    monkeypatch.setattr(cl, "BLOCK_POINTS", 100)
    assert {name: spots(queries()[name](spark, SF)) for name in names} == want
    monkeypatch.setattr(cl, "BROADCAST_BYTES", 0)
    assert spots(queries()["c7_okkmeans"](spark, SF)) == want["c7_okkmeans"]


def test_one_join_a_round(spark, make_pixels):
    image = make_pixels({1: (8, [(i * 3, 255 - i, i * i % 251, 255) for i in range(64)])})
    points = cl.color_points(image, "oklab")
    blocks = cl.cut(cl.packed_points(cl.laid_out(points, "image_id"), "image_id"))
    start = blocks.select("image_id").distinct().withColumn("centres", F.array().cast(f"array<{cl._CENTRE}>"))
    state = cl.cut(cl.seeded(blocks, start, "image_id", True).select("image_id", "centres", F.element_at("centres", 1).alias("lead")))
    for step in range(1, 7):
        state = cl.moved(blocks, state, "image_id", True)
        assert state._jdf.queryExecution().optimizedPlan().toString().count("Join") == step


def test_more_colours_than_the_default(spark, make_pixels):
    """Over-clusters follow the palette: 32 colours of an image that has them."""
    image = make_pixels({1: (64, [(i % 8 * 36, i // 8 % 8 * 36, i // 64 * 36, 255) for i in range(512)])})
    assert cl.weighted_kmeans(image, k=32).count() == cl.soft(image, k=32, count_stop=True).count() == 32


def test_points_of_many_keys_do_not_meet_in_one_batch(spark, make_pixels):
    """A task's Python holds one key at a time: no batch of packed blocks, which grows with the number of keys."""
    image = make_pixels({n: (8, [(i * 3, 255 - i, (i * i + n) % 251, 255) for i in range(64)]) for n in range(3)})
    found = cl.cluster_points(cl.color_points(image, "oklab"), 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan and "CoGroup" not in plan
    assert found.count() == 192

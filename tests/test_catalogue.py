import json
import random

import pytest
from pyspark.sql import functions as F

from tintlake.operators import catalogue as cg
from tintlake.operators import lut, sinks
from tintlake.sources import catalogue as src


def test_slugs(spark):
    names = {"Brand & Tech": "brand-tech", "--multiple---separators--": "multiple-separators", "&&": "", "Été 2": "été-2", "Saved": "saved"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", cg.category_slug("n").alias("s")).collect()} == names


def one_by_one(names, taken):
    """Ids as if each name were saved before the next."""
    import re

    taken, out = set(taken), []
    for name in names:
        base = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "palette"
        candidate, n = base, 1
        while candidate in taken:
            n += 1
            candidate = f"{base}-{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_generated_ids_match_one_by_one(spark, monkeypatch, seed):
    monkeypatch.setattr(cg, "TILE_ROWS", 3)
    rnd = random.Random(seed)
    names = [rnd.choice(["a", "A 2", "a-3", "b!", "??", "a 2 2", "palette 2"]) for _ in range(25)]
    taken = rnd.sample(["a", "a-2", "a-4", "b-2", "palette", "a-2-2", "a-10", "b-01"], 5)
    fresh = spark.createDataFrame(list(enumerate(names)), "seq bigint, name string")
    got = cg.generate_ids(fresh, spark.createDataFrame([(t,) for t in taken], "id string")).orderBy("seq").collect()
    assert [r.id for r in got] == one_by_one(names, taken)


def test_parse_catalogues(spark):
    good = {"schema": sinks.SCHEMA_NAME, "palettes": [{"id": "a", "name": "A", "categories": ["X"], "colors": ["#fff"]}]}
    docs = {
        "good": json.dumps(good),
        "no schema": json.dumps({"palettes": good["palettes"]}),
        "other schema": json.dumps({**good, "schema": "v0"}),
        "extra key": json.dumps({**good, "version": 1}),
        "extra palette key": json.dumps({"palettes": [{**good["palettes"][0], "mood": "x"}]}),
        "empty": json.dumps({"palettes": []}),
        "broken": "{",
    }
    rows, bad = src.parse_catalogues(spark.createDataFrame(list(docs.items()), "doc string, text string"))
    assert {(r.doc, r.pos, r.id, tuple(r.colors), tuple(r.tags)) for r in rows.collect()} == {(d, 0, "a", ("#fff",), ()) for d in ("good", "no schema")}
    assert {r.doc: r.error for r in bad.collect()} == {
        "other schema": "unsupported schema", "extra key": "unknown field", "extra palette key": "unknown field", "empty": "no palettes", "broken": "malformed",
    }


def test_round_trip_file(spark, tmp_path):
    path = tmp_path / "cat.json"
    path.write_text(json.dumps({"palettes": [{"id": "a", "name": "A", "categories": ["X"], "colors": ["red", "#00f"]}]}, indent=2))
    rows, bad = src.read_catalogue(spark, str(path))
    assert bad.isEmpty()
    slots = cg.palette_slots(rows).orderBy("ord").collect()
    assert [(r.r, r.g, r.b, r.source) for r in slots] == [(255, 0, 0, "library:a"), (0, 0, 255, "library:a")]


def test_missing_file_falls_back(spark, tmp_path):
    default = spark.createDataFrame([("d",)], "id string")
    assert cg.load_or_default(spark, str(tmp_path / "none.json"), default).first().id == "d"


def test_families_advance_together(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(cg, "_numbered", lambda *a, f=cg._numbered: rounds.append(1) or f(*a))
    names = [n for k in range(200) for n in (f"fam{k}x", f"fam{k}x", f"fam{k}x 2")]
    df = spark.createDataFrame(list(enumerate(names)), "seq bigint, name string")
    taken = spark.createDataFrame([("fam3x",)], "id string")
    got = [r.id for r in cg.generate_ids(df, taken).orderBy("seq").collect()]
    assert got == one_by_one(names, {"fam3x"}) and len(rounds) <= 4


def test_external_catalogue_is_whole_or_refused(spark, tmp_path):
    default = spark.createDataFrame([("d", "D")], "id string, name string")
    for name, text in (("good", '{"palettes": [{"id": "a", "name": "A", "categories": ["X"], "colors": ["red"]}]}'), ("bad", '{"broken')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(text)
    loaded = cg.load_or_default(spark, str(tmp_path / "good"), default)
    assert loaded.columns == default.columns and [tuple(r) for r in loaded.collect()] == [("a", "A")]
    with pytest.raises(ValueError):
        cg.load_or_default(spark, str(tmp_path / "bad"), default)


def test_large_palette_is_published_whole(spark):
    slots = spark.range(70_000).selectExpr("1L as palette_id", "cast(id as int) as ord", "cast(id % 256 as int) as r", "cast(id div 256 % 256 as int) as g", "cast(id % 7 as int) as b", "255 as a")
    assert json.loads(sinks.envelopes(slots).first().document)["result"]["palette"]["size"] == 70_000
    assert sinks.design_tokens(slots, formats=["plain"]).first().text.count("\n") == 70_000
    assert lut.grade_lattice(slots, 2).count() == 8


def test_invalid_ramps_give_error_rows(spark):
    from tintlake.operators import gradient

    ramps = {1: [0, 0.5, 1], 2: [0, 0.7, 0.5, 1], 3: [0.2, 0.5, 1], 4: [0]}
    rows = [(k, i, 10 * i, 0, 0, float(p)) for k, ps in ramps.items() for i, p in enumerate(ps)]
    stops = spark.createDataFrame(rows, "ramp_id bigint, ord int, r int, g int, b int, pos double")
    out = gradient.ramps(stops, 11).collect()
    assert sorted(r.ord for r in out if r.ramp_id == 1) == list(range(11)) and all(r.error is None for r in out if r.ramp_id == 1)
    assert {r.ramp_id for r in out if r.error} == {2, 3, 4} and len(out) == 14


def test_unknown_category(spark):
    df = spark.createDataFrame([(0, "a", ["X"], ["t"])], "pos bigint, id string, categories array<string>, tags array<string>")
    assert cg.list_palettes(df, "x", "T").count() == 1
    with pytest.raises(ValueError):
        cg.list_palettes(df, "nope")


def test_identity_lattice_and_application(spark, make_pixels):
    ids = spark.createDataFrame([(1,)], "palette_id bigint")
    lattice = lut.identity_lattice(ids, 5)
    want = [round(i / 4 * 255 + 1e-9) for i in range(5)]
    for r in lattice.collect():
        assert (r.r, r.g, r.b) == (want[r.node % 5], want[r.node // 5 % 5], want[r.node // 25])
    pixels = make_pixels({1: (3, [(0, 0, 0, 255), (255, 255, 255, 255), (10, 99, 201, 255), (63, 64, 65, 255)])})
    assigned = spark.createDataFrame([(1, 1, 4)], "image_id bigint, palette_id bigint, n_total bigint")
    graded = lut.apply_lattice(pixels, assigned, lattice).join(pixels, ["image_id", "idx"]).collect()
    assert len(graded) == 4
    assert all(abs(r[f"out_{c}"] - r[c]) <= 1 for r in graded for c in "rgb")


def test_idle_methods_keep_identity(spark):
    pal = spark.createDataFrame([(1, 0, 20, 140, 150), (1, 1, 230, 120, 40)], "palette_id bigint, ord int, r int, g int, b int")
    plain = {tuple(r) for r in lut.identity_lattice(pal.select("palette_id").distinct(), 4).collect()}
    assert {tuple(r) for r in lut.knn_lattice(pal, 4, intensity=0).collect()} == plain
    assert {tuple(r) for r in lut.rbf_lattice(pal, 4, strength=0).collect()} == plain
    assert {tuple(r) for r in lut.grade_lattice(pal, 4, compression=0, mute=0).collect()} == plain
    grey = spark.createDataFrame([(1, 0, 9, 9, 9)], "palette_id bigint, ord int, r int, g int, b int")
    assert {tuple(r) for r in lut.grade_lattice(grey, 4).collect()} == plain


def test_envelope_members(spark):
    slots = spark.createDataFrame([(1, 0, 255, 0, 0, 255), (1, 1, 0, 0, 255, 128)], "palette_id bigint, ord int, r int, g int, b int, a int")
    doc = json.loads(sinks.envelopes(slots).first().document)
    assert set(doc) == {"schema", "result"}
    first, second = doc["result"]["palette"]["colors"]
    assert first == {"hex": "#ff0000", "rgb": [255, 0, 0], "hsl": [0, 100, 50], "hsv": [0, 100, 100], "oklch": [63, 26, 29]}
    assert second["rgba"] == [0, 0, 255, 128] and second["hex"] == "#0000ff80"


def test_writes(spark, tmp_path):
    slots = spark.createDataFrame([(1, 0, 255, 0, 0, 255), (2, 0, 0, 0, 255, 255)], "palette_id bigint, ord int, r int, g int, b int, a int")
    sinks.write_documents(sinks.design_tokens(slots), str(tmp_path / "tokens"), "text", by="format")
    css = spark.read.json(str(tmp_path / "tokens" / "format=css"))
    assert {(r.palette_id, "--color-1: #ff0000;" in r.document) for r in css.collect()} == {(1, True), (2, False)}
    lattice = lut.identity_lattice(slots.select("palette_id").distinct(), 2)
    sinks.write_lattices(lattice, str(tmp_path / "luts"))
    lines = [line for f in (tmp_path / "luts").glob("bucket=*/*.txt") for line in f.read_text().splitlines()]
    part = [line.split("\t")[1] for line in lines if line.startswith("1\t")]
    assert part[0] == "LUT_3D_SIZE 2" and part[1] == "0.000000 0.000000 0.000000" and part[2] == "1.000000 0.000000 0.000000" and len(part) == 9


def test_lattice_jobs_equal_single_lattices(spark):
    rows = [(p, i, (p * 71 + i * 97) % 256, (p * 13 + i * 53) % 256, (i * 151) % 256) for p in (1, 2) for i in range(4)]
    palettes = spark.createDataFrame(rows, "palette_id bigint, ord int, r int, g int, b int")
    names = ("job_id", "palette_id", "method", "size", "radius", "distribution", "intensity", "reach", "sharpness", "strength", "compression", "mute")
    jobs = [
        (10, 1, "", 3, 0.4, 0.15, 0.9, 1.0, 1.0, 1.0, 0.0, 0.0), (11, 1, "knn", 4, 0.0, 0.3, 0.5, 1.0, 1.0, 1.0, 0.0, 0.0), (12, 2, "rbf", 3, 0.1, 0.1, 0.1, 0.2, 2.0, 0.9, 0.0, 0.0),
        (13, 1, "rbf", 5, 0.1, 0.1, 0.1, 0.3, 1.5, 0.7, 0.0, 0.0), (14, 2, "grade", 4, 0.1, 0.1, 0.1, 1.0, 1.0, 1.0, 0.7, 0.3), (15, 1, "grade", 3, 0.1, 0.1, 0.1, 1.0, 1.0, 1.0, 0.0, 0.0),
        (16, 1, "rbf", 3, 0.1, 0.1, 0.1, -1.0, 1.0, 1.0, 0.0, 0.0), (17, 1, "none", 3, 0.1, 0.1, 0.1, 1.0, 1.0, 1.0, 0.0, 0.0),
    ]
    table = spark.createDataFrame(jobs, "job_id int, palette_id bigint, method string, size int, " + ", ".join(f"{n} double" for n in names[4:]))
    made, refused = lut.run_jobs(palettes, table)
    got = {}
    for r in made.collect():
        got.setdefault(r.job_id, set()).add(tuple(r)[1:])
    assert {r.job_id for r in refused.collect()} == {16, 17} and set(got) == set(range(10, 16))
    for job in jobs[:6]:
        j = dict(zip(names, job))
        method = j["method"] or "knn"
        knobs = {k: j[k] for k in lut.KNOBS[method]}
        one = lut.make_lattice(palettes.filter(F.col("palette_id") == j["palette_id"]), method, size=j["size"], **knobs)
        assert got[j["job_id"]] == {tuple(r)[1:] for r in one.select("palette_id", "size", "node", "r", "g", "b").collect()}


def test_appended_rows_of_a_small_file_are_spread_over_tasks(spark):
    rows = [(i, f"n{i % 3}", " d ", ["x"], ["t"], ["RED", "#0f0"] if i % 5 else ["#12345"]) for i in range(200)]
    schema = "seq bigint, name string, description string, categories array<string>, tags array<string>, colors array<string>"
    fresh = spark.createDataFrame(rows, schema).coalesce(1)
    empty = spark.createDataFrame([], "pos bigint, " + schema.split(", ", 1)[1] + ", id string").select("pos", "id", "name", "description", "categories", "tags", "colors")
    grown, refused = cg.append(empty, fresh)
    assert refused.rdd.getNumPartitions() > 1
    assert refused.count() == 40
    got = {r.pos: (r.id, r.colors) for r in grown.collect()}
    wanted = one_by_one([f"n{i % 3}" for i in range(200) if i % 5], [])
    assert [got[i][0] for i in range(200) if i % 5] == wanted
    assert {tuple(c) for _, c in got.values()} == {("#ff0000", "#00ff00")}

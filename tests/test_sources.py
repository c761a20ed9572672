import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tintlake.sources import images as im
from tintlake.sources import lists
from tintlake.sources import rasters as rs


def png(width, height, pixels, alpha):
    """Smallest PNG writer: one filter byte per row, true colour with or without alpha."""
    n = 4 if alpha else 3
    raw = b"".join(b"\0" + b"".join(bytes(p[:n]) for p in pixels[y * width : (y + 1) * width]) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


PIXELS = [(255, 0, 0, 255), (0, 255, 0, 255), (1, 2, 3, 255), (200, 100, 50, 255), (9, 8, 7, 255), (77, 66, 55, 255)]


def test_image_scan(spark, tmp_path):
    (tmp_path / "rgb.png").write_bytes(png(3, 2, PIXELS, False))
    clear = [*PIXELS[:5], (50, 60, 70, 0)]
    (tmp_path / "rgba.png").write_bytes(png(3, 2, clear, True))
    (tmp_path / "junk.png").write_bytes(b"not an image")
    images = im.read_images(spark, str(tmp_path))
    got = {}
    for r in im.image_pixels(images).orderBy("image_id", "idx").collect():
        got.setdefault(r.image_id.rsplit("/", 1)[1], []).append((r.x, r.y, r.r, r.g, r.b, r.a))
    assert got["rgb.png"] == [(i % 3, i // 3, *p) for i, p in enumerate(PIXELS)]
    want = [*PIXELS[:5], (0, 0, 0, 0)]
    assert got["rgba.png"] == [(i % 3, i // 3, *p) for i, p in enumerate(want)]
    report = {r.image_id.rsplit("/", 1)[1]: r.error for r in im.scan_report(spark, str(tmp_path), images).collect()}
    assert report == {"rgb.png": None, "rgba.png": None, "junk.png": "cannot decode"}
    limit = (tmp_path / "rgb.png").stat().st_size
    small = im.read_images(spark, str(tmp_path), max_bytes=limit)
    kept = {r.image_id.rsplit("/", 1)[1] for r in im.image_pixels(small).select("image_id").distinct().collect()}
    report = {r.image_id.rsplit("/", 1)[1]: r.error for r in im.scan_report(spark, str(tmp_path), small, max_bytes=limit).collect()}
    assert kept == {k for k, error in report.items() if error is None} and "rgb.png" in kept


def test_bands_of_a_large_image(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(im, "BAND_PIXELS", 10)
    pixels = [((7 * i) % 256, (11 * i) % 256, (200 + i) % 256, 255) for i in range(7 * 9)]
    (tmp_path / "a.png").write_bytes(png(7, 9, pixels, False))
    rows = im.image_pixels(im.read_images(spark, str(tmp_path))).orderBy("idx").collect()
    assert [(r.idx, r.x, r.y, r.r, r.g, r.b, r.a) for r in rows] == [(i, i % 7, i // 7, *p) for i, p in enumerate(pixels)]


def test_inline_images(spark):
    data = base64.b64encode(b"hello").decode()
    cases = {
        f"data:image/png;base64,{data}": (b"hello", None),
        f"data:image/png,{data}": (None, "payload is not base64"),
        "data:image/png;base64": (None, "no comma before the payload"),
        "data:;base64,***": (None, "payload cannot be decoded"),
        "data:;base64," + base64.b64encode(b"x" * 50).decode(): (None, "payload above 20 bytes"),
    }
    rows = im.inline_images(spark.createDataFrame([(u,) for u in cases], "uri string"), max_bytes=20).collect()
    assert {r.uri: (bytes(r.content) if r.content else None, r.error) for r in rows} == cases


def test_color_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("  #fff \n\n# note\n#\n// x\n#123\nred\n#\tt\n")
    assert [r.raw for r in lists.read_color_list(spark, str(tmp_path / "list.txt")).collect()] == ["#fff", "#123", "red"]
    (tmp_path / "none.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        lists.read_color_list(spark, str(tmp_path / "none.txt"))


def test_pixel_tables_prune_columns(spark, tmp_path):
    df = spark.range(3).selectExpr("id image_id", "id idx", "0 x", "0 y", "1 r", "2 g", "3 b", "255 a", "'big' note")
    df.write.parquet(str(tmp_path / "p"))
    df.drop("note").write.csv(str(tmp_path / "c"), header=True)
    back = im.read_pixels(spark, str(tmp_path / "p"))
    assert back.columns == im.PIXEL_COLUMNS
    assert im.read_pixels(spark, str(tmp_path / "c"), "csv").agg(F.sum("b")).first()[0] == 9


def bmp(width, height, pixels, bits, top_down=False):
    """Raster of 24 bits, or of 32 bits whose fourth byte means nothing."""
    n = bits // 8
    rows = [b"".join(bytes((p[2], p[1], p[0], 17)[:n]) for p in pixels[y * width : (y + 1) * width]) for y in range(height)]
    rows = [row + bytes(-len(row) % 4) for row in (rows if top_down else rows[::-1])]
    head = struct.pack("<IiiHHIIiiII", 40, width, -height if top_down else height, 1, bits, 0, 0, 0, 0, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + sum(map(len, rows)), 0, 0, 54) + head + b"".join(rows)


def colours_of(rows):
    got = {}
    for r in rows.orderBy("image_id", "idx").collect():
        got.setdefault(str(r.image_id).rsplit("/", 1)[-1], []).append((r.idx, r.x, r.y, r.r, r.g, r.b, r.a))
    return got


def test_rasters_by_byte_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rs, "BAND_PIXELS", 20)
    pixels = [((7 * i) % 256, (11 * i) % 256, (200 + i) % 256) for i in range(7 * 9)]
    files = {f"{bits}{top}.bmp": bmp(7, 9, pixels, bits, top) for bits in (24, 32) for top in (True, False)}
    files |= {"junk.bmp": b"not a raster", "empty.bmp": b"", "short.bmp": files["24True.bmp"][:-1], "_left.bmp": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = [(i, i % 7, i // 7, *p, 255) for i, p in enumerate(pixels)]
    for split in (10, 55, 1 << 20):
        bands = rs.read_rasters(spark, str(tmp_path), split)
        got = colours_of(im.band_pixels(bands))
        assert got == {name: want for name in files if name[0] in "23"}
        errors = {r.image_id.rsplit("/", 1)[1]: r.error for r in bands.filter("error is not null").collect()}
        assert errors == {"junk.bmp": rs.NOT_A_RASTER, "empty.bmp": rs.NOT_A_RASTER, "short.bmp": rs.TRUNCATED}
    assert rs.read_rasters(spark, str(tmp_path), 55).rdd.getNumPartitions() > 10
    assert rs.read_rasters(spark, str(tmp_path / "24True.bmp")).filter("error is null").count() == 5
    (tmp_path / "none").mkdir()
    assert rs.read_rasters(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([*files.items(), ("null", None)], "uri string, content binary")
    bands = rs.payload_bands(rows, "uri", "content")
    assert colours_of(im.band_pixels(bands)) == {name: want for name in files if name[0] in "23"}
    assert bands.filter("error is not null").count() == 5


def test_written_rasters(spark, tmp_path, make_pixels):
    clear = [*PIXELS[:5], (0, 0, 0, 0)]
    table = make_pixels({1: (3, clear), 2: (2, PIXELS)}).selectExpr("*", "if(image_id = 1, 3, 2) w", "if(image_id = 1, 2, 3) h")
    files = rs.write_rasters(table.filter("not (image_id = 2 and idx = 5)").withColumn("image_id", F.col("image_id").cast("string")).unionByName(table.withColumn("image_id", F.concat(F.lit("a/"), "image_id"))), str(tmp_path / "out"))
    assert {(r.name, r.bytes) for r in files.collect()} == {("1.bmp", 146), ("2.bmp", 142), ("a%2F1.bmp", 146), ("a%2F2.bmp", 146)}
    bands = rs.read_rasters(spark, str(tmp_path / "out"))
    got = colours_of(im.band_pixels(bands))
    assert got["1.bmp"] == got["a%2F1.bmp"] == [(i, i % 3, i // 3, *p) for i, p in enumerate(clear)]
    assert got["a%2F2.bmp"] == [(i, i % 2, i // 2, *p) for i, p in enumerate(PIXELS)]
    assert [r.error for r in bands.filter("error is not null").collect()] == [rs.TRUNCATED]
    # another decoder sees the same colours
    again = im.image_pixels(im.read_images(spark, str(tmp_path / "out")))
    assert [r[3:6] for r in colours_of(again)["1.bmp"]][:5] == [p[:3] for p in PIXELS[:5]]


def test_bands_are_read_once_and_cut_in_pieces(spark):
    from tintlake.plans.queries_catalogue import _pixels_and_errors

    read = spark.sparkContext.accumulator(0)

    def bands(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    w, h = 50, 5  # 250 pixels, no multiple of a piece
    rows = [(f"{c}.bmp", w, h, c, 0, w * h, bytes(i % 251 + 1 for i in range(w * h * c)), None) for c in (1, 3, 4)]
    rows = [*rows, ("bad.bmp", *[None] * 6, "truncated"), ("none.bmp", w, 0, 3, 0, 0, b"", None)]
    df = spark.createDataFrame(rows, f"image_id string, {rs.BAND_FIELDS}")
    got = _pixels_and_errors(df.mapInArrow(bands, df.schema)).collect()
    assert read.value == len(rows)
    assert [(r.image, r.error, r.idx) for r in got if r.error] == [("bad", "truncated", None)]
    for _, _, _, c, _, n, data, _ in rows[:3]:
        want = [(*(data[i * c + (j if c > 1 else 0)] for j in (2, 1, 0)), data[i * c + 3] if c == 4 else 255) for i in range(n)]
        mine = sorted((r.idx, r.x, r.y, r.r, r.g, r.b, r.a) for r in got if r.image == str(c))
        assert mine == [(i, i % w, i // w, *p) for i, p in enumerate(want)]
    assert {r.image for r in got} == {"1", "3", "4", "bad"}

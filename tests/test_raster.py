import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphledger.operators import detection as de
from glyphledger.operators import raster as ra
from glyphledger.sources import images as im


def raster(spark, arrays):
    rows = [(k, y, x, *(int(v) for v in np.broadcast_to(a[y, x], 3)), 255) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    sizes = [(k, a.shape[1], a.shape[0]) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int"), spark.createDataFrame(sizes, "image_id long, width int, height int")


def as_array(df, column="r"):
    rows = df.select("y", "x", column).collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r[column]
    return out


def card():
    a = np.full((60, 40), 200)
    a[30:51, 4:40] = 20
    a[42:44, 4:20] = 220
    return a


def test_crops_and_edges(spark):
    p, i = raster(spark, [card()])
    q, qi = ra.crop_quadrant(p, i), ra.quadrant_sizes(i)
    assert (as_array(q) == card()[30:, :20]).all()
    bottom = ra.bottom_edge(q, qi)
    assert bottom.first()["bottom_edge"] == 20
    cut = ra.crop_bottom(q, bottom)
    left = ra.left_edge(cut, spark.createDataFrame([(0, 20, 21)], "image_id long, width int, height int"))
    assert left.first()["left_edge"] == 4
    assert as_array(ra.crop_left(cut, left)).shape == (21, 16)
    found = de.detect(de.image_arrays(p, i)).first()
    assert (found["status"], found["bottom_edge"], found["left_edge"]) == ("found", 20, 4)


def test_no_edge_and_small_rasters(spark):
    p, i = raster(spark, [np.full((12, 16), 255), np.arange(35).reshape(5, 7)])
    assert {r["image_id"]: r["status"] for r in de.detect(de.image_arrays(p, i)).collect()}[0] == "no bottom edge"
    empty = spark.createDataFrame([(3, 0, 0)], "image_id long, width int, height int")
    assert de.detect(de.image_arrays(p.limit(0), empty)).first()["status"] == "no bottom edge"
    with pytest.raises(Exception, match="pixels"):
        de.detect(de.image_arrays(p.filter("x != 3"), i)).collect()
    assert as_array(ra.crop_quadrant(p, i).filter("image_id = 1")).shape == (2, 3)
    flat, fi = raster(spark, [np.full((8, 8), 9)])
    assert ra.pattern_profile(flat, fi).count() == 0
    band = ra.find_bands(flat, fi).first()
    assert (band["start_y"], band["band_height"], band["used_enhanced"]) == (7, 1, False)


def test_pixels_that_are_missing(spark):
    p, i = raster(spark, [card()] * 3)
    kept = p.filter("image_id = 0 OR image_id = 1 AND x < 20 AND y >= 30 OR image_id = 2 AND x >= 20")
    full, quarter, none = (r[1:] for r in sorted(map(tuple, de.detect(de.image_arrays(kept.repartition(3), i)).collect())))
    assert full == quarter and full[0] == "found" and none == ("no bottom edge", *[None] * 6)
    with pytest.raises(Exception, match="more than once"):
        de.detect(de.image_arrays(p.unionByName(p.filter("x = 3")), i)).collect()
    flat = [float(v) for v in card().ravel()]
    rows = spark.createDataFrame([(0, 40, 60, flat, flat, flat)], "image_id long, width int, height int, r array<double>, g array<double>, b array<double>")
    assert tuple(de.detect(rows).first())[1:] == full


def test_one_pass_equals_the_steps(spark):
    rng = np.random.default_rng(2)
    arrays = []
    for _ in range(14):
        h, w = (int(n) for n in rng.integers(20, 70, 2))
        a = rng.integers(0, 256, (h, w)) // int(rng.integers(2, 6))
        if rng.random() < 0.7:
            a[int(rng.integers(0, h))] = 240
        arrays.append(a)
    p, i = raster(spark, arrays)
    quarter, q = ra.crop_quadrant(p, i), ra.quadrant_sizes(i)
    bottom = ra.bottom_edge(quarter, q).filter("bottom_edge IS NOT NULL")
    cut = ra.crop_bottom(quarter, bottom)
    c = q.join(bottom, "image_id").select("image_id", "width", (F.col("bottom_edge") + 1).cast("int").alias("height"))
    left = ra.left_edge(cut, c).filter("left_edge IS NOT NULL")
    card = ra.crop_left(cut, left).persist()
    k = c.join(left, "image_id").select("image_id", (F.col("width") - F.col("left_edge")).cast("int").alias("width"), "height")
    foil = ra.foil_vote(ra.image_stats(card)).select("image_id", "is_foil")
    want = bottom.join(left, "image_id", "left").join(foil, "image_id", "left").join(ra.find_bands(card, k).drop("score"), "image_id", "left")
    columns = ["image_id", "bottom_edge", "left_edge", "is_foil", "start_y", "band_height", "used_enhanced"]
    got = de.detect(de.image_arrays(p.repartition(3), i)).filter("bottom_edge IS NOT NULL")
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.select(*columns).collect())))
    assert rows(got) == rows(want) and got.count() > 3


def test_peaks_and_consensus(spark):
    a = np.full((60, 20), 20)
    a[40] = 120
    p, i = raster(spark, [a])
    assert [r["y"] for r in ra.brightness_peaks(ra.brightness_profile(p, i)).collect()] == [40]
    edges, patterns = spark.createDataFrame([(0, 39), (0, 0)], "image_id long, y int"), spark.createDataFrame([(0, 20)], "image_id long, y int")
    peaks = spark.createDataFrame([(0, 40), (0, 10)], "image_id long, y int")
    assert {r["y"]: r["score"] for r in ra.consensus(peaks, edges, patterns).collect()} == {40: 2, 10: 2}
    best = ra.text_bands(ra.consensus(peaks, edges, patterns), i).first()
    assert (best["start_y"], best["band_height"], best["used_enhanced"]) == (10, 4, True)


@pytest.mark.parametrize("k", range(8))
def test_foil_votes(spark, k):
    signs = [(20.0, 10.0)[k & 1 == 0], (0.5, 0.1)[k & 2 == 0], (0.1, 0.5)[k & 4 == 0]]
    row = spark.createDataFrame([(0, 120.0, signs[0], 0.1, signs[2], signs[1])], "image_id long, avg_brightness double, color_variance double, bright_ratio double, dark_ratio double, midtone_ratio double")
    assert ra.foil_vote(row).first()["is_foil"] == (bin(k).count("1") >= 2)


def test_point_operations(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 64, 128, 129, 255)], "g double")
    assert [r[0] for r in df.select(ra.prep_normal(F.col("g"))).collect()] == [255, 255, 127, 124, 0]  # halves to even: 127, 124.5
    for brightness, t in ((150.0, 160), (90.0, 100), (120.0, 128)):
        want = []
        for g in (0, 64, 128, 129, 255):
            e = 128 + (g - t) * (127 / (255 - t)) * 1.8 if g > t else g / t * 128 * 0.6
            want.append(float(np.round(255 - min(255, max(0, e)))))
        assert [r[0] for r in df.select(ra.prep_foil(F.col("g"), F.lit(brightness))).collect()] == want
    assert [r[0] for r in df.select(ra.contrast(F.col("g"))).collect()] == [0, 0, 128, 130, 255]


def test_stencils_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (9, 11))
    p, i = raster(spark, [a])
    sharp = as_array(ra.sharpen(p))
    want = a.astype(float).copy()
    for y in range(1, 8):
        for x in range(1, 10):
            want[y, x] = np.clip(10 * a[y, x] - a[y - 1 : y + 2, x - 1 : x + 2].sum(), 0, 255)
    assert (sharp == want).all()
    g = a.astype(float)
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    s = {(r["y"], r["x"]): (r["gx"], r["gy"]) for r in ra.sobel(p).collect()}
    assert len(s) == 7 * 9
    for (y, x), (gx, gy) in s.items():
        w = g[y - 1 : y + 2, x - 1 : x + 2]
        assert abs(gx - (w * kx).sum()) < 1e-6 and abs(gy - (w * kx.T).sum()) < 1e-6
    for r in ra.local_variance(p).collect():
        w = g[max(0, r["y"] - 1) : r["y"] + 2, max(0, r["x"] - 1) : r["x"] + 2]
        assert abs(r["variance"] - w.var()) < 1e-6
    assert as_array(ra.upscale(p)).shape == (18, 22)
    compat = as_array(ra.sharpen(p, compat=True), "g")
    assert (compat[1:-1, 1:-1] == want[1:-1, 1:-1]).all()


def test_binary_form(spark):
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(5 * 4 * 4))
    images = spark.createDataFrame([(1, 5, 4, data), (2, 0, 0, b"")], "image_id long, width int, height int, data binary")
    p = im.pixels_of(images)
    assert p.count() == 20 and tuple(p.filter("y = 1 AND x = 2").first())[3:] == tuple(data[28:32])
    a = {r["y"]: r["value"] for r in ra.brightness_profile(p, images).collect()}
    b = {r["y"]: r["value"] for r in im.brightness_profile_binary(images).collect()}
    assert a.keys() == b.keys() and all(abs(a[y] - b[y]) < 1e-9 for y in a)

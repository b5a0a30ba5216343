"""Rasters as rows: pixels (image_id, y, x, r, g, b, a) and images (image_id, width, height).

Stencils are separable: each is a window along x, then one along y, both within
an image; ``by_image`` deals the pixels by image once, which serves both windows
and what is aggregated after them.  Values stay doubles until they are stored,
where they are clamped and rounded half to even.  All steps of a detection in
one pass are in detection.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DARK, EDGE_SHARE = 100, 0.6
SOBEL_THRESHOLD = 50
BLOCK = 8


def luma(r: Column, g: Column, b: Column) -> Column:
    """IMG1."""
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def with_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", luma(F.col("r"), F.col("g"), F.col("b")))


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))


def store(v: Column) -> Column:
    """A value as a byte of a raster: clamped, halves to even."""
    return F.bround(clamp(v), 0)


def by_image(pixels: DataFrame) -> DataFrame:
    """Pixels dealt by image: windows by (image, row) and by (image, column) need no other exchange."""
    return pixels.repartition("image_id")


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def with_size(pixels: DataFrame, images: DataFrame) -> DataFrame:
    return pixels.join(images.select("image_id", "width", "height"), "image_id")


# Crops.  Each returns pixels with coordinates of the new raster.


def crop_quadrant(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """IMG2: the lower left quarter; an odd height loses its last row, an odd width its middle column."""
    top = F.floor(F.col("height") / 2)
    rows = with_size(pixels, images).filter((F.col("x") < F.floor(F.col("width") / 2)) & (F.col("y") >= top) & (F.col("y") < 2 * top))
    return rows.withColumn("y", (F.col("y") - top).cast("int")).drop("width", "height")


def quadrant_sizes(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.floor(F.col("width") / 2).cast("int").alias("width"), F.floor(F.col("height") / 2).cast("int").alias("height"))


def crop_bottom(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """IMG3: rows down to the bottom edge (image_id, bottom_edge)."""
    return pixels.join(edges.select("image_id", "bottom_edge"), "image_id").filter("y <= bottom_edge").drop("bottom_edge")


def crop_left(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """IMG4: columns from the left edge (image_id, left_edge) on."""
    return pixels.join(edges.select("image_id", "left_edge"), "image_id").filter("x >= left_edge").withColumn("x", (F.col("x") - F.col("left_edge")).cast("int")).drop("left_edge")


def crop_band(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """IMG5: the rows of a band (image_id, start_y, band_height)."""
    rows = pixels.join(bands.select("image_id", "start_y", "band_height"), "image_id").filter("y >= start_y AND y < start_y + band_height")
    return rows.withColumn("y", (F.col("y") - F.col("start_y")).cast("int")).drop("start_y", "band_height")


# Point operations.


def prep_normal(gray: Column) -> Column:
    """IMG7."""
    return F.bround(F.lit(255.0) - clamp((gray - 128) * 2.5 + 128), 0)


def prep_foil(gray: Column, brightness: Column) -> Column:
    """IMG8, by the average brightness of the card."""
    t = F.when(brightness > 140, 160.0).when(brightness < 100, 100.0).otherwise(128.0)
    bright = F.lit(128.0) + (gray - t) * (F.lit(127.0) / (F.lit(255.0) - t)) * 1.8
    return F.bround(F.lit(255.0) - clamp(F.when(gray > t, bright).otherwise(gray / t * 128 * 0.6)), 0)


def prepare_for_reading(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """IMG9: r, g, b of each pixel prepared as its card is foil or not; stats has is_foil and avg_brightness."""
    rows = with_gray(pixels).join(stats.select("image_id", "is_foil", "avg_brightness"), "image_id")
    v = F.when(F.col("is_foil"), prep_foil(F.col("gray"), F.col("avg_brightness"))).otherwise(prep_normal(F.col("gray")))
    return rows.withColumns({"r": v, "g": v, "b": v}).drop("gray", "is_foil", "avg_brightness")


def contrast(c: Column) -> Column:
    """IMG10."""
    return store((c - 128) * 2 + 128)


def invert(c: Column) -> Column:
    """IMG11."""
    return F.lit(255.0) - c


def sharpen(pixels: DataFrame, channels=("r", "g", "b"), compat: bool = False) -> DataFrame:
    """IMG12: nine times a pixel less its eight neighbours; border pixels stay.

    compat reproduces a known slip: green is computed from blue, and blue from
    the next pixel's red (for the last pixel of a row the next row's first; the
    very last pixel's is stored as zero).
    """
    x = Window.partitionBy("image_id", "y").orderBy("x")
    y = Window.partitionBy("image_id", "x").orderBy("y")
    lines = Window.partitionBy("image_id").orderBy("y", "x")
    out = by_image(pixels)
    source = {c: c for c in channels}
    if compat:
        out = out.withColumn("next_r", F.lead("r").over(lines))
        source = {"r": "r", "g": "b", "b": "next_r"}
    for c in channels:
        s = source[c]
        out = out.withColumn(f"{c}_row", F.lag(s).over(x) + F.col(s) + F.lead(s).over(x))
    for c in channels:
        total = F.lag(f"{c}_row").over(y) + F.col(f"{c}_row") + F.lead(f"{c}_row").over(y)
        out = out.withColumn(f"{c}_new", F.col(source[c]) * 10 - total)
    inner = F.lag("x").over(x).isNotNull() & F.lead("x").over(x).isNotNull() & F.lag("y").over(y).isNotNull() & F.lead("y").over(y).isNotNull()
    out = out.withColumn("inner", inner)
    out = out.withColumns({c: F.when(F.col("inner"), store(F.coalesce(F.col(f"{c}_new"), F.lit(0)).cast("double"))).otherwise(F.col(c).cast("double")) for c in channels})
    return out.select(*pixels.columns)


def upscale(pixels: DataFrame) -> DataFrame:
    """IMG13: each pixel twice as wide and high."""
    four = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])
    grown = pixels.withColumn("d", F.explode(four))
    return grown.withColumns({"y": F.col("y") * 2 + F.col("d.dy"), "x": F.col("x") * 2 + F.col("d.dx")}).drop("d")


def preprocess(pixels: DataFrame, technique: str) -> DataFrame:
    """IMG14: a technique by name; an unknown one leaves the raster as it is."""
    channels = ("r", "g", "b")
    if technique in ("contrast", "invert"):
        f = contrast if technique == "contrast" else invert
        return pixels.withColumns({c: f(F.col(c)) for c in channels})
    return sharpen(pixels) if technique == "sharpen" else upscale(pixels) if technique == "upscale" else pixels


# Aggregates.


def image_stats(pixels: DataFrame) -> DataFrame:
    """AGG1: average luma and colour spread, shares of bright, dark and other pixels."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    spread = F.abs(F.col("r") - mean) + F.abs(F.col("g") - mean) + F.abs(F.col("b") - mean)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = F.col("gray")
    return with_gray(pixels).groupBy("image_id").agg(
        F.avg("gray").alias("avg_brightness"), F.avg(spread).alias("color_variance"), share(g > 180).alias("bright_ratio"), share(g < 75).alias("dark_ratio"), share((g <= 180) & (g >= 75)).alias("midtone_ratio")
    )


def foil_vote(stats: DataFrame) -> DataFrame:
    """AGG2: at least two of three signs."""
    signs = [F.col("color_variance") > 15, F.col("midtone_ratio") > 0.4, (F.col("dark_ratio") < 0.3) & (F.col("bright_ratio") < 0.3)]
    votes = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    return stats.withColumn("votes", votes).withColumn("is_foil", votes >= 2)


def bottom_edge(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """AGG3: the lowest row that is mostly dark at its right end, null without one; a row per image."""
    near = with_size(with_gray(pixels), images).filter(F.col("x") >= F.col("width") - F.greatest(F.lit(3), F.floor(F.col("width") * 0.15)))
    dark = near.groupBy("image_id", "y").agg(F.avg(F.when(F.col("gray") < DARK, 1.0).otherwise(0.0)).alias("share")).filter(F.col("share") > EDGE_SHARE)
    return images.select("image_id").join(dark.groupBy("image_id").agg(F.max("y").alias("bottom_edge")), "image_id", "left")


def left_edge(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """AGG4: the leftmost column that is mostly dark at its lower end, null without one."""
    near = with_size(with_gray(pixels), images).filter(F.col("y") >= F.col("height") - F.greatest(F.lit(3), F.floor(F.col("height") * 0.1)))
    dark = near.groupBy("image_id", "x").agg(F.avg(F.when(F.col("gray") < DARK, 1.0).otherwise(0.0)).alias("share")).filter(F.col("share") > EDGE_SHARE)
    return images.select("image_id").join(dark.groupBy("image_id").agg(F.min("x").alias("left_edge")), "image_id", "left")


def brightness_profile(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """AGG5: average luma of each row over the left four fifths."""
    near = with_size(with_gray(pixels), images).filter(F.col("x") < F.floor(F.col("width") * 0.8))
    return near.groupBy("image_id", "y").agg(F.avg("gray").alias("value"))


def sobel(pixels: DataFrame) -> DataFrame:
    """WIN1: (image_id, y, x, gx, gy) of inner pixels, in two windows."""
    x = Window.partitionBy("image_id", "y").orderBy("x")
    y = Window.partitionBy("image_id", "x").orderBy("y")
    rows = by_image(with_gray(pixels).select("image_id", "y", "x", "gray")).select("image_id", "y", "x", (F.lead("gray").over(x) - F.lag("gray").over(x)).alias("d"), (F.lag("gray").over(x) + 2 * F.col("gray") + F.lead("gray").over(x)).alias("s"))
    both = rows.select("image_id", "y", "x", (F.lag("d").over(y) + 2 * F.col("d") + F.lead("d").over(y)).alias("gx"), (F.lead("s").over(y) - F.lag("s").over(y)).alias("gy"))
    return both.filter("gx IS NOT NULL AND gy IS NOT NULL")


def edge_density(pixels: DataFrame) -> DataFrame:
    """AGG6: share of inner pixels of a row with a strong gradient."""
    strong = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) > SOBEL_THRESHOLD
    return sobel(pixels).groupBy("image_id", "y").agg(F.count_if(strong).alias("edges"), F.avg(F.when(strong, 1.0).otherwise(0.0)).alias("value"))


def local_variance(pixels: DataFrame) -> DataFrame:
    """WIN2, AGG9: population variance over the up to nine neighbours of each pixel, itself included."""
    x = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1)
    y = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    rows = by_image(with_gray(pixels).select("image_id", "y", "x", "gray")).select("image_id", "y", "x", "gray", F.sum("gray").over(x).alias("s"), F.sum(F.col("gray") * F.col("gray")).over(x).alias("q"), F.count("gray").over(x).alias("n"))
    both = rows.select("image_id", "y", "x", "gray", F.sum("s").over(y).alias("s"), F.sum("q").over(y).alias("q"), F.sum("n").over(y).alias("n"))
    mean = F.col("s") / F.col("n")
    return both.select("image_id", "y", "x", "gray", F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("variance"))


def block_likelihood(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """AGG7: (image_id, y, x, contrast, variance, likelihood) of the 8x8 blocks that are looked at.

    Blocks are counted from the bottom and from the left; one that ends at the
    right border is not looked at.
    """
    rows = with_size(local_variance(pixels), images)
    rows = rows.filter((F.col("y") >= F.col("height") % BLOCK) & (F.floor(F.col("x") / BLOCK) * BLOCK < F.col("width") - BLOCK))
    up = F.floor((F.col("height") - 1 - F.col("y")) / BLOCK)
    keyed = rows.withColumn("by", (F.col("height") - BLOCK * (up + 1)).cast("int")).withColumn("bx", (F.floor(F.col("x") / BLOCK) * BLOCK).cast("int"))
    bright = F.count_if(F.col("gray") > 128)
    agg = keyed.groupBy("image_id", "by", "bx").agg(bright.alias("bright"), (F.count(F.lit(1)) - bright).alias("dark"), F.avg("variance").alias("variance"))
    ratio = F.try_divide(F.least("bright", "dark").cast("double"), F.greatest("bright", "dark").cast("double"))
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    likely = half((F.col("contrast") > 0.2) & (F.col("contrast") < 0.8)) + half((F.col("variance") > 200) & (F.col("variance") < 2000))
    return agg.withColumn("contrast", ratio).select("image_id", F.col("by").alias("y"), F.col("bx").alias("x"), "contrast", "variance", likely.alias("likelihood"))


def pattern_profile(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """AGG8: average likelihood of each row of blocks; no rows where there are no blocks."""
    return block_likelihood(pixels, images).groupBy("image_id", "y").agg(F.avg("likelihood").alias("value"))


# Peaks.  A profile is (image_id, y, value).


def _between(profile: DataFrame, margin: float, least: float) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy("y")
    near = profile.withColumn("prev", F.lag("value").over(w)).withColumn("next", F.lead("value").over(w))
    return near.filter((F.col("value") > least) & (F.col("value") > F.col("prev") + margin) & (F.col("value") > F.col("next") + margin)).select("image_id", "y")


def brightness_peaks(profile: DataFrame) -> DataFrame:
    """WIN3."""
    return _between(profile, 10, 30)


def edge_peaks(profile: DataFrame) -> DataFrame:
    """WIN4."""
    return _between(profile, 0, 0.1)


def pattern_peaks(profile: DataFrame) -> DataFrame:
    """WIN5."""
    return profile.filter(F.col("value") > 0.3).select("image_id", "y")


TOLERANCE = 20


def consensus(bright: DataFrame, edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """JOIN3: (image_id, y, score) of each brightness peak: one, and one each for an edge and a pattern peak nearby, not at row zero.

    The peaks of an image meet in buckets of the tolerance's width, three of which hold all that can be near.
    """
    support = edges.filter("y != 0").select("image_id", F.col("y").alias("sy"), F.lit(1).alias("e"), F.lit(0).alias("t"))
    support = support.unionByName(patterns.filter("y != 0").select("image_id", F.col("y").alias("sy"), F.lit(0).alias("e"), F.lit(1).alias("t")))
    support = support.withColumn("bucket", F.floor(F.col("sy") / TOLERANCE))
    reach = bright.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("y") / TOLERANCE) + d for d in (-1, 0, 1)])))
    near = F.abs(F.col("sy") - F.col("y")) < TOLERANCE
    found = reach.join(support, ["image_id", "bucket"], "left").groupBy("image_id", "y").agg(
        F.max(F.when(near, F.col("e")).otherwise(0)).alias("e"), F.max(F.when(near, F.col("t")).otherwise(0)).alias("t")
    )
    return found.select("image_id", "y", (1 + F.col("e") + F.col("t")).alias("score"))


def text_bands(found: DataFrame, images: DataFrame) -> DataFrame:
    """TOPK1, TOPK2, WIN6, WIN7: the best peak's band, else the lowest 15 percent; a band of no rows is none."""
    best = found.groupBy("image_id").agg(F.max(F.struct("score", (-F.col("y")).alias("up"))).alias("b")).select("image_id", (-F.col("b.up")).alias("top"), F.col("b.score").alias("score"))
    rows = images.join(best, "image_id", "left")
    end = F.least(F.col("top") + F.least(F.lit(60), F.floor(F.col("height") * 0.08)), F.col("height"))
    enhanced = (F.coalesce(F.col("top"), F.lit(0)) > 0) & (F.coalesce(end, F.lit(0)) > 0)
    low = F.floor(F.col("height") * 0.15)
    out = rows.select(
        "image_id", F.when(enhanced, F.col("top")).otherwise(F.col("height") - low).cast("int").alias("start_y"), F.when(enhanced, end - F.col("top")).otherwise(low).cast("int").alias("band_height"),
        enhanced.alias("used_enhanced"), F.when(enhanced, F.col("score")).alias("score"),
    )
    return out


def find_bands(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """All of step four for each image."""
    found = consensus(brightness_peaks(brightness_profile(pixels, images)), edge_peaks(edge_density(pixels)), pattern_peaks(pattern_profile(pixels, images)))
    return text_bands(found, images)

"""Pixel arithmetic over rows (img_id, y, x, value): contrast, blur, area resampling, cell means and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.operators.components import components


def clamped(value: Column) -> Column:
    """A byte: halves to even, 0 to 255."""
    return F.least(F.greatest(F.rint(value), F.lit(0)), F.lit(255)).cast("long")


def contrast(value: Column, hundredths: int = 115) -> Column:
    return clamped((value - 128) * hundredths / 100 + 128)


def box_sum(pixels: DataFrame, value: str, radius: int, along: str, across: str, size: int, name: str) -> DataFrame:
    """Sums of 2 * radius + 1 pixels along one axis; beyond the edge the edge pixel counts again."""
    line = Window.partitionBy("img_id", across).orderBy(along)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = F.sum(value).over(line.rowsBetween(-radius, radius))
    missing_low, missing_high = F.greatest(F.lit(radius) - F.col(along), F.lit(0)), F.greatest(F.col(along) + radius - (size - 1), F.lit(0))
    return pixels.withColumn(name, inner + missing_low * F.first(value).over(whole) + missing_high * F.last(value).over(whole))


def box_blur(pixels: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Means of a square around each pixel, cut to whole numbers."""
    rows = box_sum(pixels, "value", radius, "x", "y", width, "_row")
    both = box_sum(rows, "_row", radius, "y", "x", height, "_all")
    return both.withColumn("blur", F.expr(f"_all div {(2 * radius + 1) ** 2}")).drop("_row", "_all")


def unsharp(pixels: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """1.5 times the pixel less an eighth of its four neighbours, inside the image."""
    row, column = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
    around = sum((f("value").over(w) for w in (row, column) for f in (F.lag, F.lead)), F.lit(0))
    inside = F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)
    return pixels.withColumn("sharp", F.when(inside, clamped(1.5 * F.col("value") - 0.125 * around)).otherwise(F.col("value")))


def cell_means(pixels: DataFrame, cell: int) -> DataFrame:
    """Mean of each grid cell, in whole thousandths."""
    at = [F.expr(f"{c} div {cell}").alias(f"cell_{c}") for c in ("y", "x")]
    return pixels.groupBy("img_id", *at).agg(F.expr("1000 * sum(value) div count(*)").alias("mean_milli"))


def nearest_percentile(values: Column, share: float) -> Column:
    """The value at the rounded place (n - 1) * share of the sorted list."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor((F.size(ordered) - 1) * share + 0.5).cast("int"))


def halve(pixels: DataFrame, factor: int = 2) -> DataFrame:
    """Area means of factor by factor pixels, stored as bytes."""
    at = [F.expr(f"{c} div {factor}").alias(c) for c in ("y", "x")]
    return pixels.groupBy("img_id", *at).agg(clamped(F.avg("value")).alias("value"))


def crop(pixels: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    inside = F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def fit_within(width: Column, height: Column, least: int, most: int) -> Column:
    """Size with the longest edge scaled into [least, most], halves upwards, at least one pixel."""
    longest = F.greatest(width, height)
    scale = F.when(longest > most, most / longest).when(longest < least, least / longest).otherwise(F.lit(1.0))
    size = lambda edge: F.greatest(F.floor(edge * scale + 0.5), F.lit(1)).cast("long")
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def labelled(cells: DataFrame) -> DataFrame:
    """Marked cells (img_id, y, x) with their 4-connected component, named by its first cell in reading order."""
    at = cells.select("img_id", F.struct("img_id", "y", "x").alias("id"), "y", "x")
    right = at.select("img_id", "y", (F.col("x") - 1).alias("x"), F.col("id").alias("other"))
    below = at.select("img_id", (F.col("y") - 1).alias("y"), "x", F.col("id").alias("other"))
    ties = at.join(right, ["img_id", "y", "x"]).select("id", "other").union(at.join(below, ["img_id", "y", "x"]).select("id", "other"))
    found = at.join(components(ties.toDF("u", "v")), F.col("id") == F.col("node"), "left")
    return found.select("img_id", "y", "x", F.coalesce("component", "id").alias("component"))


def component_stats(cells: DataFrame) -> DataFrame:
    """Size and box of every component of marked cells."""
    return labelled(cells).groupBy("img_id", "component").agg(F.count("*").alias("cells"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))


def largest_component(cells: DataFrame) -> DataFrame:
    """The largest component of each image; of equals the first in reading order."""
    best = F.max(F.struct("cells", F.struct(-F.col("component.y"), -F.col("component.x")), "left", "top", "right", "bottom")).alias("best")
    return component_stats(cells).groupBy("img_id").agg(best).select("img_id", *(f"best.{c}" for c in ("cells", "left", "top", "right", "bottom")))


# Fixed values of the image stage: white paper after correction, the darkest background that is divided by, the blur's share of
# the longest edge, the share of white below which a background counts as shadow; of the search for paper: the brightness that
# is enough, the share of the white point, the saturation that is too much, covers that are too small and the whole frame, the
# least fill, the fill of a sheet; the confidence from which an image is cropped.
WHITE, DARKEST, BLUR_SHARE, SHADOW = 235, 40, 0.07, 0.7
BRIGHT, WHITE_SHARE, MOST_SATURATION, LEAST_COVER, FULL_COVER, LEAST_FILL, SHEET_FILL = 110, 0.74, 70, 0.04, 0.92, 0.55, 0.72
CROP_CONFIDENCE, LEAST_SIDE = 0.6, 0.15


def illumination(pixels: DataFrame, width: int, height: int, shadow: float | None = SHADOW) -> DataFrame:
    """Each pixel by what its surroundings let white paper be; with `shadow`, only where they are darker than that share of white."""
    radius = max(1, int(max(width, height) * BLUR_SHARE + 0.5))
    rows = box_sum(pixels, "value", radius, "x", "y", width, "_row")
    both = box_sum(rows, "_row", radius, "y", "x", height, "_all")
    ground = F.col("_all") / float((2 * radius + 1) ** 2)
    corrected = clamped(F.col("value") * WHITE / F.greatest(F.lit(float(DARKEST)), ground))
    fine = ground >= WHITE * shadow if shadow is not None else F.lit(False)
    return both.withColumn("even", F.when(fine, F.col("value")).otherwise(corrected)).drop("_row", "_all")


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.299 + green * 0.587 + blue * 0.114


def paper_cells(cells: DataFrame) -> DataFrame:
    """The cells (img_id, y, x, lum, sat) that look like paper: as bright as the image's white point allows, and without colour."""
    white = cells.groupBy("img_id").agg(nearest_percentile(F.collect_list("lum"), 0.95).alias("white"))
    bright = F.greatest(F.lit(float(BRIGHT)), F.col("white") * WHITE_SHARE)
    return cells.join(white, "img_id").where((F.col("lum") >= bright) & (F.col("sat") <= MOST_SATURATION)).drop("white")


def receipt_region(cells: DataFrame, cell: int, width: int, height: int) -> DataFrame:
    """Box, confidence and reason of each image's largest sheet of paper, else the full image; every image has a row."""
    images = cells.select("img_id").distinct()
    found = images.join(largest_component(paper_cells(cells)), "img_id", "left")
    return judged_region(found.withColumns({"image_width": F.lit(width), "image_height": F.lit(height), "cell": F.lit(cell)}))


def judged_region(found: DataFrame) -> DataFrame:
    """What the largest components (img_id, image_width, image_height, cell, cells, left, top, right, bottom; null where there is none)
    are: a sheet, its box with a margin of one cell, or nothing to cut, the full image."""
    cell, width, height = F.col("cell"), F.col("image_width"), F.col("image_height")
    cover = F.col("cells") / (F.floor(width / cell) * F.floor(height / cell)).cast("double")
    fill = F.col("cells") / ((F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1))
    none = F.when(F.col("cells").isNull() | (cover < LEAST_COVER), 0.0).when(cover > FULL_COVER, 0.5).when(fill < LEAST_FILL, 0.3)
    sure = F.least(F.lit(0.95), 0.28 + fill * 0.5 + F.least(cover, F.lit(0.4)) * 0.5)
    full = none.isNotNull()
    low = lambda edge: F.greatest(F.lit(0), (F.col(edge) - 1) * cell)
    high = lambda edge, size: F.least(size, (F.col(edge) + 2) * cell)
    box = {"x": F.when(full, 0).otherwise(low("left")), "y": F.when(full, 0).otherwise(low("top")), "to_x": F.when(full, width).otherwise(high("right", width)), "to_y": F.when(full, height).otherwise(high("bottom", height))}
    reason = F.when(full, "full_image").when(fill > SHEET_FILL, "document_boundary").otherwise("text_density")
    told = found.select("img_id", *(v.cast("long").alias(k) for k, v in box.items()), F.coalesce(none, sure).alias("confidence"), reason.alias("reason"))
    return told.select("img_id", "x", "y", (F.col("to_x") - F.col("x")).alias("width"), (F.col("to_y") - F.col("y")).alias("height"), "confidence", "reason")


def crops(confidence: Column, reason: Column) -> Column:
    """Whether a region is sure enough to be cut out."""
    return (confidence >= CROP_CONFIDENCE) & (reason != "full_image")


def cut(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Images (with image_width, image_height) cut to their regions where these are sure enough, with the sizes that are left."""
    sure = regions.where(crops(F.col("confidence"), F.col("reason"))).select("img_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    placed = pixels.join(sure, "img_id", "left").withColumns({"x": F.col("x") - F.coalesce("_x", F.lit(0)), "y": F.col("y") - F.coalesce("_y", F.lit(0)), "image_width": F.coalesce("_w", "image_width"), "image_height": F.coalesce("_h", "image_height")})
    return placed.where(F.col("x").between(0, F.col("image_width") - 1) & F.col("y").between(0, F.col("image_height") - 1)).drop("_x", "_y", "_w", "_h")


def resized(pixels: DataFrame, channels: list[str], new: Column) -> DataFrame:
    """Images (img_id, y, x, channels, image_width, image_height) at the sizes `new` (width, height): each new pixel is the mean of all old
    ones that it touches, as a byte; an image of its own size stays as it is."""

    def targets(at: str, old: str, size: Column) -> Column:
        ratio = F.col(old) / size
        first = F.floor(F.col(at) / ratio).cast("int")
        near = F.sequence(F.greatest(F.lit(0), first - 1), F.least(size.cast("int") - 1, F.floor((F.col(at) + 1) / ratio).cast("int") + 1))
        start = lambda t: F.floor(t * ratio)
        return F.filter(near, lambda t: (F.col(at) >= start(t)) & (F.col(at) < F.greatest(start(t) + 1, F.ceil((t + 1) * ratio))))

    sized = pixels.withColumn("_new", new)
    each = sized.withColumn("_x", F.explode(targets("x", "image_width", F.col("_new.width")))).withColumn("_y", F.explode(targets("y", "image_height", F.col("_new.height"))))
    key = ["img_id", F.col("_y").cast("long").alias("y"), F.col("_x").cast("long").alias("x")]
    return each.groupBy(*key).agg(*(clamped(F.sum(c) / F.count("*")).alias(c) for c in channels), F.first("_new.width").alias("image_width"), F.first("_new.height").alias("image_height"))


def grayed(red: Column, green: Column, blue: Column, hundredths: int = 115) -> Column:
    """A colour as a byte of grey with contrast, rounded once."""
    return clamped((luminance(red, green, blue) - 128) * (hundredths / 100) + 128)


def preprocessed(pixels: DataFrame, least: int = 1900, most: int = 2400, shadows: bool = False, sharp: bool = False) -> DataFrame:
    """Colour images (img_id, y, x, r, g, b, image_width, image_height) resized so that the longest edge lies in [least, most], grey, with
    shadows evened out and sharpened if asked, and with contrast: img_id, y, x, value and the new sizes."""
    found = resized(pixels, ["r", "g", "b"], fit_within(F.col("image_width"), F.col("image_height"), least, most))
    colours = [F.col(c) for c in ("r", "g", "b")]
    if shadows:
        from tabsplit.operators import photo  # which builds on this module

        grey = found.withColumn("value", clamped(luminance(*colours)))
        sizes = grey.select("img_id", "image_width", "image_height").distinct()
        found = photo.pixels_of(photo.evened(photo.grey_strips(grey))).join(sizes, "img_id").withColumn("value", contrast(F.col("value")))
    else:
        found = found.withColumn("value", grayed(*colours)).drop("r", "g", "b")
    return unsharp(found, F.col("image_width"), F.col("image_height")).withColumn("value", F.col("sharp")).drop("sharp") if sharp else found


def normalized(pixels: DataFrame, regions: DataFrame, least: int = 1900, most: int = 2400) -> tuple[DataFrame, DataFrame]:
    """Colour images cut to their regions where these are sure, and preprocessed; and the regions as they were taken: content_region
    where an image was cut, else full_image."""
    told = regions.withColumn("reason", F.when(crops(F.col("confidence"), F.col("reason")), "content_region").otherwise("full_image"))
    return preprocessed(cut(pixels, regions), least, most), told


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def reliable_quad(xs: list[Column], ys: list[Column], width: Column, height: Column) -> Column:
    """Whether four corners lie in the image and span more than LEAST_SIDE of each side."""
    left, right, top, bottom = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    return (right - left > width * LEAST_SIDE) & (bottom - top > height * LEAST_SIDE) & (left >= 0) & (top >= 0) & (right <= width) & (bottom <= height)


def perspective_warp(pixels: DataFrame, quads: DataFrame, width: int, height: int) -> DataFrame:
    """The quadrilaterals (img_id, x0, y0 to x3, y3, clockwise from the top left) as rectangles, by the nearest pixel; an image
    whose quadrilateral isn't reliable stays as it is."""
    at = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)]
    good = reliable_quad([a for a, _ in at], [b for _, b in at], F.lit(width), F.lit(height))
    size = lambda p, q: F.greatest(F.lit(1), F.floor((p + q) / 2 + 0.5)).cast("int")
    sized = quads.where(good).withColumns({"w": size(distance(at[0], at[1]), distance(at[3], at[2])), "h": size(distance(at[0], at[3]), distance(at[1], at[2]))})
    grid = sized.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    u, v = F.when(F.col("w") == 1, 0.0).otherwise(F.col("x") / (F.col("w") - 1)), F.when(F.col("h") == 1, 0.0).otherwise(F.col("y") / (F.col("h") - 1))
    mix = lambda a, b, t: a + (b - a) * t
    nearest = lambda k, edge: F.greatest(F.lit(0), F.least(F.lit(edge - 1), F.floor(mix(mix(at[0][k], at[1][k], u), mix(at[3][k], at[2][k], u), v) + 0.5))).cast("long")
    asked = grid.select("img_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), nearest(0, width).alias("_x"), nearest(1, height).alias("_y"))
    source = pixels.select("img_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "value")
    left = pixels.select("img_id", "x", "y", "value").join(quads.where(good).select("img_id"), "img_id", "left_anti")
    return asked.join(source, ["img_id", "_x", "_y"]).select("img_id", "x", "y", "value").union(left)

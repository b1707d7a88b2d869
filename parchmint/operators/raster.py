"""Raster arithmetic: histograms and thresholds as relations, whole images in NumPy.

A pixel table (image, x, y, v) serves aggregates over many images; image bytes
(8-bit RGBA rows) go through ``prepare_images``, an Arrow batch at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DARK = 128
Keys = Sequence[str]


def luminosity(r: Column, g: Column, b: Column) -> Column:
    return (r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)).cast("int")


def histogram(pixels: DataFrame, keys: Keys, value: str = "g") -> DataFrame:
    return pixels.groupBy(*keys, F.col(value).cast("int").alias("g")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, keys: Keys) -> DataFrame:
    """Per image the first level that best parts dark from light; 127 where all pixels have one level.

    A histogram has at most 256 rows for each image, so its windows are small.
    """
    w = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    t = hist.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(F.col("g") * F.col("n")).over(w), "total": F.sum("n").over(all_), "sum": F.sum(F.col("g") * F.col("n")).over(all_)})
    wf = F.col("total") - F.col("wb")
    apart = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / wf
    t = t.withColumn("between", F.when(wf > 0, F.col("wb").cast("double") * wf.cast("double") * apart * apart))
    best = F.max_by(F.col("g"), F.when(F.col("between").isNotNull(), F.struct(F.col("between"), (-F.col("g")).alias("_t"))))
    return t.groupBy(*keys).agg(F.coalesce(best, F.lit(127)).alias("threshold"))


def row_counts(pixels: DataFrame, keys: Keys) -> DataFrame:
    return pixels.groupBy(*keys, "y").agg(F.count_if(F.col("v") < DARK).alias("dark"))


def projection_variance(pixels: DataFrame, keys: Keys) -> DataFrame:
    """Population variance of the dark pixels of the rows, as mean square less squared mean."""
    return row_counts(pixels, keys).groupBy(*keys).agg((F.avg(F.col("dark") * F.col("dark")) - F.avg("dark") * F.avg("dark")).alias("variance"))


#: Degrees that are tried, with their sines and cosines.
ANGLES = [(k / 2, math.sin(math.radians(k / 2)), math.cos(math.radians(k / 2))) for k in range(-10, 11)]


def turned_rows(pixels: DataFrame, keys: Keys) -> DataFrame:
    """Rows (keys, angle, height, y, dark): dark pixels in each row of an image turned about its centre by each angle.

    Every dark pixel moves to the nearest place; what leaves the image is lost. A shuffle of the dark pixels' counts, not of the pixels.
    """
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    tried = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(s).alias("sin"), F.lit(c).alias("cos")) for a, s, c in ANGLES])
    dark = pixels.where(F.col("v") < DARK).join(size, [*keys]).withColumn("t", F.explode(tried)).select("*", "t.*")
    dx, dy = F.col("x") + F.lit(0.5) - F.col("width") / 2, F.col("y") + F.lit(0.5) - F.col("height") / 2
    x = F.floor(dx * F.col("cos") - dy * F.col("sin") + F.col("width") / 2)
    y = F.floor(dx * F.col("sin") + dy * F.col("cos") + F.col("height") / 2)
    moved = dark.select(*keys, "angle", "width", "height", x.alias("x"), y.alias("y"))
    return moved.where("x >= 0 AND x < width AND y >= 0 AND y < height").groupBy(*keys, "angle", "height", "y").agg(F.count("*").alias("dark"))


def skew_angle(pixels: DataFrame, keys: Keys) -> DataFrame:
    """The angle of each image whose rotation has the sharpest rows: the greatest variance of their dark pixels."""
    rows = turned_rows(pixels, keys)
    mean = F.sum("dark") / F.col("height")
    variances = rows.groupBy(*keys, "angle", "height").agg((F.sum(F.col("dark") * F.col("dark")) / F.col("height") - mean * mean).alias("variance"))
    return best_angle(variances, keys)


def best_angle(variances: DataFrame, keys: Keys) -> DataFrame:
    """The angle of the greatest variance; of equal ones the least."""
    return variances.groupBy(*keys).agg(F.max_by("angle", F.struct("variance", (-F.col("angle")).alias("_a"))).alias("angle"))


def longest_runs(pixels: DataFrame, keys: Keys, along: str, least: int) -> DataFrame:
    """Lines of pixels (rows for along='x') with a dark run of at least ``least``."""
    across = "y" if along == "x" else "x"
    w = Window.partitionBy(*keys, across).orderBy(along)
    island = F.sum((F.col("v") >= DARK).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = pixels.withColumn("_i", island).where(F.col("v") < DARK).groupBy(*keys, across, "_i").agg(F.count("*").alias("run"))
    return runs.groupBy(*keys, across).agg(F.max("run").alias("longest")).where(F.col("longest") >= least)


def merge_runs(positions: DataFrame, keys: Keys, column: str, tolerance: int = 6) -> DataFrame:
    """Rounded means of positions at most ``tolerance`` from the one before."""
    w = Window.partitionBy(*keys).orderBy(column)
    island = F.sum(F.coalesce((F.col(column) - F.lag(column).over(w) > tolerance).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return positions.withColumn("_i", island).groupBy(*keys, "_i").agg(F.floor(F.avg(column) + F.lit(0.5)).alias("centre")).drop("_i")


def gray_of(rgba: np.ndarray) -> np.ndarray:
    return (rgba[..., 0] * 0.299 + rgba[..., 1] * 0.587 + rgba[..., 2] * 0.114).astype(np.uint8)


def threshold_of(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    if not ok.any():
        return 127
    between = np.full(256, -1.0)
    between[ok] = wb[ok] * wf[ok] * (sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]) ** 2
    return int(np.argmax(between))


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre on white ground, by nearest pixels."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x + 0.5 - w / 2, y + 0.5 - h / 2
    sx = np.floor(dx * np.cos(a) + dy * np.sin(a) + w / 2).astype(int)
    sy = np.floor(-dx * np.sin(a) + dy * np.cos(a) + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, image[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255).astype(np.uint8)


def skew_of(image: np.ndarray, rows: int = 350) -> float:
    """The angle from -5 to 5 whose rotation has the sharpest rows, on a copy of ``rows`` rows."""
    h, w = image.shape
    width = max(int(np.floor(w * rows / h + 0.5)), 1)
    small = image[(np.arange(rows) * h // rows)[:, None], (np.arange(width) * w // width)[None, :]]
    scores = [np.var((rotated(small, d) < DARK).sum(axis=1)) for d in np.arange(-5, 5.5, 0.5)]
    return float(-5 + 0.5 * int(np.argmax(scores)))


def rules_of(image: np.ndarray, scale: float) -> tuple[list[float], list[float]] | None:
    """Horizontal and vertical rules in page units; None without two of each."""

    def centres(dark: np.ndarray, least: int) -> list[float]:
        best, run = np.zeros(len(dark), int), np.zeros(len(dark), int)
        for k in range(dark.shape[1]):
            run = (run + 1) * dark[:, k]
            best = np.maximum(best, run)
        found = np.flatnonzero(best >= least) if dark.any() else np.zeros(0, int)
        groups = np.split(found, np.flatnonzero(np.diff(found) > 6) + 1) if len(found) else []
        return [float(np.floor(g.mean() + 0.5)) / scale for g in groups]

    h, w = image.shape
    dark = image < DARK
    across, down = centres(dark, max(int(np.floor(w * 0.20 + 0.5)), 1)), centres(dark.T, max(int(np.floor(h * 0.06 + 0.5)), 1))
    return (across, down) if len(across) > 1 and len(down) > 1 else None


def prepare_images(images: DataFrame, scale: float = 3.0) -> DataFrame:
    """Rows (id, threshold, angle, h_lines, v_lines, image, error) for images (id, width, height, rgba).

    The image is binarised at its own threshold and turned upright; an image whose
    bytes do not fit its size gives an error.
    """
    kind = dict(images.dtypes)["id"]

    def prepare(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    gray = gray_of(np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4))
                    t = threshold_of(gray)
                    binary = np.where(gray > t, 255, 0).astype(np.uint8)
                    angle = skew_of(binary)
                    if abs(angle) >= 0.25:
                        binary = rotated(binary, -angle)
                    rules = rules_of(binary, scale) or (None, None)
                    rows.append((r["id"], t, angle, *rules, binary.tobytes(), None))
                except Exception as e:  # one image must not end the job
                    rows.append((r["id"], None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            types = [batch.schema.field("id").type, pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["id", "threshold", "angle", "h_lines", "v_lines", "image", "error"])

    return images.select("id", "width", "height", "rgba").mapInArrow(prepare, f"id {kind}, threshold int, angle double, h_lines array<double>, v_lines array<double>, image binary, error string")

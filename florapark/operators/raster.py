"""Reading pixel values at points and filling missing pixels from near ones.

A raster is a pixel table (layer, pix_row, pix_col, value) with null for no-data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from florapark.session import ship

PIXEL = ("layer", "pix_row", "pix_col")
FILL_RADIUS = 50
# pixels along the side of a tile, without its rim
TILE = 512
_FAR = 1 << 30


def pixel_of(points: DataFrame, inverse: Sequence[float], height, width, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pixel of each point by the inverse affine transform, moved onto the raster if outside."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in inverse)
    x, y = F.col(lon), F.col(lat)

    def onto(v, n):
        return F.greatest(F.lit(0).cast("bigint"), F.least(n - 1, F.floor(v)))

    return points.withColumns({
        "pix_row": onto(d * x + e * y + f, height), "pix_col": onto(a * x + b * y + c, width)})


def raster_shape(raster: DataFrame):
    """(height, width) as scalar columns."""
    size = raster.agg(F.struct((F.max("pix_row") + 1).alias("h"), (F.max("pix_col") + 1).alias("w")).alias("s"))
    return size.select("s.h").scalar(), size.select("s.w").scalar()


def sample_raster(points: DataFrame, raster: DataFrame, inverse: Sequence[float]) -> DataFrame:
    """Value of every layer at every point; null where the pixel has no data."""
    h, w = raster_shape(raster)
    return pixel_of(points, inverse, h, w).join(raster, ["pix_row", "pix_col"], "left")


def _nearest_in_rows(valid: np.ndarray) -> np.ndarray:
    """Column of the nearest valid pixel in each pixel's own row, the left one on ties; far outside where there is none."""
    h, w = valid.shape
    cols = np.arange(w)
    left = np.maximum.accumulate(np.where(valid, cols, -_FAR), axis=1)
    right = np.minimum.accumulate(np.where(valid, cols, _FAR)[:, ::-1], axis=1)[:, ::-1]
    return np.where(cols - left <= right - cols, left, right)


def _fill_tile(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, wanted: np.ndarray, radius: int) -> pd.DataFrame:
    """Fill of the wanted pixels of a tile from its valid ones: a pass along rows, then one along columns.

    The first pass leaves one candidate per row and column, so the second compares a
    pixel with 2 * radius + 1 candidates instead of all pixels of the disc.
    """
    r0, c0 = rows.min(), cols.min()
    shape = (int(rows.max() - r0) + 1, int(cols.max() - c0) + 1)
    r, c = (rows - r0).astype(np.int64), (cols - c0).astype(np.int64)
    seen = ~wanted
    grid = np.full(shape, np.nan)
    # the smallest value stands for a repeated pixel
    order = np.argsort(-values[seen], kind="stable")
    grid[r[seen][order], c[seen][order]] = values[seen][order]
    valid = np.zeros(shape, bool)
    valid[r[seen], c[seen]] = True
    near = _nearest_in_rows(valid)
    qr, qc = r[wanted], c[wanted]
    best = np.full(len(qr), radius * radius + 1, np.int64)
    at_row, at_col = np.zeros(len(qr), np.int64), np.zeros(len(qr), np.int64)
    for step in range(-radius, radius + 1):
        row = qr + step
        inside = (row >= 0) & (row < shape[0])
        col = near[np.where(inside, row, 0), qc]
        d2 = np.where(inside & (np.abs(col) < _FAR), step * step + (col - qc) ** 2, best)
        nearer = d2 < best  # rows come in order, so ties stay with the smaller one
        best[nearer], at_row[nearer], at_col[nearer] = d2[nearer], row[nearer], col[nearer]
    hit = best <= radius * radius
    return pd.DataFrame({"pix_row": qr[hit] + r0, "pix_col": qc[hit] + c0, "fill": grid[at_row[hit], at_col[hit]]})


def fill_nodata_nearest(sampled: DataFrame, raster: DataFrame, radius: int = FILL_RADIUS) -> DataFrame:
    """Missing values replaced by the nearest pixel with data, at most ``radius`` pixels away.

    The raster is cut into square tiles with a rim of ``radius`` pixels. Only tiles with
    a missing pixel are looked at; a pixel near a border goes to its neighbours too, so
    it moves 1.4 times on average and each tile is filled on its own, by a distance
    transform along rows and then columns. Ties go to the smaller row, then column. A
    tile holds at most ``(side + 2 * radius) ** 2`` pixels.
    """
    side = max(TILE, 2 * radius)
    missing = (
        sampled.where(F.col("value").isNull() & F.col("pix_row").isNotNull() & F.col("pix_col").isNotNull())
        .select(*PIXEL).distinct()
        .withColumns({"_tr": F.floor(F.col("pix_row") / side), "_tc": F.floor(F.col("pix_col") / side)})
    )

    def tiles(name: str):
        return F.sequence(F.floor((F.col(name) - radius) / side), F.floor((F.col(name) + radius) / side))

    tile = ["layer", "_tr", "_tc"]
    around = (
        raster.where(F.col("value").isNotNull()).select(*PIXEL, F.col("value").cast("double").alias("value"))
        .withColumn("_tr", F.explode(tiles("pix_row"))).withColumn("_tc", F.explode(tiles("pix_col")))
        .join(missing.select(*tile).distinct(), tile, "left_semi")
        .withColumn("_wanted", F.lit(False))
    )
    todo = missing.withColumns({"value": F.lit(None).cast("double"), "_wanted": F.lit(True)})

    ship(sampled.sparkSession)

    def fill(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        out = _fill_tile(pixels["pix_row"].to_numpy(), pixels["pix_col"].to_numpy(),
                         pixels["value"].to_numpy(float), pixels["_wanted"].to_numpy(bool), radius)
        out.insert(0, "layer", key[0])
        return out

    layer = sampled.schema["layer"].dataType.simpleString()
    found = todo.unionByName(around).groupBy(*tile).applyInPandas(
        fill, f"layer {layer}, pix_row bigint, pix_col bigint, fill double")
    return (
        sampled.join(found, list(PIXEL), "left")
        .withColumn("filled", F.col("value").isNull() & F.col("fill").isNotNull())
        .withColumn("value", F.coalesce("value", "fill")).drop("fill")
    )


def sampling_report(filled: DataFrame) -> DataFrame:
    """Per layer: points, points on no-data pixels, filled points, points still missing."""
    return filled.groupBy("layer").agg(
        F.count("*").alias("n_points"),
        F.count_if(F.col("filled") | F.col("value").isNull()).alias("n_nodata"),
        F.count_if("filled").alias("n_filled"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )

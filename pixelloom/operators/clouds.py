"""Cloud masks by a predictor that the user brings; none comes with this package."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.model import Rasters
from pixelloom.operators.restructure import resample

_PREDICTORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def register(name: str, predictor: Callable[[np.ndarray], np.ndarray]) -> None:
    """predictor: an array (3, rows, cols) of red, green, near infrared -> an array (rows, cols) of classes."""
    _PREDICTORS[name] = predictor


def cloud_mask(r: Rasters, red: str, green: str, nir: str, predictor: str | Callable[[np.ndarray], np.ndarray] | None = None, down_sample: float | None = None, tile: int = 1024, halo: int = 64) -> DataFrame:
    """image, prow, pcol, value per tile of the image; 0 is nodata. down_sample: a coarser resolution to predict at.

    A tile sees the pixels up to `halo` beyond its border, which its neighbours give it, and keeps what is predicted for its own: a
    predictor that looks no further gives the same for every tile size. Where the image ends, so does the array."""
    f = predictor if callable(predictor) else _PREDICTORS.get(predictor or "")
    if f is None:
        raise ValueError("no predictor is registered; a model has to be brought by the user")
    if down_sample:
        coarse = r.scenes.select("image", "ord", "x0", "y0", F.lit(float(down_sample)).alias("res_x"), F.lit(float(down_sample)).alias("res_y"), F.floor(F.col("width") * F.col("res_x") / down_sample).cast("int").alias("width"), F.floor(F.col("height") * F.col("res_y") / down_sample).cast("int").alias("height"), "dtype", "nodata", "crs")
        r = Rasters(resample(r, coarse, "bilinear").pixels, coarse, r.bands)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tr, tc, height, width = (int(part[c].iloc[0]) for c in ("_r", "_c", "height", "width"))
        r0, c0 = max(0, tr * tile - halo), max(0, tc * tile - halo)
        stack = np.zeros((3, min(height, (tr + 1) * tile + halo) - r0, min(width, (tc + 1) * tile + halo) - c0), np.float32)
        for k, b in enumerate((red, green, nir)):
            stack[k, part.prow - r0, part.pcol - c0] = part[b].fillna(0)
        own = part[(part.prow // tile == tr) & (part.pcol // tile == tc)]
        if own.empty:  # neighbours' pixels alone
            return pd.DataFrame({"image": [], "prow": [], "pcol": [], "value": []}).astype({"image": str, "prow": "int32", "pcol": "int32", "value": "int32"})
        found = np.asarray(f(stack)).reshape(stack.shape[1:])
        return pd.DataFrame({"image": own.image, "prow": own.prow, "pcol": own.pcol, "value": found[own.prow - r0, own.pcol - c0].astype("int32")})

    reach = lambda c, size: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - halo) / tile), F.floor(F.least(F.col(size) - 1, F.col(c) + halo) / tile)))
    p = r.placed("height", "width").select("image", "prow", "pcol", red, green, nir, "height", "width").withColumn("_r", reach("prow", "height")).withColumn("_c", reach("pcol", "width"))
    return p.groupBy("image", "_r", "_c").applyInPandas(run, "image string, prow int, pcol int, value int")

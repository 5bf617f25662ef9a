"""Heat on small grids, as arrays of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_attention(heads: Column, n_patches: int) -> Column:
    """Mean over heads of the first token's attention to all patches; heads: an array of such rows, patch 0 at 1."""
    k = F.size(heads)
    return F.transform(F.sequence(F.lit(1), F.lit(n_patches)), lambda i: F.aggregate(heads, F.lit(0.0), lambda a, h: a + F.get(h, i)) / k)


def _resize(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, corners on corners."""
    y, x = np.linspace(0, grid.shape[0] - 1, height), np.linspace(0, grid.shape[1] - 1, width)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, grid.shape[0] - 1), np.minimum(x0 + 1, grid.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = grid[np.ix_(y0, x0)] * (1 - fx) + grid[np.ix_(y0, x1)] * fx
    low = grid[np.ix_(y1, x0)] * (1 - fx) + grid[np.ix_(y1, x1)] * fx
    return np.maximum(top * (1 - fy) + low * fy, 0)


def resize(df: DataFrame, column: str, height: int, width: int, density: bool = False) -> DataFrame:
    """column (rows of a grid) at another size, values at least 0; a density sums to 1 again."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != column else f"`{column}` array<array<double>>" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g in batch[column]:
                r = _resize(np.array([np.asarray(x, float) for x in g]), height, width)
                out.append((r / r.sum() if density and r.sum() > 0 else r).tolist())
            yield batch.assign(**{column: out})

    return df.mapInPandas(run, fields)


def stamp(df: DataFrame, keys: list[str], box: tuple[str, str, str, str], peak: str, height: int, width: int, cell: int, most: int = 40, sigma: float = 0.35) -> DataFrame:
    """keys, cy, cx, heat: the largest of the Gaussians around the `most` strongest boxes of a frame, by grid cell of
    `cell` pixels, 1 at the frame's peak. Each box is spread over the cells within three deviations only.
    """
    from ..operators.ranking import top_k

    best = top_k(df, keys, [F.desc(peak), F.asc(box[1]), F.asc(box[0])], most, "__k")
    x, y, w, h = map(F.col, box)
    mx, my = x + w / 2.0, y + h / 2.0
    sx, sy = F.greatest(F.lit(4.0), w * sigma), F.greatest(F.lit(4.0), h * sigma)
    span = lambda m, s, n: F.sequence(F.greatest(F.lit(0), F.floor((m - 3 * s) / cell)), F.least(F.lit((n - 1) // cell), F.greatest(F.lit(0), F.floor((m + 3 * s) / cell))))
    cells = best.withColumn("cy", F.explode(span(my, sy, height))).withColumn("cx", F.explode(span(mx, sx, width)))
    dy, dx = (F.col("cy") * cell + cell / 2.0 - my) / sy, (F.col("cx") * cell + cell / 2.0 - mx) / sx
    heat = cells.groupBy(*keys, "cy", "cx").agg(F.max(F.col(peak) * F.exp(-0.5 * (dx * dx + dy * dy))).alias("heat"))
    top = heat.groupBy(*keys).agg(F.max("heat").alias("__top"))
    return heat.join(top, keys).withColumn("heat", F.coalesce(F.col("heat") / F.nullif(F.col("__top"), F.lit(0.0)), F.lit(0.0))).drop("__top")

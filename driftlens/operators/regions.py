"""Connected regions of differing cells whatever an image's size, and outlines around them.

A component is found inside square tiles first. Then four blocks at a time
become one, and a block keeps only what may still grow: the cells on its own
rim, each with its component's smallest cell and extent. A component that
doesn't touch the rim is finished and leaves. So a task holds a tile's cells,
or a rim, never an image, and a merge is the same function at each level.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept

# The outline's colour (red, green, blue) and width, the margin around a region, pixels of a cell.
OUTLINE, THICK, MARGIN, CELL = (230, 45, 20), 2, 3, 16
TILE = 256
DONE = -1


def _roots(pairs, n: int) -> np.ndarray:
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return np.array([root(k) for k in range(n)], dtype=np.int64)


def _merged(side: int, last: bool):
    """Cells of one block of ``side`` cells to its rim and its finished components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.cx.to_numpy(np.int64), pdf.cy.to_numpy(np.int64)
        names, group = np.unique(pdf.comp.to_numpy(), return_inverse=True)
        code = (y << 32) + x
        order = np.argsort(code, kind="stable")
        placed, pairs = code[order], []
        for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
            want = ((y + dy) << 32) + x + dx
            at = np.minimum(np.searchsorted(placed, want), len(placed) - 1)
            hit = placed[at] == want
            pairs += zip(group[hit].tolist(), group[order[at[hit]]].tolist(), strict=True)
        label = _roots(pairs, len(names))[group]
        by = pdf.groupby(label)
        out = pdf.assign(**{c: by[c].transform("min") for c in ("comp", "x1", "y1")}, **{c: by[c].transform("max") for c in ("x2", "y2")})
        rim = np.zeros(len(pdf), dtype=bool) if last else np.isin(x % side, (0, side - 1)) | np.isin(y % side, (0, side - 1))
        over = out[~np.isin(label, label[rim])].drop_duplicates("comp").assign(cx=DONE, cy=DONE)
        return pd.concat([out[rim], over])[["image", "cx", "cy", "comp", "x1", "y1", "x2", "y2"]]

    return run


def components(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """image, comp, x1, y1, x2, y2: the extents, in cells, of the 8-neighbour components of ``cells`` (image, cx, cy >= 0).

    ``comp`` is 2**32 * cy + cx of a component's first cell, by rows. Repeated
    cells count once; null positions are left out; a null image is an image;
    no cells give no rows; other columns are ignored. Each level is a written
    table, and there are as many levels as the widest image needs.
    """
    image = cells.schema["image"].dataType.simpleString()
    schema = f"image {image}, cx long, cy long, comp long, x1 long, y1 long, x2 long, y2 long"
    x, y = F.col("cx").cast("long"), F.col("cy").cast("long")
    own = cells.filter("cx IS NOT NULL AND cy IS NOT NULL").select("image", x.alias("cx"), y.alias("cy")).distinct()
    code = F.shiftleft(F.col("cy"), 32) + F.col("cx")
    left = own.select("image", "cx", "cy", code.alias("comp"), *(F.col(c).alias(n) for c, n in (("cx", "x1"), ("cy", "y1"), ("cx", "x2"), ("cy", "y2"))))
    side, over, last = tile, [], False
    while True:
        block = [F.floor(F.col(c) / side).alias(f"b{c}") for c in ("cx", "cy")]
        level = kept(left.groupBy("image", *block).applyInPandas(_merged(side, last), schema), "regions")
        over.append(level.filter(F.col("cx") == DONE).drop("cx", "cy"))
        left = level.filter(F.col("cx") != DONE)
        top = left.agg(F.max(F.greatest("cx", "cy"))).first()[0]
        if top is None:
            return reduce(DataFrame.unionByName, over)
        side *= 2
        last = side > top


def regions(cells: DataFrame, sizes: DataFrame, cell: int = CELL, margin: int = MARGIN, tile: int = TILE) -> DataFrame:
    """image, left, top, right, bottom (right and bottom exclusive): whole cells of each component, widened, inside the image.

    ``sizes`` has image, width and height, one row an image; images without a size have no regions.
    """
    at = lambda c, n: (F.col(c) * cell + n).cast("int")
    found = components(cells, tile).join(sizes.select("image", "width", "height"), "image")
    return found.select(
        "image", F.greatest(F.lit(0), at("x1", -margin)).alias("left"), F.greatest(F.lit(0), at("y1", -margin)).alias("top"),
        F.least(F.col("width").cast("int"), at("x2", cell + margin)).alias("right"), F.least(F.col("height").cast("int"), at("y2", cell + margin)).alias("bottom"),
    )


def outlined(rows: DataFrame, found: DataFrame, colour: int | None = None, thick: int = THICK) -> DataFrame:
    """Pixel rows (image, y, row) with the outline of each region painted inside its box; other rows and columns stay.

    A pixel is a number, 65536 * red + 256 * green + blue if no colour is given. A component has a
    cell in each row of cells that it spans, so a row meets half as many regions as it has cells at most.
    """
    r, g, b = OUTLINE
    paint = F.lit((r << 16) + (g << 8) + b if colour is None else colour)
    y = F.explode(F.sequence("top", F.col("bottom") - 1)).alias("y")
    each = found.filter("top < bottom AND `left` < `right`").select("image", y, "left", "top", "right", "bottom")
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    lo, hi = F.col("left"), F.col("right")
    edges = F.array(span(lo, F.least(lo + thick, hi)), span(F.greatest(lo, hi - thick), hi))
    across = (F.col("y") < F.col("top") + thick) | (F.col("y") >= F.col("bottom") - thick)
    met = each.groupBy("image", "y").agg(F.flatten(F.collect_list(F.when(across, F.array(span(lo, hi))).otherwise(edges))).alias("_spans"))
    inside = lambda i: F.exists("_spans", lambda s: (s["a"] <= i) & (i < s["b"]))
    kind = rows.schema["row"].dataType.elementType
    painted = F.when(F.col("_spans").isNull(), F.col("row")).otherwise(F.transform("row", lambda v, i: F.when(inside(i), paint.cast(kind)).otherwise(v)))
    return rows.join(met, ["image", "y"], "left").withColumn("row", painted).select(*rows.columns)

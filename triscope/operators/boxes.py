"""Boxes on pages: rows, overlap, nearest neighbour. Boxes are arrays of four doubles: left, top, right, bottom.

Pairs are met through cells of a grid, never as all pairs of a page; a pair is taken in one cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_fields(box: Column) -> list[Column]:
    return [F.get(box, i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of two boxes given as struct columns; 0 where there is no area."""
    f = lambda s, n: F.col(f"{s}.{n}")
    w = F.greatest(F.lit(0.0), F.least(f(a, "x1"), f(b, "x1")) - F.greatest(f(a, "x0"), f(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(f(a, "y1"), f(b, "y1")) - F.greatest(f(a, "y0"), f(b, "y0")))
    area = lambda s: (f(s, "x1") - f(s, "x0")) * (f(s, "y1") - f(s, "y0"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def cell_of(df: DataFrame) -> float:
    """A size of grid cells that suits the boxes: their mean longer side, no less than a fiftieth of the longest, whatever the unit."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    mean, most = df.where("x1 >= x0 and y1 >= y0").agg(F.avg(side), F.max(side)).first()
    return max(mean, most / 50) or 1.0 if mean is not None else 1.0


def overlaps(df: DataFrame, page: list[str], key: str, least: float, cell: float | None = None) -> DataFrame:
    """key_a < key_b, iou of the pairs on one page whose overlap is at least ``least`` (> 0). Needs x0, y0, x1, y1.

    Without ``cell`` the size of the grid's cells is taken from the boxes.
    """
    cell = cell_of(df) if cell is None else cell
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    good = df.where("x1 >= x0 and y1 >= y0").select(*page, F.col(key).alias("key"), F.struct("x0", "y0", "x1", "y1").alias("box"), F.explode(cells("x0", "x1")).alias("cx"), "y0", "y1").withColumn("cy", F.explode(cells("y0", "y1")))
    a = good.select(*page, "cx", "cy", F.col("key").alias("key_a"), F.col("box").alias("a"))
    b = good.select(*page, "cx", "cy", F.col("key").alias("key_b"), F.col("box").alias("b"))
    pairs = a.join(b, [*page, "cx", "cy"]).where("key_a < key_b")
    home = (F.col("cx") == F.floor(F.greatest("a.x0", "b.x0") / cell)) & (F.col("cy") == F.floor(F.greatest("a.y0", "b.y0") / cell))
    return pairs.where(home).withColumn("iou", iou()).where(F.col("iou") >= least).select(*page, "key_a", "key_b", "iou")


def nearest(df: DataFrame, page: list[str], key: str, reach: float) -> DataFrame:
    """key, nearest, distance: the nearest other centre on the page within ``reach``; ties by the smaller key."""
    c = df.select(*page, F.col(key).alias("key"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")).where("x is not null and y is not null").withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    around = c.withColumn("s", F.explode(step)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    other = c.select(*page, "cx", "cy", F.col("key").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = around.join(other, [*page, "cx", "cy"]).where("key <> other")
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    best = pairs.withColumn("distance", d).where(F.col("distance") <= reach).groupBy(*page, "key").agg(F.min(F.struct("distance", "other")).alias("m"))
    return best.select(*page, "key", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))


def rows_of(df: DataFrame, page: list[str], text: str, height: float) -> DataFrame:
    """Boxes banded into rows by top edge (half-even rounding): the row's box, its texts from left to right, their number."""
    band = F.bround(F.col("y0") / height).cast("bigint")
    parts = F.array_sort(F.collect_list(F.struct("x0", F.col(text).alias("t"))))
    return df.where("y0 is not null").withColumn("band", band).groupBy(*page, "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("line"))


def crosses(p: tuple[Column, Column], q: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether the open segments p-q and a-b cross."""

    def side(o: tuple[Column, Column], d: tuple[Column, Column], x: tuple[Column, Column]) -> Column:
        return (d[0] - o[0]) * (x[1] - o[1]) - (d[1] - o[1]) * (x[0] - o[0])

    return (side(p, q, a) * side(p, q, b) < 0) & (side(a, b, p) * side(a, b, q) < 0)


def visible_nearest(points: DataFrame, labels: DataFrame, walls: DataFrame, page: list[str], key: str, label: str, reach: float, blind: float) -> DataFrame:
    """key, label, distance, seen: for each point the nearest label within ``reach`` that no wall hides, else the nearest within
    ``blind``. Points and labels have x, y; walls x0, y0, x1, y1. Ties go to the smaller label.

    Labels and walls are met through cells of the reach's size. Walls without all ends, points and labels without a place fall away.
    """
    cell = lambda df: df.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    around = cell(points.select(*page, F.col(key).alias("key"), "x", "y")).withColumn("s", F.explode(step)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    near = cell(labels.select(*page, F.col(label).alias("label"), "x", "y")).withColumnsRenamed({"x": "lx", "y": "ly"})
    d = F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))
    pairs = around.join(near, [*page, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= reach).drop("cx", "cy")
    # a wall hides a pair only if their boxes meet; the test runs on the pairs of its page
    # both are filed under the cells (of the reach's size) that their boxes touch, so a pair meets the walls near it alone
    over = lambda a, b: F.sequence(F.floor(F.least(a, b) / reach), F.floor(F.greatest(a, b) / reach))
    w = walls.select(*page, *(F.col(c).alias(f"w{c}") for c in ("x0", "y0", "x1", "y1"))).where("wx0 is not null and wy0 is not null and wx1 is not null and wy1 is not null")
    w = w.withColumn("gx", F.explode(over("wx0", "wx1"))).withColumn("gy", F.explode(over("wy0", "wy1")))
    near_pairs = pairs.withColumn("gx", F.explode(over("x", "lx"))).withColumn("gy", F.explode(over("y", "ly")))
    meet = (F.least("wx0", "wx1") <= F.greatest("x", "lx")) & (F.greatest("wx0", "wx1") >= F.least("x", "lx")) & (F.least("wy0", "wy1") <= F.greatest("y", "ly")) & (F.greatest("wy0", "wy1") >= F.least("y", "ly"))
    c = F.col
    hidden = near_pairs.join(w, [*page, "gx", "gy"]).where(meet & crosses((c("x"), c("y")), (c("lx"), c("ly")), (c("wx0"), c("wy0")), (c("wx1"), c("wy1")))).select(*page, "key", "label").distinct().withColumn("hidden", F.lit(True))
    known = pairs.join(hidden, [*page, "key", "label"], "left").withColumn("seen", F.col("hidden").isNull()).where(F.col("seen") | (F.col("distance") <= blind))
    best = known.groupBy(*page, "key").agg(F.min(F.struct((~F.col("seen")).alias("unseen"), "distance", "label")).alias("m"))
    return best.select(*page, "key", F.col("m.label").alias("label"), F.col("m.distance").alias("distance"), (~F.col("m.unseen")).alias("seen"))

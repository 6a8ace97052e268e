"""Layout of pages: tokens of two readings, rows by their middle, lines merged end to end, labels in columns, walks along lines.

What is greedy by its meaning runs page by page in Arrow batches (a page is bounded); the rest are expressions and joins on grid
cells. Boxes have x0, y0, x1, y1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triscope.operators.boxes import overlaps


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def page_by_page(df: DataFrame, page: list[str], columns: list[str], of_page: Callable[[list[tuple]], list[tuple]], added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """The rows that ``of_page`` makes of the rows (tuples of ``columns``) of each page, with the page's keys before them.

    Pages are brought together and sorted once, then read as one stream per task: no group is a table of its own, and no more than
    one page is held.
    """
    names = [*page, *columns]
    sorted_rows = df.select(*names).repartition(*page).sortWithinPartitions(*page)
    n, kinds = len(page), {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds.setdefault("page", [b.schema.field(i).type for i in range(n)])
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            types = [*kinds["page"], *(t for _, _, t in added)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [*page, *(a for a, _, _ in added)])

        for key, group in groupby(rows(), key=lambda r: r[:n]):
            out += [(*key, *r) for r in of_page([r[n:] for r in group])]
            if len(out) >= 10_000:
                yield made()
                out.clear()
        if out:
            yield made()

    kind = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in page), *(f"`{a}` {k}" for a, k, _ in added)])
    return sorted_rows.mapInArrow(run, kind)


def with_new_tokens(base: DataFrame, extra: DataFrame, page: list[str], key: str, least: float = 0.3) -> DataFrame:
    """``base`` and those tokens of ``extra`` that overlap none of it by ``least``. Keys are strings, apart in the two."""
    named = lambda df, p: df.withColumn("__k", F.concat(F.lit(p), F.col(key)))
    columns = [*page, "__k", "x0", "y0", "x1", "y1"]
    both = named(base, "a").select(columns).unionByName(named(extra, "b").select(columns))
    covered = overlaps(both, page, "__k", least).where(F.col("key_a").startswith("a") & F.col("key_b").startswith("b")).select(F.expr("substring(key_b, 2)").alias(key)).distinct()
    return base.unionByName(extra.join(covered, key, "left_anti").select(base.columns))


def strongest(boxes: DataFrame, page: list[str], key: str, score: str, least: float = 0.5) -> DataFrame:
    """page, key of the boxes kept when each suppresses weaker ones that overlap it by ``least``, strongest first; ties by key."""

    def keep(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in sorted(rows, key=lambda r: (-r[1], r[0])):
            if all(_iou(r[2:], o[2:]) < least for o in kept):
                kept.append(r)
        return [(r[0],) for r in kept]

    kind = boxes.schema[key].dataType.simpleString()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    return page_by_page(boxes.where(F.col(score).isNotNull() & F.col(key).isNotNull()), page, [key, score, "x0", "y0", "x1", "y1"], keep, [(key, kind, arrow)])


def reading_rows(tokens: DataFrame, page: list[str], text: str, near: float = 0.6, apart: float = 3.0) -> DataFrame:
    """page, row, x0, y0, x1, y1, line: tokens gathered into rows by their middles (within ``near`` heights), cut at gaps wider than
    ``apart`` heights."""

    def rows(tokens: list[tuple]) -> list[tuple]:
        groups: list[list] = []
        for t in sorted(tokens, key=lambda t: (t[1], t[0])):
            middle, height = (t[1] + t[3]) / 2, max(t[3] - t[1], 1e-9)
            home = next((g for g in groups if abs(g[0] - middle) < near * max(height, g[1])), None)
            if home is None:
                groups.append([middle, height, [t]])
            else:
                home[2].append(t)
        out: list[list] = []
        for _, height, ts in sorted(groups, key=lambda g: g[0]):
            line: list = []
            for t in sorted(ts, key=lambda t: t[0]):
                if line and t[0] - line[-1][2] > apart * height:
                    out.append(line)
                    line = []
                line.append(t)
            out.append(line)
        return [(i, min(t[0] for t in r), min(t[1] for t in r), max(t[2] for t in r), max(t[3] for t in r), " ".join(str(t[4]) for t in r)) for i, r in enumerate(out)]

    added = [("row", "int", pa.int32()), *((c, "double", pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("line", "string", pa.string())]
    return page_by_page(tokens.where(F.col(text).isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull()), page, ["x0", "y0", "x1", "y1", text], rows, added)


def merged_level(segments: DataFrame, page: list[str], tolerance: float = 1.0, gap: float = 2.5) -> DataFrame:
    """page, level, start, end, n: level segments on one line (of ``tolerance``) that touch or lie at most ``gap`` apart, as one."""
    level = F.bround((F.col("y0") + F.col("y1")) / 2 / tolerance).cast("bigint")
    rows = segments.select(*page, level.alias("level"), F.least("x0", "x1").alias("start"), F.greatest("x0", "x1").alias("end"))
    w = W.partitionBy(*page, "level").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("__r", reach).withColumn("__o", (F.col("__r").isNull() | (F.col("start") > F.col("__r") + gap)).cast("int"))
    return marked.withColumn("__g", F.sum("__o").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*page, "level", "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("__g")


def outside_columns(labels: DataFrame, page: list[str], x: str, least: int = 4, within: float = 2.0) -> DataFrame:
    """Labels that don't stand in a column: fewer than ``least`` of the page, themselves among them, lie within ``within`` across."""
    span = round(within * 1000)
    w = W.partitionBy(*page).orderBy(F.round(F.col(x) * 1000).cast("bigint")).rangeBetween(-span, span)
    return labels.withColumn("__n", F.count("*").over(w)).where(F.col("__n") < least).drop("__n")


def follow(points: DataFrame, segments: DataFrame, page: list[str], key: str, hops: int, reach: float) -> DataFrame:
    """key, x, y, hops: where a walk along segments ends that starts at a point, takes the nearest segment end within ``reach``,
    goes to its other end, and so on, each segment once. ``segments`` has id, x0, y0, x1, y1.

    Each hop is a join on grid cells of the reach's size; a walk keeps the few segments that it has taken.
    """
    ends = segments.select(*page, "id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by")).unionByName(segments.select(*page, "id", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x0").alias("bx"), F.col("y0").alias("by")))
    ends = ends.withColumns({"cx": F.floor(F.col("ax") / reach), "cy": F.floor(F.col("ay") / reach)})
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    kind = segments.schema["id"].dataType.simpleString()
    now = points.select(*page, F.col(key).alias("key"), "x", "y", F.array().cast(f"array<{kind}>").alias("taken"))
    for _ in range(hops):
        around = now.withColumn("s", F.explode(step)).withColumns({"cx": F.floor(F.col("x") / reach) + F.col("s.i"), "cy": F.floor(F.col("y") / reach) + F.col("s.j")}).drop("s")
        d = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
        near = around.join(ends, [*page, "cx", "cy"]).where(~F.array_contains("taken", F.col("id"))).withColumn("d", d).where(F.col("d") <= reach)
        best = near.groupBy(*page, "key").agg(F.min(F.struct("d", "id", "bx", "by")).alias("m"))
        now = now.join(best, [*page, "key"], "left").select(*page, "key", F.coalesce("m.bx", "x").alias("x"), F.coalesce("m.by", "y").alias("y"), F.when(F.col("m").isNotNull(), F.concat("taken", F.array("m.id"))).otherwise(F.col("taken")).alias("taken"))
    return now.select(*page, "key", "x", "y", F.size("taken").alias("hops"))


def visible_box(box: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A box of a page turned by 0, 90, 180 or 270 degrees as it is seen, in shares of the seen page, rounded to four places.

    Width and height are those before the turn; the result is ordered and within the page.
    """
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    turned = (
        F.when(rotation == 90, F.array(height - y1, x0, height - y0, x1))
        .when(rotation == 180, F.array(width - x1, height - y1, width - x0, height - y0))
        .when(rotation == 270, F.array(y0, width - x1, y1, width - x0))
        .otherwise(F.array(x0, y0, x1, y1))
    )
    aside = rotation.isin(90, 270)
    w, h = F.when(aside, height).otherwise(width), F.when(aside, width).otherwise(height)
    share = lambda i, of: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(turned, i) / of)), 4)
    a, b, c, d = share(0, w), share(1, h), share(2, w), share(3, h)
    return F.array(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))


def grouped_lines(words: DataFrame, keys: list[str], order: str, text: str, score: str) -> DataFrame:
    """Words gathered by their block, paragraph and line: the common box, the text in order, the mean score."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    return words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg(score).alias("score"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("line"))

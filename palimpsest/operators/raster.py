"""Pixel grids as rows (image, x, y, value...): changes, boxes, coarse grids, downscaling, outlines."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A channel has changed when it differs by more than this.
TOLERANCE = 16
#: An outline of more boundary edges is not traced.
MOST_EDGES = 8000
OUTLINE_SIDE = 200


def changed(before: list[Column], after: list[Column]) -> Column:
    """Whether any channel of a pixel differs by more than the tolerance."""
    out = F.lit(False)
    for a, b in zip(before, after, strict=True):
        out = out | (F.abs(a - b) > TOLERANCE)
    return out


def change_grid(before: DataFrame, after: DataFrame, channels: list[str]) -> DataFrame:
    """(image, x, y, changed) for the pixels that both sides have."""
    old = before.select("image", "x", "y", *[F.col(c).alias(f"__{c}") for c in channels])
    both = after.join(old, ["image", "x", "y"])
    return both.select("image", "x", "y", changed([F.col(f"__{c}") for c in channels], [F.col(c) for c in channels]).alias("changed"))


def sampled_change_grid(before: DataFrame, after: DataFrame, sizes: DataFrame, channels: list[str]) -> DataFrame:
    """(image, x, y, changed) for every pixel of `after`, against the pixel of a before of another size that lies there.

    `sizes` is (image, before_width, before_height, width, height), one row an image.
    """
    at = lambda c, old, new: F.expr(f"least({c} * {old} div {new}, {old} - 1)")
    placed = after.join(sizes, "image").withColumn("bx", at("x", "before_width", "width")).withColumn("by", at("y", "before_height", "height"))
    old = before.select("image", F.col("x").cast("bigint").alias("bx"), F.col("y").cast("bigint").alias("by"), *[F.col(c).alias(f"__{c}") for c in channels])
    both = placed.join(old, ["image", "bx", "by"])
    return both.select("image", "x", "y", changed([F.col(f"__{c}") for c in channels], [F.col(c) for c in channels]).alias("changed"))


def box(grid: DataFrame) -> DataFrame:
    """The box of changed pixels and their number, for images that have any."""
    return grid.where("changed").groupBy("image").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("pixels")
    )


def coarse(grid: DataFrame, step: int) -> DataFrame:
    """Blocks of `step` pixels, changed if any of their pixels is."""
    return grid.groupBy("image", F.expr(f"x div {step}").alias("bx"), F.expr(f"y div {step}").alias("by")).agg(F.bool_or("changed").alias("changed"))


def downscale(pixels: DataFrame, step: int) -> DataFrame:
    """Area averages of blocks: colour weighted by alpha, rounded half up in whole numbers."""
    total, area = F.sum("a"), F.count(F.lit(1))
    colour = lambda c: F.when(total == 0, 0).otherwise(F.expr(f"(2 * sum({c} * a) + sum(a)) div (2 * sum(a))"))
    out = pixels.groupBy("image", F.expr(f"x div {step}").alias("x"), F.expr(f"y div {step}").alias("y"))
    return out.agg(*[colour(c).cast("bigint").alias(c) for c in ("r", "g", "b")], F.expr("(2 * sum(a) + count(1)) div (2 * count(1))").alias("a"), area.alias("area"))


def blocks(canvases: DataFrame, side: int) -> DataFrame:
    """(image, bx, by, w, h): the blocks that tile each canvas (image, width, height), cut at its edges."""
    along = lambda c: F.sequence(F.lit(0), F.expr(f"({c} - 1) div {side}").cast("int"))
    cells = canvases.where("width > 0 and height > 0").select("*", F.explode(along("width")).alias("bx")).select("*", F.explode(along("height")).alias("by"))
    size = lambda c, at: F.least(F.lit(side), F.col(c) - F.col(at) * side).cast("bigint")
    return cells.select("image", F.col("bx").cast("bigint").alias("bx"), F.col("by").cast("bigint").alias("by"), size("width", "bx").alias("w"), size("height", "by").alias("h"))


#: The sides of a cell, each with the edge along it that has the cell to its right: its place in a mask is its bit.
SIDES = ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))


def _open_sides(grid: DataFrame) -> DataFrame:
    """(image, x, y, sides): changed cells with a mask of the SIDES that no changed cell lies beyond, without those that have none.

    A window over rows and one over columns, each a cell wide: the grid is made once, and no line but a row or a column is one group.
    """
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    beyond = lambda along, step: F.when(F.count(F.lit(1)).over(along.rangeBetween(step, step)) == 0, 1).otherwise(0)
    across = grid.where("changed").select("image", "x", "y", beyond(row, 1).alias("__right"), beyond(row, -1).alias("__left"))
    both = across.select("*", beyond(column, -1).alias("__top"), beyond(column, 1).alias("__bottom"))
    return both.select("image", "x", "y", F.expr("__top + 2 * __right + 4 * __bottom + 8 * __left").alias("sides")).where("sides > 0")


def boundary(grid: DataFrame) -> DataFrame:
    """(image, ax, ay, bx, by): directed unit edges around changed cells, the cell to the right of each edge."""
    edge = lambda k, moves: F.when(F.expr(f"sides >> {k} & 1 = 1"), F.struct(*[(F.col(n[1]) + d).cast("int").alias(n) for n, d in zip(("ax", "ay", "bx", "by"), moves, strict=True)]))
    return _open_sides(grid).select("image", F.inline(F.array_compact(F.array(*[edge(k, moves) for k, moves in enumerate(SIDES)]))))


def outlines(grid: DataFrame) -> DataFrame:
    """(image, edges, loops, path): closed outlines as an SVG path; none beyond MOST_EDGES edges."""
    cells = _open_sides(grid)
    few = cells.groupBy("image").agg(F.sum(F.bit_count("sides")).alias("n")).where(F.col("n") <= MOST_EDGES).select("image")
    held = cells.join(few, "image", "left_semi").groupBy("image").agg(F.collect_list(F.struct("x", "y", "sides")).alias("cells"))
    return held.select(F.col("image").cast("long").alias("image"), "cells").mapInArrow(_trace, "image long, edges long, loops long, path string")


def _loops(edges: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The corners of the closed lines that directed edges make, joined head to tail."""
    following = defaultdict(list)
    for ax, ay, bx, by in sorted(edges):
        following[ax, ay].append((bx, by))
    for start in sorted(following):
        while following[start]:
            line, at = [start], following[start].pop(0)
            while at != start:
                line.append(at)
                at = following[at].pop(0)
            yield [p for k, p in enumerate(line) if not _straight(line[k - 1], p, line[(k + 1) % len(line)])]


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images with the open cells of at most MOST_EDGES edges each, one row an image."""
    for batch in batches:
        lists = batch.column("cells")
        x, y, sides = (lists.flatten().field(k).to_numpy() for k in range(3))
        ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
        made: dict[str, list] = {"edges": [], "loops": [], "path": []}
        for own in map(slice, [0, *ends[:-1]], ends):
            cells = list(zip(x[own].tolist(), y[own].tolist(), sides[own].tolist(), strict=True))
            edges = [(cx + ax, cy + ay, cx + bx, cy + by) for k, (ax, ay, bx, by) in enumerate(SIDES) for cx, cy, mask in cells if mask >> k & 1]
            loops = list(_loops(edges))
            made["edges"].append(len(edges))
            made["loops"].append(len(loops))
            made["path"].append("".join("M" + "L".join(f"{px} {py}" for px, py in turns) + "Z" for turns in loops))
        yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(made["edges"], pa.int64()), pa.array(made["loops"], pa.int64()), pa.array(made["path"], pa.string())], ["image", *made])


def outline_of(grid: np.ndarray) -> str | None:
    """The outlines of a picture's changed pixels as an SVG path over 0..1, on a grid of at most OUTLINE_SIDE cells a side;
    None without changes or beyond MOST_EDGES edges."""
    height, width = grid.shape
    scale = OUTLINE_SIDE / max(height, width)
    rows, columns = (min(max(1, int(v * scale + 0.5)), v) for v in (height, width))
    y, x = np.nonzero(grid)
    cells = np.zeros((rows + 2, columns + 2), bool)
    cells[y * rows // height + 1, x * columns // width + 1] = True
    edges = []
    for dy, dx, (ax, ay, bx, by) in ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))):
        open_y, open_x = np.nonzero(cells[1:-1, 1:-1] & ~cells[1 + dy : 1 + dy + rows, 1 + dx : 1 + dx + columns])
        edges += zip((open_x + ax).tolist(), (open_y + ay).tolist(), (open_x + bx).tolist(), (open_y + by).tolist(), strict=True)
    if not edges or len(edges) > MOST_EDGES:
        return None
    return "".join("M" + "L".join(f"{x / columns:.4f} {y / rows:.4f}" for x, y in turns) + "Z" for turns in _loops(edges))


def _straight(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> bool:
    return (a[0] == b[0] == c[0]) or (a[1] == b[1] == c[1])

"""A boundary cut once into grid cells, for clipping by boundaries of any size.

A cell that no edge touches is wholly inside or outside and needs no geometry. Any other cell holds
the edges that touch it and one fact about the rest: whether a point of it lies inside. From that
point the cell's own edges decide about every other point of the cell, so buildings meet small cells
by an equi-join and the boundary as a whole is never copied.

Cells are squares of 2 ** -level degrees: their bounds are exact in binary, the same in every engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.functions.geometry import Shapes, _meeting, edge_cells, edge_rows, inside, parsed, plain_polygon, shapes_meet, wkb_bounds
from terrafoot.session import materialised

#: Cells of a boundary at most, where the least level does not have more; the deepest level; buildings of a cell that one task refines.
MOST_CELLS, DEEPEST, CELL_ROWS = 1 << 16, 14, 20_000
#: A building that touches more cells meets coarser ones, four levels up.
MOST_TOUCHED = 256
#: Degrees by which an edge reaches beyond itself when cells are dealt: more edges than needed do no harm.
MARGIN = 2.0**-26
CELLS = "cx long, cy long, inside boolean, xref double, base boolean, edges binary, starts binary"
BOX = ("xmin", "ymin", "xmax", "ymax")


def grid_level(boundary: DataFrame, most: int = MOST_CELLS, deepest: int = DEEPEST) -> int:
    """The deepest level at which the features' boxes touch at most ``most`` cells in all."""

    def touched(level: int) -> Column:
        at = lambda c: F.floor(F.col(f"box.{c}") * 2.0**level)
        return F.sum((at("xmax") - at("xmin") + 1) * (at("ymax") - at("ymin") + 1))

    sums = boundary.select(wkb_bounds("geom_wkb").alias("box")).agg(*[touched(k).alias(str(k)) for k in range(deepest + 1)]).first()
    return max((k for k in range(deepest + 1) if (sums[k] or 0) <= most), default=0)


def _above(a: np.ndarray, b: np.ndarray, x, y) -> np.ndarray:
    """Whether (x, y) is on or above the line through a and b, where a is the left end."""
    return (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0]) >= 0


def _right(a: np.ndarray, b: np.ndarray, x, y) -> np.ndarray:
    """Whether the edge passes to the right of (x, y), for edges that span y."""
    return np.where(a[:, 0] == b[:, 0], a[:, 0] > x, _above(a, b, x, y) == (b[:, 1] > a[:, 1]))


def cut(rings: list, level: int) -> dict[str, np.ndarray | list]:
    """The cells of one feature that hold anything of it, as columns of :data:`CELLS`."""
    rings = [r for _, _, r in rings if len(r)]
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    moves = (a != b).any(1)
    a, b = a[moves], b[moves]
    starts = np.array([r[0] for r in rings])
    if not len(a):  # points only
        a = b = starts
    left = (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] <= b[:, 1]))
    a, b = np.where(left[:, None], a, b), np.where(left[:, None], b, a)
    scale = 2.0**level
    edge, row, col0, col1 = edge_rows(a, b, np.zeros(2), np.full(2, scale), MARGIN)
    own, col = edge_cells(edge, row, col0, col1)
    r_min, c_min = row.min(), col.min()
    rows, cols = int(row.max() - r_min + 1), int(col.max() - c_min + 1)
    cell = (row[own] - r_min) * cols + col - c_min
    order = np.argsort(cell, kind="stable")
    cell, own = cell[order], own[order]
    e = edge[own]

    # a vertical line through each cell that meets no vertex of its edges
    grid_x = (c_min + np.arange(rows * cols) % cols).astype(float)
    xref, share = np.zeros(rows * cols), np.full(rows * cols, np.sqrt(2) - 1)
    while True:
        xref = (grid_x + share) / scale
        hit = np.unique(cell[(a[e, 0] == xref[cell]) | (b[e, 0] == xref[cell])])
        if not len(hit):
            break
        share[hit] = (share[hit] + np.sqrt(3)) % 1 * 0.98 + 0.01
    # inside or not at (xref, lower bound of the row): the edges that span the bound and pass to the right
    bound = row / scale
    spans = (a[edge, 1] <= bound) != (b[edge, 1] <= bound)
    far = np.bincount((row[spans] - r_min) * cols + col0[spans] - c_min, minlength=rows * cols).reshape(rows, cols)
    right = far[:, ::-1].cumsum(1)[:, ::-1] - far  # edges that begin in a later column
    y = bound[own]
    near = spans[own] & _right(a[e], b[e], xref[cell], y)
    odd = (right.ravel() + np.bincount(cell[near], minlength=rows * cols)) % 2 == 1
    over = (a[e, 0] <= xref[cell]) != (b[e, 0] <= xref[cell])
    base = odd ^ (np.bincount(cell[over & _above(a[e], b[e], xref[cell], y)], minlength=rows * cols) % 2 == 1)

    first = np.flatnonzero(np.diff(cell, prepend=-1))
    held = cell[first]
    empty = np.ones(rows * cols, bool)
    empty[held] = False
    full = np.flatnonzero(empty & odd)
    ends = np.column_stack([a, b])[e]
    place = (np.floor(starts[:, 1] * scale).astype(np.int64) - r_min) * cols + np.floor(starts[:, 0] * scale).astype(np.int64) - c_min
    by_cell: dict[int, list] = {}
    for k, p in zip(place.tolist(), starts, strict=True):
        by_cell.setdefault(k, []).append(p)
    all_cells = np.concatenate([full, held])
    return {
        "cx": c_min + all_cells % cols, "cy": r_min + all_cells // cols, "inside": np.arange(len(all_cells)) < len(full), "xref": xref[all_cells], "base": base[all_cells],
        "edges": [None] * len(full) + [x.tobytes() for x in np.split(ends, first[1:])],
        "starts": [None] * len(full) + [np.array(by_cell.get(k, [])).tobytes() for k in held.tolist()],
    }


def boundary_cells(boundary: DataFrame, level: int) -> DataFrame:
    """One row for each feature and cell that it covers or whose edges touch it; shapes that are null, damaged or empty have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            for shape in batch.column(0):
                found = parsed(shape.as_py())
                if found and any(len(r) for _, _, r in found[1]):
                    columns = cut(found[1], level)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in zip(names, types, strict=True)], names)

    return boundary.select("geom_wkb").where("geom_wkb IS NOT NULL").mapInArrow(run, CELLS)


class Cell:
    """One feature's part of a cell."""

    def __init__(self, edges: bytes, starts: bytes, xref: float, base: bool):
        self.ends = np.frombuffer(edges).reshape(-1, 4)
        self.a, self.b = self.ends[:, :2], self.ends[:, 2:]
        self.starts = np.frombuffer(starts).reshape(-1, 2)
        self.xref, self.base = xref, base
        self.least, self.most = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        self.over = (self.a[:, 0] <= xref) != (self.b[:, 0] <= xref)

    def holds(self, points: np.ndarray) -> np.ndarray:
        """Whether points of this cell lie inside the feature or on an edge."""
        out = np.empty(len(points), bool)
        a, b = self.a, self.b
        for i, (x, y) in enumerate(points):
            spans = (a[:, 1] <= y) != (b[:, 1] <= y)
            turns = np.count_nonzero(self.over & _above(a, b, self.xref, y)) + np.count_nonzero(spans & (_right(a, b, self.xref, y) ^ _right(a, b, x, y)))
            line = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) == (b[:, 1] - a[:, 1]) * (x - a[:, 0])
            out[i] = self.base ^ (turns % 2 == 1) or (line & (self.least <= (x, y)).all(1) & ((x, y) <= self.most).all(1)).any()
        return out

    def meets(self, shape: list, least: np.ndarray, most: np.ndarray, cell: tuple[int, int], scale: float) -> bool:
        """Whether a shape with this box has a point in common with the feature, as far as this cell tells."""
        near = np.flatnonzero((self.least <= most).all(1) & (self.most >= least).all(1))
        for _, _, r in shape:
            for at in range(0, len(near) if len(r) > 1 else 0, 4096):
                part = near[at : at + 4096]
                if _meeting(r[:-1, None], r[1:, None], self.a[None, part], self.b[None, part], True).any():
                    return True
        shells = np.array([r[0] for _, h, r in shape if not h and len(r)])
        own = shells[(np.floor(shells * scale) == cell).all(1)] if len(shells) else shells
        if len(own) and self.holds(own).any():
            return True
        return any(inside(shape, x, y) for x, y in self.starts[((self.starts >= least) & (self.starts <= most)).all(1)].tolist())


def _refined(level: int):
    """Reads rows by cell, each cell's own rows first, and gives the ids of the buildings that meet it."""
    scale = 2.0**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cx", "cy", "salt")])
            building = ~np.asarray(batch.column("is_cell"))
            shapes = Shapes(batch.column("wkb"))
            box = shapes.bounds()
            ids, found = batch.column("__row").to_pylist(), []
            for i in range(len(ids)):
                if key is None or (keys[i] != key).any():
                    key, cells = keys[i], []
                x, y = key[:2].tolist()
                if not building[i]:
                    if batch.column("inside")[i].as_py():
                        cells.append([(0, False, np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]) / scale)])
                    else:
                        cells.append(Cell(batch.column("edges")[i].as_py(), batch.column("starts")[i].as_py(), batch.column("xref")[i].as_py(), batch.column("base")[i].as_py()))
                elif shapes.kinds[i] is not None and box[i, 0] == box[i, 0]:
                    shape = shapes.rings(i)
                    if any(c.meets(shape, box[i, :2], box[i, 2:], (x, y), scale) if isinstance(c, Cell) else shapes_meet(shape, c) for c in cells):
                        found.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["__row"])

    return run


def clip_by_cells(buildings: DataFrame, boundary: DataFrame, wkb: str = "geom_wkb", box: tuple[str, ...] = tuple(f"bbox_{c}" for c in BOX), level: int | None = None, most: int = MOST_CELLS) -> DataFrame:
    """Buildings that meet a boundary feature, each once; the columns ``box`` are the shapes' bounds.

    The cells' numbers and kinds, at most about ``most`` rows, go to every task. A building within one
    inside cell is taken as it is; those that touch a cell with edges, or several cells, are refined
    by cell, in parts of CELL_ROWS rows where a cell has very many. Null boxes and shapes that are
    null, damaged or empty meet nothing. Very large shapes are clipped by coarser cells. ``buildings``
    is read twice.
    """
    level = grid_level(boundary, most) if level is None else level
    cells = materialised(boundary_cells(boundary, level), "cells")
    kinds = F.broadcast(cells.groupBy("cx", "cy").agg(F.bool_or("inside").alias("__inside")).withColumnsRenamed({"cx": "__cx", "cy": "__cy"}))
    at = lambda c: F.floor(F.col(c) * 2.0**level).cast("long")
    x0, y0, x1, y1 = map(at, box)
    rows = buildings.withColumns({"__cx": x0, "__cy": y0, "__one": (x0 == x1) & (y0 == y1)}).where(F.col(wkb).isNotNull() & F.col("__one").isNotNull())
    clear = F.col("__one") & F.col("__inside") & plain_polygon(F.col(wkb))
    direct = rows.where("__one").join(kinds, ["__cx", "__cy"]).where(clear)
    single = rows.where("__one").join(kinds, ["__cx", "__cy"]).where(~clear)
    several = rows.where("NOT __one")
    columns = buildings.columns
    candidates = materialised(single.select(*columns).unionAll(several.select(*columns)).withColumn("__row", F.monotonically_increasing_id()), "candidates")

    wide = candidates.where((x1 - x0 + 1) * (y1 - y0 + 1) > MOST_TOUCHED)
    rest = [] if wide.isEmpty() else [clip_by_cells(wide.select(*columns), boundary, wkb, box, level - 4, most)]
    candidates = candidates.where((x1 - x0 + 1) * (y1 - y0 + 1) <= MOST_TOUCHED)
    spread = candidates.select("__row", F.col(wkb).alias("wkb"), F.explode(F.sequence(x0, x1)).alias("__cx"), y0.alias("y0"), y1.alias("y1")).withColumn("__cy", F.explode(F.sequence("y0", "y1")))
    pairs = materialised(spread.join(kinds, ["__cx", "__cy"]).select("__row", "wkb", F.col("__cx").alias("cx"), F.col("__cy").alias("cy")), "cell-pairs")
    salts = pairs.groupBy("cx", "cy").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(F.broadcast(salts), ["cx", "cy"]).select("cx", "cy", F.pmod(F.xxhash64("__row"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_cell"), "__row", "wkb", *[F.lit(None).alias(c) for c in ("inside", "xref", "base", "edges", "starts")])
    copies = cells.join(F.broadcast(salts), ["cx", "cy"]).select("cx", "cy", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_cell"), F.lit(0).cast("long").alias("__row"), F.lit(None).cast("binary").alias("wkb"), "inside", "xref", "base", "edges", "starts")
    ordered = copies.unionByName(dealt).repartition("cx", "cy", "salt").sortWithinPartitions("cx", "cy", "salt", F.desc("is_cell"))
    found = ordered.mapInArrow(_refined(level), "__row long").distinct()
    return reduce(DataFrame.unionAll, [direct.select(*columns), candidates.join(found, "__row", "left_semi").select(*columns), *rest])

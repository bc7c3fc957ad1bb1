"""A boundary prepared for many small shapes."""

from __future__ import annotations

import numpy as np

from terrafoot.functions.geometry import Shapes, _meeting, inside


class Feature:
    """One feature under a grid: cells that no edge touches are wholly inside or outside, and an edge is looked up by its bands."""

    def __init__(self, rings: list, cells: int):
        self.cells = cells
        rings = [r for _, _, r in rings if len(r)]
        pts = np.concatenate(rings)
        self.low, self.high = pts.min(0), pts.max(0)
        self.step = np.maximum((self.high - self.low) / cells, 1e-12)
        self.starts = np.array([r[0] for r in rings])
        self.a, self.b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
        self.least, self.most = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        first, last = self.cell(self.least), self.cell(self.most)
        self.edge = np.zeros((cells, cells), bool)
        for (x0, y0), (x1, y1) in zip(first.tolist(), last.tolist(), strict=True):
            self.edge[x0 : x1 + 1, y0 : y1 + 1] = True
        spans = last[:, 1] - first[:, 1] + 1
        band = np.repeat(first[:, 1], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        order = np.argsort(band, kind="stable")
        self.owner, self.band_at = np.repeat(np.arange(len(spans)), spans)[order], np.searchsorted(band[order], np.arange(cells + 1))
        self.known: dict[tuple[int, int], bool] = {}

    def cell(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((p - self.low) / self.step), 0, self.cells - 1).astype(int)

    def _edges(self, y0: int, y1: int) -> np.ndarray:
        return self.owner[self.band_at[y0] : self.band_at[y1 + 1]]

    def holds(self, x: float, y: float) -> bool:
        """Even-odd over the edges of the point's band; an edge or vertex counts as inside."""
        if not (self.low[0] <= x <= self.high[0] and self.low[1] <= y <= self.high[1]):
            return False
        band = int(self.cell(np.array([[x, y]]))[0, 1])
        own = self._edges(band, band)
        edges = np.stack([self.a[own], self.b[own]], 1)
        a, b = edges[:, 0], edges[:, 1]
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        if ((cross == 0) & (self.least[own] <= (x, y)).all(1) & ((x, y) <= self.most[own]).all(1)).any():
            return True
        up = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return bool((up & (x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))).sum() % 2)

    def meets(self, shape: list, least: np.ndarray, most: np.ndarray) -> bool:
        """Whether a shape (rings) with this box has a point in common with the feature."""
        y0, y1 = self.cell(np.array([least, most]))[:, 1].tolist()
        own = self._edges(y0, y1)
        own = own[(self.least[own] <= most).all(1) & (self.most[own] >= least).all(1)]
        for _, _, r in shape:
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                if len(r) > 1 and _meeting(r[:-1, None], r[1:, None], self.a[None, part], self.b[None, part], True).any():
                    return True
        if any(self.holds(*r[0]) for _, h, r in shape if not h and len(r)):
            return True
        within = ((self.starts >= least) & (self.starts <= most)).all(1)
        return any(inside(shape, x, y) for x, y in self.starts[within].tolist())


class Prepared:
    """Features, ready to meet batches of shapes."""

    def __init__(self, features: list[list], cells: int = 64):
        self.features = [Feature(f, cells) for f in features if any(len(r) for _, _, r in f)]

    def meets(self, shapes: Shapes) -> np.ndarray:
        """For each shape whether it has a point in common with a feature."""
        box = shapes.bounds()
        least, most = box[:, :2], box[:, 2:]
        out = np.zeros(len(shapes), bool)
        for f in self.features:
            near = np.flatnonzero(~out & (least <= f.high).all(1) & (most >= f.low).all(1))
            first, last = f.cell(least[near]), f.cell(most[near])
            within = (first == last).all(1) & ~f.edge[first[:, 0], first[:, 1]] & (least[near] >= f.low).all(1) & (most[near] <= f.high).all(1)
            for x, y in np.unique(first[within], axis=0).tolist():
                if (x, y) not in f.known:
                    f.known[x, y] = f.holds(*(f.low + (np.array([x, y]) + 0.5) * f.step))
            out[near[within]] = [f.known[x, y] for x, y in first[within].tolist()]
            for i in near[~within].tolist():
                out[i] = f.meets(shapes.rings(i), least[i], most[i])
        return out

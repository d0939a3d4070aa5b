"""Nearest points in numpy, by a grid."""

from __future__ import annotations

import math

import numpy as np


class _Cells:
    """A grid of square cells over points and a margin around them. Each cell lists the points that can be the nearest one
    somewhere in it: no farther at their closest than another one at its farthest, and not behind one that is closer to all four
    corners, and so to the whole cell. Lists of about one length are one table."""

    WIDTHS = (4, 8, 16, 32, 64, 128)

    def __init__(self, x: np.ndarray, y: np.ndarray, margin: float, cells: int):
        wide, high = np.ptp(x) + 2 * margin, np.ptp(y) + 2 * margin
        self.h = max(math.sqrt(wide * high / cells), max(wide, high) / cells)
        self.low = np.array([x.min() - margin, y.min() - margin])
        self.nx, self.ny = math.ceil(wide / self.h), math.ceil(high / self.h)
        (near_x, far_x), (near_y, far_y) = self._ends(x, self.low[0], self.nx), self._ends(y, self.low[1], self.ny)
        found = []
        for band in range(self.ny):
            most = (far_x + far_y[band]).min(axis=1)
            cell, point = np.nonzero(near_x + near_y[band] <= most[:, None] * (1 + 1e-9))
            found.append((cell + band * self.nx, point))
        cell, point = (np.concatenate(c) for c in zip(*found, strict=True))
        stays = ~self._behind(cell, x[point], y[point])
        cell, point = cell[stays], point[stays]
        sizes = np.bincount(cell, minlength=self.nx * self.ny)
        place = np.arange(len(cell)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.kind = np.searchsorted(self.WIDTHS, sizes)  # beyond the last width: not listed
        self.slot, self.tables = np.zeros(len(sizes), np.int64), []
        far_away = np.append(x, np.inf), np.append(y, np.inf)
        for k, width in enumerate(self.WIDTHS):
            of = np.flatnonzero(self.kind == k)
            self.slot[of] = np.arange(len(of))
            table = np.full((len(of), width), len(x), np.int64)  # one beyond the last is no point
            mine = self.kind[cell] == k
            table[self.slot[cell[mine]], place[mine]] = point[mine]
            self.tables.append((table, far_away[0][table], far_away[1][table]))

    def _ends(self, v: np.ndarray, low: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances along one axis from each column of cells to each point: the least and the most."""
        start = (low + self.h * np.arange(n))[:, None]
        return np.maximum(np.maximum(start - v, v - start - self.h), 0.0) ** 2, np.maximum(np.abs(v - start), np.abs(v - start - self.h)) ** 2

    def _behind(self, cell: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of points listed by cell, those that are farther from all corners than the point nearest to one of them."""
        left, low = self.low[0] + cell % self.nx * self.h, self.low[1] + cell // self.nx * self.h
        far = np.array([(x - left - i * self.h) ** 2 + (y - low - j * self.h) ** 2 for i in (0, 1) for j in (0, 1)])
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        own = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(cell)]))
        behind = np.zeros(len(cell), bool)
        for corner in far:
            least = np.flatnonzero(corner == np.minimum.reduceat(corner, begin)[own])
            front = np.empty(len(begin), np.int64)
            front[own[least]] = least
            behind |= (far > far[:, front[own]] * (1 + 1e-9) + 1e-12).all(axis=0)
        return behind

    def kinds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table and row of each position; positions that are not in any table have the number of tables."""
        u, v = np.floor((q[:, 0] - self.low[0]) / self.h), np.floor((q[:, 1] - self.low[1]) / self.h)
        inside = (u >= 0) & (u < self.nx) & (v >= 0) & (v < self.ny)
        code = np.where(inside, v * self.nx + u, 0).astype(np.int64)
        return np.where(inside, self.kind[code], len(self.WIDTHS)), self.slot[code]


class Spots:
    """Plan points, to find the nearest one (of equal ones, the first).

    A fine grid lies over the points, and a coarse one over a wide margin around them, for positions that are turned or mirrored
    away. Positions beyond both, and in cells of very many points, are compared with all points.
    """

    NEAR, WIDE = 0.1, 1.5  # margins, by the span of the points

    def __init__(self, points: np.ndarray):
        self.whole = points
        self.at = np.sort(np.unique(points, axis=0, return_index=True)[1])  # in the plan's order, so that argmin finds the first
        self.x, self.y = points[self.at, 0], points[self.at, 1]
        self.span = max(float(np.ptp(self.x)), float(np.ptp(self.y)), 1e-9)
        self.fine = _Cells(self.x, self.y, self.NEAR * self.span, min(max(4 * len(self.at), 64), 2048))
        self.coarse: _Cells | None = None  # made when a position needs it

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest point of each (finite) position."""
        best, d2 = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
        left = self._listed(self.fine, q, np.arange(len(q)), best, d2)
        if len(left):
            self.coarse = self.coarse or _Cells(self.x, self.y, self.WIDE * self.span, 256)
            left = self._listed(self.coarse, q, left, best, d2)
        for part in self._pieces(left, len(self.x)):
            d = self._squared(q[part], self.x, self.y)
            low = d.argmin(axis=1)
            best[part], d2[part] = self.at[low], d[np.arange(len(part)), low]
        return best, d2

    def _listed(self, cells: _Cells, q: np.ndarray, rows: np.ndarray, best: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Finds those of the rows that lie in listed cells; the others are returned."""
        kind, slot = cells.kinds(q[rows])
        for k, (table, x, y) in enumerate(cells.tables):
            for some in self._pieces(np.flatnonzero(kind == k), table.shape[1]):
                part, line = rows[some], slot[some]
                d = self._squared(q[part], x.take(line, axis=0), y.take(line, axis=0))
                low = d.argmin(axis=1)
                best[part], d2[part] = self.at[table[line, low]], d[np.arange(len(part)), low]
        return rows[kind == len(cells.tables)]

    @staticmethod
    def _pieces(rows: np.ndarray, each: int) -> list[np.ndarray]:
        """The rows, few enough at a time for their distances to stay in a core's cache."""
        step = max(1, 100_000 // each)
        return [rows[k : k + step] for k in range(0, len(rows), step)]

    @staticmethod
    def _squared(q: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances of positions to points, one axis after the other."""
        d, e = q[:, :1] - x, q[:, 1:] - y
        d *= d
        e *= e
        d += e
        return d


def layer_distances(xy: np.ndarray, plan: np.ndarray, layer: np.ndarray, layers: int) -> np.ndarray:
    """Squared distance of each position to each layer's nearest spot, positions by layers; infinite without spots."""
    out = np.full((len(xy), layers), np.inf)
    rows = np.flatnonzero(np.isfinite(xy).all(axis=1))
    for k in np.unique(layer):
        out[rows, k] = Spots(plan[layer == k]).nearest(xy[rows])[1]
    return out


class Layers:
    """A plan's spots by layer, to find how far positions are from each layer. Layers of few spots are compared whole, all at once."""

    FEW = 256

    def __init__(self, points: np.ndarray, layer: np.ndarray, layers: int):
        sizes = np.bincount(layer, minlength=layers)
        self.layers, self.without = layers, np.flatnonzero(sizes == 0)
        few = (sizes > 0) & (sizes <= self.FEW)
        self.small, order = np.flatnonzero(few), np.argsort(layer, kind="stable")
        listed = points[order[few[layer[order]]]]
        self.x, self.y, self.starts = listed[:, 0], listed[:, 1], np.cumsum(sizes[few]) - sizes[few]
        self.large = {k: Spots(points[layer == k]) for k in np.flatnonzero(sizes > self.FEW)}

    def squared(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each position to each layer's nearest spot, positions by layers; NaN without spots or position."""
        out = np.full((len(q), self.layers), np.nan)
        for part in Spots._pieces(np.arange(len(q)), max(len(self.x), 1)) if len(self.small) else []:
            out[part[:, None], self.small] = np.minimum.reduceat(Spots._squared(q[part], self.x, self.y), self.starts, axis=1)
        near = np.flatnonzero(np.isfinite(q).all(axis=1))
        rest = np.setdiff1d(np.arange(len(q)), near)
        for k, spots in self.large.items():
            out[near, k] = spots.nearest(q[near])[1]
            for part in Spots._pieces(rest, len(spots.x)):
                out[part, k] = Spots._squared(q[part], spots.x, spots.y).min(axis=1)
        return out


class OwnLayer:
    """A plan's spots by layer, to find for each position one spot of its own layer: its place among the plan's spots, or -1."""

    FEW = 256

    def __init__(self, points: np.ndarray, layer: np.ndarray):
        self.points, self.order = points, np.argsort(layer, kind="stable")
        numbers, starts = np.unique(layer[self.order], return_index=True)
        self.of = dict(zip(numbers.tolist(), np.split(self.order, starts[1:]), strict=True)) if len(layer) else {}
        self.made: dict = {}

    def _by_layer(self, layer: np.ndarray, wanted: np.ndarray, kind, find) -> np.ndarray:
        """The places that ``find`` gives for the wanted rows of each layer; what it looks up is made once for a layer."""
        out = np.full(len(layer), -1, np.int64)
        for k in np.unique(layer[wanted]).tolist():
            if k not in self.of:
                continue
            if (k, kind) not in self.made:
                at = self.of[k]
                usable = ~np.isnan(self.points[at] if kind is None else self.points[at, kind : kind + 1]).any(axis=1)
                self.made[k, kind] = self._near(at[usable]) if kind is None else self._line(at[usable], kind)
            if self.made[k, kind] is not None:
                mine = np.flatnonzero(wanted & (layer == k))
                out[mine] = find(self.made[k, kind], mine)
        return out

    def _near(self, at: np.ndarray):
        return (at, self.points[at, 0], self.points[at, 1], Spots(self.points[at]) if len(at) > self.FEW else None) if len(at) else None

    def _line(self, at: np.ndarray, axis: int):
        """Values along an axis in order, and the first spot of each."""
        values, first = np.unique(self.points[at, axis], return_index=True)
        return (values, at[first]) if len(at) else None

    def nearest(self, q: np.ndarray, layer: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The nearest spot of each wanted position, the first of equal ones."""

        def find(spots, mine):
            at, x, y, grid = spots
            near, whole = np.zeros(len(mine), np.int64), np.arange(len(mine))
            if grid is not None:
                finite = np.isfinite(q[mine]).all(axis=1)
                near[finite], whole = grid.nearest(q[mine[finite]])[0], whole[~finite]
            for part in Spots._pieces(whole, len(x)):
                near[part] = Spots._squared(q[mine[part]], x, y).argmin(axis=1)
            return at[near]

        return self._by_layer(layer, wanted, None, find)

    def along(self, q: np.ndarray, layer: np.ndarray, wanted: np.ndarray, axis: int) -> np.ndarray:
        """The spot nearest along one axis, the first of equal ones."""

        def find(line, mine):
            values, first = line
            v, above = q[mine, axis], np.searchsorted(values, q[mine, axis])
            low, high = np.maximum(above - 1, 0), np.minimum(above, len(values) - 1)
            d, e = np.abs(values[low] - v), np.abs(values[high] - v)
            return np.where((d < e) | ((d == e) & (first[low] < first[high])), first[low], first[high])

        return self._by_layer(layer, wanted, axis, find)

    def leftmost(self, layer: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The layer's spot with the smallest x."""
        return self._by_layer(layer, wanted, 0, lambda line, mine: line[1][0])

"""Clusters of points within a frame, rays through the grid, and boxes.

Clustering needs whole frames, so points are dealt out by frame and sorted; a task then takes as many whole frames at a
time as make a good batch, and all of them go through the same array steps at once.  A frame is one scan, which the
sensor bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import geometry as G
from ..functions import lattice as L
from ..runtime import settled, ship

#: Points that whole frames are gathered up to before they are worked on together.
TOGETHER = 200_000


def by_frames(rows: DataFrame, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, order: list[str], by: tuple[str, ...] = ("frame_ts",)) -> DataFrame:
    """work(rows, number of each row's frame) over whole frames, sorted by frame and then by the columns of order."""
    ship(rows.sparkSession)
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def done(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, size
            if not size:
                return
            own = pd.concat(held, ignore_index=True)
            frame = own.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            whole = len(own) if last else int(np.searchsorted(frame, frame[-1]))  # the last frame may go on
            held = [own.iloc[whole:]]
            size = len(own) - whole
            if whole:
                yield work(own.iloc[:whole].reset_index(drop=True), frame[:whole])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= TOGETHER:
                yield from done(False)
        yield from done(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's set, where a and b are pairs of one set."""
    name = np.arange(n)
    while len(a):
        least = np.minimum(name[a], name[b])
        np.minimum.at(name, name[a], least)
        np.minimum.at(name, name[b], least)
        while (name[name] != name).any():
            name = name[name]
        apart = name[a] != name[b]
        a, b = a[apart], b[apart]
    return name


def _keys(frame: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One integer for a cell of a frame; neighbours in y follow each other."""
    return (frame.astype(np.int64) << 42) + ((x.astype(np.int64) + (1 << 20)) << 21) + y.astype(np.int64) + (1 << 20)


def _pairs(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each i and every j from low[i] on, count[i] of them."""
    i = np.repeat(np.arange(len(low)), count)
    return i, np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def _touching(xy: np.ndarray, left: tuple, right: tuple, eps: float) -> np.ndarray:
    """Whether any point of one run is within eps of any of the other; runs are (starts, counts) over xy.  Few points
    of both are tried first, as most neighbours show at once; all are for the rest."""
    out = np.zeros(len(left[0]), bool)
    todo, few = np.arange(len(out)), 4
    while len(todo):
        n = np.minimum(left[1][todo], few)
        m = np.minimum(right[1][todo], few)
        for part in np.array_split(np.arange(len(todo)), max(1, int((n * m).sum() // 4_000_000))):
            i, at = _pairs(left[0][todo[part]], n[part])
            k, other = _pairs(right[0][todo[part]][i], m[part][i])
            near = ((xy[at[k]] - xy[other]) ** 2).sum(1) <= eps * eps
            out[todo[part][i[k[near]]]] = True
        todo = todo[~out[todo] & ((left[1][todo] > few) | (right[1][todo] > few))]
        few *= 8
    return out


def dbscan_labels(xy: np.ndarray, eps: float, min_points: int, frame: np.ndarray | None = None) -> np.ndarray:
    """Cluster of each point, or -1.  A cluster is named by the place of its first core point; a border point joins the
    neighbouring cluster of the least name.

    Points lie in cells whose diagonal is eps, so all points of a cell are near each other: a cell of min_points holds
    core points only, and the points of other cells are few.  Only those are counted one by one.
    """
    n = len(xy)
    if not n:
        return np.zeros(0, np.int64)
    frame = np.zeros(n, np.int64) if frame is None else frame
    side = eps / np.sqrt(2) * (1 - 1e-9)
    cell = np.floor(xy / side).astype(np.int64)
    key = _keys(frame, cell[:, 0], cell[:, 1])
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    size = np.diff(np.append(start, n))
    cells = key[order][start]
    of = np.empty(n, np.int64)
    of[order] = np.repeat(np.arange(len(start)), size)
    steps = [(dx << 21) + dy for dx in range(-2, 3) for dy in range(-2, 3) if abs(dx) + abs(dy) < 4]
    sorted_xy = xy[order]

    def meets(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(cells, keys + step)
        at[at == len(cells)] = 0
        return at, cells[at] == keys + step

    sparse = np.flatnonzero(size[of] < min_points)  # points
    near_i, near_j = [], []
    for step in steps:
        at, there = meets(key[sparse], step)
        i, j = _pairs(start[at[there]], size[at[there]])
        a, b = sparse[there][i], order[j]
        near = ((xy[a] - xy[b]) ** 2).sum(1) <= eps * eps
        near_i.append(a[near])
        near_j.append(b[near])
    i, j = np.concatenate(near_i), np.concatenate(near_j)
    core = size[of] >= min_points
    core[sparse] |= np.bincount(i, minlength=n)[sparse] >= min_points
    # cells' core points form runs of their own, in which all are joined
    core_order = order[core[order]]
    core_cells, core_start, core_size = np.unique(of[core_order], return_index=True, return_counts=True)
    if not len(core_cells):
        return np.full(n, -1, np.int64)
    core_xy = xy[core_order]
    pairs_a, pairs_b = [], []
    number = np.full(len(cells), -1)
    number[core_cells] = np.arange(len(core_cells))
    for step in steps:
        if step <= 0:
            continue
        at, there = meets(cells[core_cells], step)
        there &= number[at] >= 0
        a, b = np.flatnonzero(there), number[at[there]]
        close = _touching(core_xy, (core_start[a], core_size[a]), (core_start[b], core_size[b]), eps)
        pairs_a.append(a[close])
        pairs_b.append(b[close])
    part = joined(len(core_cells), np.concatenate(pairs_a), np.concatenate(pairs_b))
    first = np.minimum.reduceat(core_order, core_start)
    least = np.full(len(core_cells), n)
    np.minimum.at(least, part, first)
    name = np.full(n, n)
    name[core_order] = np.repeat(least[part], core_size)
    edge = ~core[i] & core[j]
    np.minimum.at(name, i[edge], name[j[edge]])
    return np.where(name == n, -1, name)


def dbscan(points: DataFrame, eps: float = 0.8, min_points: int = 5) -> DataFrame:
    """points (frame_ts, seq, x, y) with cluster: the seq of the cluster's first core point, null for noise."""

    def work(rows: pd.DataFrame, frame: np.ndarray) -> pd.DataFrame:
        name = dbscan_labels(rows[["x", "y"]].to_numpy(float), eps, min_points, frame)
        cluster = pd.array(rows.seq.to_numpy()[name], dtype="Int64")
        cluster[name < 0] = None
        return pd.DataFrame({"frame_ts": rows.frame_ts, "seq": rows.seq, "cluster": cluster})

    return by_frames(points.select("frame_ts", "seq", "x", "y"), work, "frame_ts int, seq long, cluster long", ["seq"])


def hard_objects(points: DataFrame, target: int = C.OBSTACLE, eps: float = 0.8, min_points: int = 5) -> DataFrame:
    """Clusters of the points (frame_ts, seq, x, y, z, label) of one label, with their boxes, classes and confidence; a
    frame with fewer points than a cluster needs has none."""
    own = points.where(F.col("label") == target)
    named = own.join(dbscan(own, eps, min_points).where("cluster is not null"), ["frame_ts", "seq"])
    return box_classes(boxes3(named, ["frame_ts", "cluster"]))


def raster_labels(cells: np.ndarray, reach: int = 3, frame: np.ndarray | None = None) -> np.ndarray:
    """Component of each occupied cell, by its first; cells up to reach apart, along either axis, are joined.  Cells
    are sorted by frame, x and y."""
    frame = np.zeros(len(cells), np.int64) if frame is None else frame
    key = _keys(frame, cells[:, 0], cells[:, 1])
    a, b = [], []
    for dx in range(reach + 1):
        for dy in range(-reach, reach + 1):
            step = (dx << 21) + dy
            if step <= 0 or not len(key):
                continue
            at = np.searchsorted(key, key + step)
            at[at == len(key)] = 0
            there = key[at] == key + step
            a.append(np.flatnonzero(there))
            b.append(at[there])
    return joined(len(cells), np.concatenate(a), np.concatenate(b)) if a else np.zeros(0, np.int64)


def raster_components(points: DataFrame, cell: float = 0.2, by: tuple[str, ...] = ("frame_ts",)) -> DataFrame:
    """points (frame_ts, seq, x, y) with component: components of the frame's occupied cells, numbered in row order."""
    keys = list(by)
    schema = points.select(*keys, "seq").schema.simpleString()[7:-1].replace(":", " ") + ", component long"

    def work(rows: pd.DataFrame, frame: np.ndarray) -> pd.DataFrame:
        key = np.floor(rows[["x", "y"]].to_numpy(float) / cell).astype(np.int64)
        cells, where = np.unique(np.column_stack([frame, key]), axis=0, return_inverse=True)
        root = raster_labels(cells[:, 1:], frame=cells[:, 0])
        roots, number = np.unique(root, return_inverse=True)  # sorted by frame, as roots are cells
        number = number - np.searchsorted(cells[roots, 0], cells[:, 0])
        return rows[[*keys, "seq"]].assign(component=number[where.reshape(-1)].astype(np.int64))

    return by_frames(points.select(*keys, "seq", "x", "y"), work, schema, ["seq"], by)


def boxes(points: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """Box of each group: bounds, centre, extents of at least least, and the number of points."""
    out = points.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))), F.count("*").alias("n_points"))
    for c in ("x", "y"):
        out = out.withColumn(f"c{c}", (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2).withColumn(f"d{c}", F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(least)))
    return out


def boxes3(points: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """Box of each group in all three axes, with the mean of its points."""
    bounds = [f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"))]
    out = points.groupBy(*by).agg(*bounds, F.count("*").alias("n_points"))
    return out.withColumns({f"d{c}": F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(least)) for c in "xyz"})


def box_classes(found: DataFrame) -> DataFrame:
    """Boxes with obj_class and obj_conf, from the differences of their bounds."""
    kind, sure = G.box_class(*(F.col(f"{c}_{n}") for n in ("lo", "hi") for c in "xyz"))
    return found.withColumn("obj_class", kind).withColumn("obj_conf", sure)


def line_cell(hx: Column, hy: Column, ox: Column, oy: Column, k: Column) -> tuple[Column, Column]:
    """The k-th cell on the way from a hit (k = 0) to the origin (k = the longer side).

    The longer axis moves every step.  The other has moved m cells after k steps, the least m that is not below
    k * short / long - 1/2, so that a tie stays behind.
    """
    dx, dy = F.abs(ox - hx), F.abs(oy - hy)
    longer, shorter = F.greatest(dx, dy), F.least(dx, dy)
    behind = F.when(longer == 0, F.lit(0).cast("long")).otherwise(L.floor_div(2 * k * shorter + longer - 1, 2 * F.greatest(longer, F.lit(1))))
    steep = dy > dx
    return hx + F.signum(ox - hx).cast("long") * F.when(steep, behind).otherwise(k), hy + F.signum(oy - hy).cast("long") * F.when(steep, k).otherwise(behind)


def _ray_ends(gated: DataFrame) -> DataFrame:
    t = F.when(F.col("range") <= 1e-3, 0.0).otherwise(L.by_level(F.col("level"), C.INNER) / F.col("range"))
    out = gated.withColumn("_t", t).where("_t < 1")
    at = lambda c: L.cell_index(F.col(f"robot_{c}") + F.col("_t") * (F.col(c) - F.col(f"robot_{c}")), F.col("level"))
    return settled(out.select("frame_ts", "level", at("x").alias("ox"), at("y").alias("oy"), F.col("ix").alias("hx"), F.col("iy").alias("hy")))


def rays(gated: DataFrame) -> DataFrame:
    """Distinct rays of each frame, hit cell to the cell where its band starts: the points of an azimuth share rays."""
    return _ray_ends(gated).distinct()


def ray_cells(ends: DataFrame) -> DataFrame:
    """(frame_ts, level, ix, iy) for every step of every ray, from expressions alone."""
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.abs(F.col("ox") - F.col("hx")), F.abs(F.col("oy") - F.col("hy"))))
    long = ends.where("ox <> hx or oy <> hy").withColumn("k", F.explode(steps))
    ix, iy = line_cell(*(F.col(c) for c in ("hx", "hy", "ox", "oy", "k")))
    return long.select("frame_ts", "level", ix.alias("ix"), iy.alias("iy"))


#: Rays that a task walks together, and cells of the window that it notes frames in, at most.
RAYS, WINDOW = 1 << 18, 1 << 24


class _Carved:
    """First and last frame of the cells of one level, noted in a dense window around what was walked."""

    def __init__(self):
        self.low = self.first = self.last = None

    def _room(self, x0: int, x1: int, y0: int, y1: int) -> bool:
        """Makes the window hold these cells; false if it would be too large."""
        if self.low is not None:
            x0, y0 = min(x0, self.low[0]), min(y0, self.low[1])
            x1, y1 = max(x1, self.low[0] + self.first.shape[0] - 1), max(y1, self.low[1] + self.first.shape[1] - 1)
            if self.low == (x0, y0) and self.first.shape == (x1 - x0 + 1, y1 - y0 + 1):
                return True
        if self.low is not None and (x1 - x0 + 1) * (y1 - y0 + 1) > WINDOW:
            return False
        pad = 64  # room to move on
        x0, x1, y0, y1 = x0 - pad, x1 + pad, y0 - pad, y1 + pad
        grown = [np.full((x1 - x0 + 1, y1 - y0 + 1), v, np.int32) for v in (np.iinfo(np.int32).max, np.iinfo(np.int32).min)]
        if self.low is not None:
            a, b = self.low[0] - x0, self.low[1] - y0
            for new, old in zip(grown, (self.first, self.last), strict=True):
                new[a : a + old.shape[0], b : b + old.shape[1]] = old
        (self.first, self.last), self.low = grown, (x0, y0)
        return True

    def walk(self, frame: int, ends: np.ndarray) -> bool:
        """Notes all cells of the rays (ox, oy, hx, hy) of a frame; false, and nothing, if they are too far away.

        All rays take their k-th step together: the longer axis moves, the other one when it has fallen behind by more
        than half a cell.  Rays are sorted by length, so those that go on are the first."""
        x0, x1, y0, y1 = int(ends[:, 0::2].min()), int(ends[:, 0::2].max()), int(ends[:, 1::2].min()), int(ends[:, 1::2].max())
        if not self._room(x0, x1, y0, y1):
            return False
        dx, dy = ends[:, 0] - ends[:, 2], ends[:, 1] - ends[:, 3]
        length = np.maximum(abs(dx), abs(dy))
        order = np.argsort(-length, kind="stable")
        dx, dy, length = dx[order], dy[order], length[order].astype(np.int32)
        width = y1 - y0 + 1  # of what these rays pass
        at = ((ends[order, 2] - x0) * width + ends[order, 3] - y0).astype(np.int32)
        in_x, in_y = (np.sign(dx) * width).astype(np.int32), np.sign(dy).astype(np.int32)
        steep = abs(dy) > abs(dx)
        major, minor = np.where(steep, in_y, in_x), np.where(steep, in_x, in_y)
        twice = 2 * np.minimum(abs(dx), abs(dy)).astype(np.int32)
        behind = np.zeros(len(length), np.int32)
        first, last = self.first.reshape(-1), self.last.reshape(-1)
        ends_at = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right") if len(length) else ()
        seen = np.zeros((x1 - x0 + 1) * width, bool)
        for n in ends_at:
            b = behind[:n]
            b += twice[:n]
            falls = b > length[:n]
            b -= falls * (2 * length[:n])
            at[:n] += major[:n] + falls * minor[:n]
            seen[at[:n]] = True
        cells = np.flatnonzero(seen)
        cells = (cells // width + x0 - self.low[0]) * self.first.shape[1] + cells % width + y0 - self.low[1]
        first[cells] = np.minimum(first[cells], frame)
        last[cells] = np.maximum(last[cells], frame)
        return True

    def rows(self, level: int) -> pd.DataFrame:
        x, y = np.nonzero(self.first != np.iinfo(np.int32).max)
        return pd.DataFrame({"level": np.full(len(x), level, np.int32), "ix": x + self.low[0], "iy": y + self.low[1], "carve_first": self.first[x, y], "carve_ts": self.last[x, y]})


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    windows: dict[int, _Carved] = {}
    held: list[np.ndarray] = []

    def walk() -> Iterator[pd.DataFrame]:
        rows = np.concatenate(held)
        held.clear()
        key = rows[:, 0] * len(C.CELL) + rows[:, 1]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for own in np.split(rows, cuts):
            frame, level = int(own[0, 0]), int(own[0, 1])
            ends = own[:, 2:]
            ends = ends[(ends[:, 0] != ends[:, 2]) | (ends[:, 1] != ends[:, 3])]
            if not len(ends):
                continue
            code = (ends - ends.min(0)).astype(np.int64)
            spread = code.max(0) + 1
            if float(np.prod(spread.astype(float))) < 2**62:  # rays that points share, once
                code = ((code[:, 0] * spread[1] + code[:, 1]) * spread[2] + code[:, 2]) * spread[3] + code[:, 3]
                ends = ends[np.unique(code, return_index=True)[1]]
            if not windows.setdefault(level, _Carved()).walk(frame, ends):
                yield windows[level].rows(level)
                windows[level] = _Carved()
                windows[level].walk(frame, ends)

    for batch in batches:
        held.append(batch[["frame_ts", "level", "ox", "oy", "hx", "hy"]].to_numpy(np.int64))
        if sum(map(len, held)) >= RAYS:
            yield from walk()
    if held:
        yield from walk()
    for level, window in windows.items():
        if window.low is not None:
            yield window.rows(level)


def carve(gated: DataFrame) -> DataFrame:
    """(level, ix, iy, carve_first, carve_ts): cells that a ray passed on its way, with the first and the last frame.

    Rays are walked where the points are, all of a frame side by side; a task hands on each cell once, with its frames,
    and these merge by cell.
    """
    ship(gated.sparkSession)
    cells = _ray_ends(gated).mapInPandas(_walked, "level int, ix long, iy long, carve_first int, carve_ts int")
    return cells.groupBy("level", "ix", "iy").agg(F.min("carve_first").alias("carve_first"), F.max("carve_ts").alias("carve_ts"))


def vacated(old_cells: str, new_cells: str, occupied: str):
    """Share of the cells left behind that are still occupied; null if none was left."""
    left = F.array_except(old_cells, new_cells)
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, F.col(occupied))) / F.size(left))


def nearest(left: DataFrame, right: DataFrame, reach: float, left_id: str, right_id: str) -> DataFrame:
    """For each row of left (frame_ts, id, x, y) the nearest row of right within reach in the same frame, or null.

    Both sides meet by frame and grid cell of size reach, left in nine cells, so no frame is joined with itself whole.
    """
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    cell = lambda c: F.floor(F.col(c) / reach)
    l = left.select("frame_ts", F.col(left_id).alias("l_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(steps).alias("s"))  # noqa: E741
    l = l.withColumn("kx", cell("lx") + F.col("s.a")).withColumn("ky", cell("ly") + F.col("s.b")).drop("s")  # noqa: E741
    r = right.select("frame_ts", F.col(right_id).alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("kx"), cell("y").alias("ky"))
    d2 = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    found = l.join(r, ["frame_ts", "kx", "ky"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    best = found.groupBy("frame_ts", "l_id").agg(F.min(F.struct("d2", "r_id")).alias("m")).select("frame_ts", F.col("l_id").alias(left_id), F.col("m.r_id").alias(f"nearest_{right_id}"), F.col("m.d2").alias("d2"))
    return left.select("frame_ts", left_id).join(best, ["frame_ts", left_id], "left")

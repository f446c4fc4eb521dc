"""Mapping operators: anchors, segments, warps, elevation and rays to the ground."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.operators.scan import Fold, range_scan
from fieldlens.sources.shared import cut, small


def segment_intervals(anchors: DataFrame, n_frames: int | None = None, *, bucket: int = 1 << 16) -> DataFrame:
    """(anchor_ind, start, stop): an anchor holds from its frame to before the next; the last one to its own frame alone.

    The next anchor is found inside buckets of frames; past a bucket's end it is the first of the next bucket that has any,
    from a table with a row for each bucket.
    """
    at = anchors.select("anchor_ind", F.col("obs_ind").alias("start"), F.floor(F.col("obs_ind") / bucket).alias("b"))
    inside = F.lead("start").over(Window.partitionBy("b").orderBy("start"))
    firsts = at.groupBy("b").agg(F.min("start").alias("least"))
    beyond = firsts.select("b", F.lead("least").over(Window.orderBy("b")).alias("beyond"))
    end = F.lit(n_frames) if n_frames else F.col("start") + 1
    return at.withColumn("next", inside).join(beyond, "b").select("anchor_ind", "start", F.coalesce("next", "beyond", end).alias("stop"))


def segment_of(frames: DataFrame, anchors: DataFrame, *, broadcast_rows: int = 100_000, bucket: int = 256) -> DataFrame:
    """frames (obs_ind, ...) with the segment, the last anchor at or before the frame, and the step in it.

    Frames before the first or after the last anchor drop out. An anchor's interval has a row for each bucket of frames that
    it reaches into, and frames meet intervals by bucket; up to broadcast_rows of those rows are broadcast.
    """
    spans = segment_intervals(anchors)
    reach = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))
    spans = small(spans.withColumn("__b", F.explode(reach)), broadcast_rows)
    on = frames.withColumn("__b", F.floor(F.col("obs_ind") / bucket)).join(spans, "__b")
    inside = on.filter((F.col("obs_ind") >= F.col("start")) & (F.col("obs_ind") < F.col("stop")))
    return inside.withColumnRenamed("anchor_ind", "segment").withColumn("step", F.col("obs_ind") - F.col("start")).drop("start", "stop", "__b")


IDENTITY = {"m00": 1.0, "m01": 0.0, "m02": 0.0, "m10": 0.0, "m11": 1.0, "m12": 0.0}


def with_warp(frames: DataFrame, warps: DataFrame, anchors: DataFrame) -> DataFrame:
    """frames (segment, step) with their warp; the last anchor, which has none, gets the identity, others null."""
    last = anchors.agg(F.max("anchor_ind").alias("__last"))
    on = frames.join(small(warps.select("segment", "step", *IDENTITY)), ["segment", "step"], "left").join(F.broadcast(last))
    return on.withColumns({n: F.coalesce(F.col(n), F.when(F.col("segment") == F.col("__last"), F.lit(v))) for n, v in IDENTITY.items()}).drop("__last")


def last_warp(warps: DataFrame) -> DataFrame:
    return warps.groupBy("segment").agg(F.max_by(F.struct("step", *IDENTITY), "step").alias("w")).select("segment", "w.*")


def fill_nodata(cells: DataFrame, nodata: float = -10000.0) -> DataFrame:
    """Cells without data get the least elevation of the others."""
    least = cells.filter(F.col("elev") != nodata).agg(F.min("elev").alias("__least"))
    return cells.join(F.broadcast(least)).withColumn("elev", F.when(F.col("elev") == nodata, F.col("__least")).otherwise(F.col("elev"))).drop("__least")


def elevation_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (xr, yr) with the elevation of their cell, indices clamped into the grid."""
    size = cells.agg(F.max("xr").alias("__mx"), F.max("yr").alias("__my"))
    inside = points.join(F.broadcast(size)).withColumns({"xr": F.greatest(F.lit(0), F.least("xr", "__mx")), "yr": F.greatest(F.lit(0), F.least("yr", "__my"))}).drop("__mx", "__my")
    return inside.join(cells.select("xr", "yr", "elev"), ["xr", "yr"], "left")


def resample(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(xr, yr, elev) on a grid of another size, bilinear between cell centres and clamped at the edges.

    The target's rows are dealt out to the tasks, and each task makes the cells of its own.
    """
    size = cells.agg((F.max("xr") + 1).alias("w"), (F.max("yr") + 1).alias("h"))
    lines = cells.sparkSession.range(height).select(F.col("id").alias("yr"))
    grid = lines.withColumn("xr", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).join(F.broadcast(size))
    sx, sy = (F.col("xr") + 0.5) * F.col("w") / width - 0.5, (F.col("yr") + 0.5) * F.col("h") / height - 0.5
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(v, F.col(n) - 1))
    base = grid.withColumns({"fx": sx - F.floor(sx), "fy": sy - F.floor(sy), "ix": F.floor(sx), "iy": F.floor(sy)})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    four = base.select("*", corner).select(
        "xr", "yr", clamp(F.col("ix") + F.col("c.i"), "w").alias("cx"), clamp(F.col("iy") + F.col("c.j"), "h").alias("cy"),
        (F.when(F.col("c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))).alias("weight"),
    )
    on = four.join(cells.select(F.col("xr").alias("cx"), F.col("yr").alias("cy"), "elev"), ["cx", "cy"])
    return on.groupBy("xr", "yr").agg(F.sum(F.col("weight") * F.col("elev")).alias("elev"))


@dataclass(frozen=True)
class Raster:
    """Cells (xr, yr, elev) and where they lie: the origin and size of a cell, and the offset of the cameras' coordinates."""

    cells: DataFrame
    x_origin: float = 0.0
    pixel_width: float = 1.0
    y_origin: float = 0.0
    pixel_height: float = 1.0
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Search:
    """How the ground is looked for along a ray; height is that of the object, and threshold how near is near enough."""

    height: float = 1.0
    threshold: float = 0.1
    most: int = 50


_INV = [f"i{r}{c}" for r in range(3) for c in range(3)]
_STATE = "mu double, low double, high double, n int, done boolean, found boolean, gx double, gy double, elevation double"
_NAMES = [c.split(" ")[0] for c in _STATE.split(", ")]


def _started(rays: DataFrame) -> DataFrame:
    """rays with the search's state before the first look, and with the matrix corrected for the warp at the depth mu0."""
    moved = {"p03": F.col("p03") - F.col("m02") * F.col("mu0"), "p13": F.col("p13") - F.col("m12") * F.col("mu0")}
    values = (F.col("mu0"), F.lit(0.0), F.lit(float("nan")), F.lit(0), F.lit(False), F.lit(False), *[F.lit(None).cast("double")] * 3)
    return rays.withColumns(moved | dict(zip(_NAMES, values, strict=True)))


#: So many rays of a frame, or fewer, are moved on one by one.
FEW = 7


class _Rays:
    """A batch of rays as arrays, moved on together."""

    def __init__(self, f: pd.DataFrame) -> None:
        self.inv, self.p4, self.u, self.v = f[_INV].to_numpy(float), f[["p03", "p13", "p23"]].to_numpy(float), f["u"].to_numpy(float), f["v"].to_numpy(float)
        self.state = {n: f[n].to_numpy(bool if n in ("done", "found") else int if n == "n" else float).copy() for n in _NAMES}

    def cells(self, at: np.ndarray, r: dict, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(xr, yr, z) of the points at these rays' depths, indices truncated toward zero and clamped into the raster."""
        mu, inv, p4 = self.state["mu"][at], self.inv[at], self.p4[at]
        side = self.u[at] * mu - p4[:, 0], self.v[at] * mu - p4[:, 1], mu - p4[:, 2]
        x, y, z = (inv[:, 3 * k] * side[0] + inv[:, 3 * k + 1] * side[1] + inv[:, 3 * k + 2] * side[2] + r["offset"][k] for k in range(3))
        index = lambda v, origin, step, n: np.clip(np.trunc(np.nan_to_num((v - origin) / step)), 0, n - 1).astype(np.int64)
        return index(x, r["x_origin"], r["pixel_width"], size[0]), index(y, r["y_origin"], r["pixel_height"], size[1]), z

    def advance(self, rows: np.ndarray, grid: np.ndarray, corner: tuple[int, int], r: dict, size: tuple[int, int], how: Search) -> None:
        """Moves these rays on while their cells lie in the grid, whose first cell is at the corner.

        The depth doubles while the point is above the ground, and is halved between the last two sides after that. A search
        ends when it is near enough, or unfound after the look that follows most moves.
        """
        s = self.state
        while True:
            rows = rows[~s["done"][rows]]
            xr, yr, z = self.cells(rows, r, size)
            i, j = yr - corner[1], xr - corner[0]
            here = (i >= 0) & (i < grid.shape[0]) & (j >= 0) & (j < grid.shape[1])
            if not here.any():
                return
            live, ground = rows[here], grid[i[here], j[here]]
            gap = z[here] + how.height - ground
            spent = s["n"][live] > how.most
            near = ~spent & (np.abs(gap) <= how.threshold)
            go = ~spent & ~near
            self._turn(live[go & (gap > 0)], live[go & ~(gap > 0)])
            s["n"][live] += go
            s["done"][live], s["found"][live], s["elevation"][live] = ~go, near, ground
            s["gx"][live], s["gy"][live] = xr[here] * r["pixel_width"] + r["x_origin"], yr[here] * r["pixel_height"] + r["y_origin"]

    def follow(self, k: int, cell: Callable, ends: Callable | None, r: dict, size: tuple[int, int], how: Search) -> tuple[int, int] | None:
        """As advance and skip, for one ray and in plain numbers, which is quicker than arrays of a few.

        cell(yr, xr) is an elevation, or None where it isn't at hand; there ends(yr, xr), a least and a greatest one, may tell
        the way. The result is the cell (xr, yr) that the ray waits for, None if it is done.
        """
        s, inv, (p0, p1, p2), u, v = self.state, self.inv[k].tolist(), self.p4[k].tolist(), self.u.item(k), self.v.item(k)
        mu, low, high, n = (s[c].item(k) for c in ("mu", "low", "high", "n"))
        (ox, oy, oz), (i0, i1, i2, i3, i4, i5, i6, i7, i8), (mx, my) = r["offset"], inv, (size[0] - 1, size[1] - 1)
        x0, dx, y0, dy, height, threshold, most = r["x_origin"], r["pixel_width"], r["y_origin"], r["pixel_height"], how.height, how.threshold, how.most
        waits = None
        while True:
            a, b, c = u * mu - p0, v * mu - p1, mu - p2
            x, y, z = (i0 * a + i1 * b + i2 * c + ox - x0) / dx, (i3 * a + i4 * b + i5 * c + oy - y0) / dy, i6 * a + i7 * b + i8 * c + oz
            xr = int(x) if 0 < x < mx else mx if x >= mx else 0  # nan: 0
            yr = int(y) if 0 < y < my else my if y >= my else 0
            ground = cell(yr, xr)
            if ground is None:
                least, greatest = ends(yr, xr)
                up, down = z + height - greatest > threshold, z + height - least < -threshold
                if n > most or not (up or down):
                    waits = xr, yr
                    break
            else:
                gap = z + height - ground
                if n > most or abs(gap) <= threshold:
                    s["done"][k], s["found"][k], s["elevation"][k] = True, n <= most, ground
                    s["gx"][k], s["gy"][k] = xr * dx + x0, yr * dy + y0
                    break
                up = gap > 0
            if up:
                low, mu = mu, mu * 2 if high != high else (mu + high) / 2
            else:
                high, mu = mu, (low + mu) / 2
            n += 1
        s["mu"][k], s["low"][k], s["high"][k], s["n"][k] = mu, low, high, n
        return waits

    def mean(self, a: int, b: int) -> float:
        """The mean depth of a stretch of rays."""
        mu = self.state["mu"]
        return sum(mu[a:b].tolist()) / (b - a) if b - a <= FEW else float(mu[a:b].mean())

    def skip(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, tile: int, r: dict, size: tuple[int, int], how: Search) -> None:
        """Moves these rays on while the least and greatest elevation of the tile that they look at tell which way."""
        s = self.state
        while True:
            rows = rows[~s["done"][rows] & (s["n"][rows] <= how.most)]
            xr, yr, z = self.cells(rows, r, size)
            above, below = z + how.height - high[yr // tile, xr // tile] > how.threshold, z + how.height - low[yr // tile, xr // tile] < -how.threshold
            rows = rows[above | below]
            if not len(rows):
                return
            self._turn(rows[above[above | below]], rows[below[above | below]])
            s["n"][rows] += 1

    def _turn(self, up: np.ndarray, down: np.ndarray) -> None:
        """The next depth of rays above the ground, and of those in it."""
        s = self.state
        s["low"][up], s["high"][down] = s["mu"][up], s["mu"][down]
        s["mu"][up] = np.where(np.isnan(s["high"][up]), s["mu"][up] * 2, (s["mu"][up] + s["high"][up]) / 2)
        s["mu"][down] = (s["low"][down] + s["mu"][down]) / 2


def _advance(f: pd.DataFrame, grid: np.ndarray, corner: tuple[int, int], r: dict, size: tuple[int, int], how: Search) -> pd.DataFrame:
    rays = _Rays(f)
    rays.advance(np.arange(len(f)), grid, corner, r, size, how)
    return f.assign(**rays.state)


def _whole_grid(cells: DataFrame, size: tuple[int, int]) -> np.ndarray:
    """The raster as an array; cells that aren't there have the least elevation."""
    got = cells.select("xr", "yr", "elev").toArrow()
    grid = np.full((size[1], size[0]), np.nan)
    grid[got["yr"].to_numpy(), got["xr"].to_numpy()] = got["elev"].to_numpy()
    return np.where(np.isnan(grid), np.nanmin(grid) if len(got) else 0.0, grid)


def _sized(raster: Raster) -> tuple[tuple[int, int], int, float]:
    size = raster.cells.agg(F.max("xr"), F.max("yr"), F.count("*"), F.min("elev")).first()
    return ((size[0] or 0) + 1, (size[1] or 0) + 1), size[2], size[3] or 0.0


#: A pyramid has so many tiles at most: its tiles grow with the raster.
MOST_TILES = 1 << 20


@dataclass(frozen=True)
class Pyramid:
    """A raster made ready for searches: either small enough to go to the tasks whole (grid), or packed in tiles.

    tiles is a written table (tx, ty, cells: a tile's elevations as doubles by rows); low and high have the least and greatest
    elevation of each tile. There are MOST_TILES of these at most.
    """

    raster: Raster
    size: tuple[int, int]
    grid: np.ndarray | None
    tile: int = 0
    tiles: DataFrame | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def place(self) -> dict:
        return {k: getattr(self.raster, k) for k in ("x_origin", "pixel_width", "y_origin", "pixel_height", "offset")}


def pyramid(raster: Raster | Pyramid, *, limit_cells: int = 4_000_000, tile: int = 256) -> Pyramid:
    """The raster made ready; one of more than limit_cells is packed in tiles, by the tasks. Cells that aren't there have the
    least elevation."""
    if isinstance(raster, Pyramid):
        return raster
    size, n, least = _sized(raster)
    if n <= limit_cells:
        return Pyramid(raster, size, _whole_grid(raster.cells, size))
    while -(-size[0] // tile) * -(-size[1] // tile) > MOST_TILES:
        tile *= 2

    def pack(table: pa.Table) -> pa.Table:
        tx, ty = table["tx"][0].as_py(), table["ty"][0].as_py()
        grid = np.full((min(tile, size[1] - ty * tile), min(tile, size[0] - tx * tile)), least)
        grid[table["yr"].to_numpy() - ty * tile, table["xr"].to_numpy() - tx * tile] = table["elev"].to_numpy()
        return pa.table({"tx": [tx], "ty": [ty], "low": [grid.min()], "high": [grid.max()], "cells": pa.array([grid.tobytes()], pa.binary())})

    at = raster.cells.select(*(F.floor(F.col(c) / tile).cast("long").alias(t) for c, t in (("xr", "tx"), ("yr", "ty"))), *(F.col(c).cast("long").alias(c) for c in ("xr", "yr")), F.col("elev").cast("double"))
    tiles = cut(at.groupBy("tx", "ty").applyInArrow(pack, "tx long, ty long, low double, high double, cells binary"), "pyramid")
    ends = tiles.select("tx", "ty", "low", "high").toArrow()
    shape = -(-size[1] // tile), -(-size[0] // tile)
    low, high = np.full(shape, least), np.full(shape, least)
    low[ends["ty"].to_numpy(), ends["tx"].to_numpy()], high[ends["ty"].to_numpy(), ends["tx"].to_numpy()] = ends["low"].to_numpy(), ends["high"].to_numpy()
    return Pyramid(raster, size, None, tile, tiles, low, high)


def ground_points(rays: DataFrame, raster: Raster | Pyramid, how: Search = Search(), *, limit_cells: int = 4_000_000, tile: int = 256) -> DataFrame:
    """rays (i00..i22, p03, p13, p23, m02, m12, u, v, mu0, ...) with gx, gy, found, mu and elevation of the ground they show.

    The search begins at the depth mu0; gx and gy are world coordinates of the cell that it ended in. A raster of up to
    limit_cells goes to the tasks whole. Of a larger one tiles' least and greatest elevations do; they tell which way most
    looks go (above a tile's greatest elevation a ray is in the air, below its least in the ground), and only where they
    don't is a ray brought together with its tile. So a ray meets a handful of tiles, and no cell is shuffled but in a tile
    that is needed. Rays that need one tile are dealt out to several tasks; each round is written to the shared folder. A
    stream needs a raster within the limit. To search one raster several times, make it ready first (pyramid).
    """
    ready = pyramid(raster, limit_cells=limit_cells, tile=tile)
    r, size = ready.place, ready.size
    state = _started(rays)
    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in state.schema)
    drop = ["low", "high", "n", "done"]
    if ready.grid is not None:
        sent = rays.sparkSession.sparkContext.broadcast(ready.grid)

        def run(frames):
            for f in frames:
                yield _advance(f, sent.value, (0, 0), r, size, how)

        return state.mapInPandas(run, kinds).drop(*drop)
    if rays.isStreaming:
        raise ValueError(f"a raster of {size[0]} x {size[1]} cells is too large for a stream: place its rows batch by batch")
    return _by_tiles(state, ready, kinds, how).drop(*drop)


def _by_tiles(state: DataFrame, ready: Pyramid, kinds: str, how: Search, *, rays_a_task: int = 50_000) -> DataFrame:
    columns, r, size, tile = state.columns, ready.place, ready.size, ready.tile
    ends = state.sparkSession.sparkContext.broadcast((ready.low, ready.high))

    def placed(f: pd.DataFrame, rays: _Rays) -> pd.DataFrame:
        """Rays moved on as far as the tiles' ends tell, with the tile that each needs next."""
        rays.skip(np.arange(len(rays.u)), *ends.value, tile, r, size, how)
        xr, yr, _ = rays.cells(np.arange(len(f)), r, size)
        return f.assign(**rays.state, tx=xr // tile, ty=yr // tile)

    def look(frames):
        for f in frames:
            yield placed(f, _Rays(f))

    def move(key, mine, tiles):
        rays, (tx, ty) = _Rays(mine), (int(key[0]), int(key[1]))
        shape = min(tile, size[1] - ty * tile), min(tile, size[0] - tx * tile)
        grid = np.frombuffer(tiles["cells"].iloc[0]).reshape(shape) if len(tiles) else np.full(shape, ends.value[0][ty, tx])
        before = -1
        while (left := int(rays.state["n"].sum() + rays.state["done"].sum())) != before:  # tiles' ends may lead a ray back
            before = left
            rays.advance(np.arange(len(mine)), grid, (tx * tile, ty * tile), r, size, how)
            rays.skip(np.arange(len(rays.u)), *ends.value, tile, r, size, how)
        return placed(mine[columns], rays)[[*columns, "tx", "ty"]]

    at, ended = cut(state.mapInPandas(look, f"{kinds}, tx long, ty long"), "rays"), []
    while not at.isEmpty():
        parts = cut(at.groupBy("tx", "ty").agg(F.ceil(F.count("*") / rays_a_task).alias("parts")), "rays-tiles")
        mine = at.join(parts, ["tx", "ty"]).withColumn("part", F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in columns)}), parts)"))
        needed = parts.select("tx", "ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        theirs = ready.tiles.select("tx", "ty", "cells").join(small(needed), ["tx", "ty"])
        moved = cut(mine.groupBy("tx", "ty", "part").cogroup(theirs.groupBy("tx", "ty", "part")).applyInPandas(move, f"{kinds}, tx long, ty long"), "rays-moved")
        ended.append(moved.filter("done").drop("tx", "ty"))
        at = moved.filter("not done")
    return reduce(DataFrame.unionByName, ended) if ended else state


def ground_points_carried(
    rays: DataFrame, raster: Raster | Pyramid, how: Search = Search(), *, by: str = "observation_id", order: str = "obs_ind", limit_cells: int = 50_000_000,
    tile: int = 256,
) -> DataFrame:
    """As ground_points, but the mean depth found in a frame is where the search of the next frame's rays begins.

    Frames follow one another, so an observation is gone through in one task, a frame at a time; only the frame at hand is
    held. Observations run side by side. A raster of up to limit_cells goes to the tasks whole. Beyond it, a task has the
    tiles' least and greatest elevations and those tiles that its observation has come upon: where a frame needs another one,
    the observation waits, and goes on from there in the next round with that tile and its neighbours. So there are about as
    many rounds as times that the longest flight comes to new ground, and no limit to the raster.
    """
    if isinstance(raster, Pyramid):
        raster = raster.raster
    size, n, _ = _sized(raster)
    if n > limit_cells:
        return _carried_by_tiles(rays, pyramid(raster, limit_cells=0, tile=tile), how, by, order)
    r = {k: getattr(raster, k) for k in ("x_origin", "pixel_width", "y_origin", "pixel_height", "offset")}
    sent = rays.sparkSession.sparkContext.broadcast(_whole_grid(raster.cells, size))
    raw = rays.withColumns({"__p03": F.col("p03"), "__p13": F.col("p13")})
    state = _started(raw)
    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in state.schema)

    def run(batches):
        carried: tuple = (None, 0.0)  # the observation, and the depth that its last frame gave

        def frames(f: pd.DataFrame) -> pd.DataFrame:
            """f holds whole frames."""
            nonlocal carried
            rays, who, when, warp = _Rays(f), f[by].to_numpy(), f[order].to_numpy(), f[["m02", "m12"]].to_numpy(float)
            raw = f[["__p03", "__p13"]].to_numpy(float)
            edges = np.r_[0, np.flatnonzero((who[1:] != who[:-1]) | (when[1:] != when[:-1])) + 1, len(f)]
            grid = sent.value
            for a, b in pairwise(edges.tolist()):
                mu = carried[1] if carried[0] == who[a] else 0.0
                if mu:
                    rays.state["mu"][a:b] = mu
                    rays.p4[a:b, :2] = raw[a:b] - warp[a:b] * mu
                if b - a <= FEW:
                    for k in range(a, b):
                        rays.follow(k, grid.item, None, r, size, how)
                else:
                    rays.advance(np.arange(a, b), grid, (0, 0), r, size, how)
                carried = who[a], rays.mean(a, b) or mu
            return f.assign(**rays.state)

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held[by] == held[by].iloc[-1]) & (held[order] == held[order].iloc[-1]) if len(held) else None
            if last is not None and not last.all():
                yield frames(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield frames(held)

    out = state.repartition(F.col(by)).sortWithinPartitions(by, order).mapInPandas(run, kinds)
    return out.drop("low", "high", "n", "done", "__p03", "__p13")


def _carried_by_tiles(rays: DataFrame, ready: Pyramid, how: Search, by: str, order: str) -> DataFrame:
    spark, r, size, tile = rays.sparkSession, ready.place, ready.size, ready.tile
    ends = spark.sparkContext.broadcast((ready.low, ready.high))
    begun = {"__begun": F.lit(False), "__start": F.lit(0.0)}  # the frame that an observation waits in has been begun at a depth
    state = _started(rays.withColumns({"__p03": F.col("p03"), "__p13": F.col("p13")})).withColumns(begun)
    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in state.schema)
    columns, extra = state.columns, "__tx long, __ty long, __cells binary"
    names = [c.split(" ")[0] for c in extra.split(", ")]

    def walk(mine: _Rays, rows: np.ndarray, tiles: dict) -> set[tuple[int, int]]:
        """Moves rays on; the tiles that they still need, none if all are done."""
        if len(rows) <= FEW:
            low, high = ends.value

            def cell(yr: int, xr: int) -> float | None:
                grid = tiles.get((xr // tile, yr // tile))
                return None if grid is None else grid.item(yr % tile, xr % tile)

            def least_and_greatest(yr: int, xr: int) -> tuple[float, float]:
                return low.item(yr // tile, xr // tile), high.item(yr // tile, xr // tile)

            left = [k for k in rows.tolist() if not mine.state["done"][k]]
            waits = [mine.follow(k, cell, least_and_greatest, r, size, how) for k in left]
            return {(at[0] // tile, at[1] // tile) for at in waits if at}
        while True:
            mine.skip(rows, *ends.value, tile, r, size, how)
            left = rows[~mine.state["done"][rows]]
            xr, yr, _ = mine.cells(left, r, size)
            needed = np.stack([xr // tile, yr // tile], 1)
            some = {tuple(k) for k in np.unique(needed, axis=0).tolist()} if len(left) else set()
            if not some & tiles.keys():
                return some
            for tx, ty in some & tiles.keys():
                mine.advance(left[(needed == (tx, ty)).all(1)], tiles[tx, ty], (tx * tile, ty * tile), r, size, how)

    def around(keys: set[tuple[int, int]]) -> list[tuple[int, int]]:
        return sorted({(x + i, y + j) for x, y in keys for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= x + i < ready_shape[1] and 0 <= y + j < ready_shape[0]})

    ready_shape = ready.low.shape

    def run(batches):
        who, tiles, depth, waits, held = None, {}, 0.0, False, None

        def frames(f: pd.DataFrame) -> list[pd.DataFrame]:
            """f holds whole frames of one observation."""
            nonlocal depth, waits
            if waits:
                return [f]
            mine, when, warp, raw = _Rays(f), f[order].to_numpy(), f[["m02", "m12"]].to_numpy(float), f[["__p03", "__p13"]].to_numpy(float)
            start, go_on = f["__start"].to_numpy(float).copy(), f["__begun"].to_numpy(bool).copy()
            edges, missing = np.r_[0, np.flatnonzero(when[1:] != when[:-1]) + 1, len(f)], set()
            for a, b in pairwise(edges.tolist()):
                rows = np.arange(a, b)
                if go_on[a]:
                    depth = start[a]
                elif depth:
                    mine.state["mu"][rows] = depth
                    mine.p4[rows, :2] = raw[rows] - warp[rows] * depth
                if missing := walk(mine, rows, tiles):
                    start[rows], go_on[rows], waits = depth, True, True
                    break
                go_on[rows], depth = False, mine.mean(a, b) or depth
            out = [f.assign(**mine.state, p03=mine.p4[:, 0], p13=mine.p4[:, 1], __start=start, __begun=go_on)]
            keys = around(missing)
            asks = f.iloc[np.zeros(len(keys), int)].reset_index(drop=True)
            return [*out, asks.assign(__tx=[x for x, _ in keys], __ty=[y for _, y in keys])] if keys else out

        def part(f: pd.DataFrame) -> list[pd.DataFrame]:
            nonlocal who, tiles, depth, waits
            out = []
            for k, own in f.groupby(by, sort=False):
                if k != who:
                    who, tiles, depth, waits = k, {}, 0.0, False
                grids = own["__cells"].notna()
                for tx, ty, cells in own.loc[grids, names].itertuples(index=False):
                    tx, ty = int(tx), int(ty)
                    tiles[tx, ty] = np.frombuffer(cells).reshape(min(tile, size[1] - ty * tile), min(tile, size[0] - tx * tile))
                if not grids.all():
                    out += frames(own[~grids].reset_index(drop=True))
            return out

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                last = (held[by] == held[by].iloc[-1]) & ((held[order] == held[order].iloc[-1]) | held["__cells"].notna().iloc[-1])
                if not last.all():
                    yield from part(held[~last])
                    held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield from part(held)

    none = {n: F.lit(None).cast(kind) for n, kind in (c.split(" ") for c in extra.split(", "))}
    live, wanted, ended = state.withColumns(none), None, []
    while True:
        rows = live
        if wanted is not None:
            grids = ready.tiles.select(F.col("tx").alias("__tx"), F.col("ty").alias("__ty"), F.col("cells").alias("__cells")).join(small(wanted), ["__tx", "__ty"])
            rows = live.unionByName(grids, allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(False if c != "n" else 0)) for c in ("done", "found", "__begun", "n")})
        dealt = rows.select(*columns, *names).repartition(F.col(by)).sortWithinPartitions(by, F.col("__cells").isNull(), order)
        found = cut(dealt.mapInPandas(run, f"{kinds}, {extra}"), "carried")
        asks = found.filter("__tx is not null").select(by, "__tx", "__ty")
        wanted = cut(asks.unionByName(wanted).distinct() if wanted is not None else asks.distinct(), "carried-tiles")
        rest = found.filter("__tx is null")
        ended.append(rest.filter("done and not __begun"))
        live = rest.filter("not (done and not __begun)")
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended).drop("low", "high", "n", "done", "__p03", "__p13", *begun, *names)


def camera_rays(frames: DataFrame, cameras: DataFrame, mu: Column | float, *, height_px: int = 480) -> DataFrame:
    """frames (segment, warp, col_px, row_px) as rays: the camera's matrix and inverse, the pixel (v counts up from the
    lower edge) turned by the warp, and the depth mu0 at which the search begins."""
    on = frames.join(small(cameras.withColumnRenamed("anchor_ind", "segment")), "segment")
    inv = G.inverse3([F.col(f"p{r}{c}") for r in range(3) for c in range(3)])
    u, v = F.col("col_px"), F.lit(height_px) - F.col("row_px")
    turned = {"u": F.col("m00") * u + F.col("m01") * v, "v": F.col("m10") * u + F.col("m11") * v}
    return on.withColumns(turned | dict(zip(_INV, inv, strict=True)) | {"mu0": F.lit(mu) if isinstance(mu, float) else mu})


def track_rays(tracks: DataFrame, anchors: DataFrame, warps: DataFrame, cameras: DataFrame, mu: float) -> DataFrame:
    """The rays of all track points in a segment, by the segment's camera and the step's warp."""
    return camera_rays(with_warp(segment_of(tracks, anchors), warps, anchors).filter("m00 is not null"), cameras, mu)


def segment_errors(tracks: DataFrame, anchors: DataFrame, warps: DataFrame, cameras: DataFrame, raster: Raster, mu: float, how: Search = Search(), **options) -> DataFrame:
    """(segment, track_id, ex, ey): how far a track's point at the next anchor's frame jumps there.

    It is placed by this segment's last warp, twice (the second time from the mean depth of the first), and by the next
    anchor's camera from the mean depth of that. Segments before the last anchor have a next one.
    """
    starts = anchors.select((F.col("anchor_ind") - 1).alias("segment"), "obs_ind")
    points = tracks.select("track_id", "obs_ind", "row_px", "col_px").join(small(starts), "obs_ind")
    old = points.join(small(last_warp(warps).drop("step")), "segment")
    first = warps.filter("step = 0").select(F.col("segment").alias("__s"), *IDENTITY)
    ahead = points.withColumn("__s", F.col("segment") + 1).join(small(first), "__s", "left")
    ahead = ahead.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in IDENTITY.items()})

    raster = pyramid(raster, **options)

    def placed(at: DataFrame, depth: DataFrame | None, camera: Column) -> DataFrame:
        seeded = at.withColumn("__mu", F.lit(mu)) if depth is None else at.join(small(depth), "segment").withColumnRenamed("depth", "__mu")
        rays = camera_rays(seeded.withColumnRenamed("segment", "home").withColumn("segment", camera), cameras, F.col("__mu"))
        got = ground_points(rays, raster, how)
        return cut(got.select(F.col("home").alias("segment"), "track_id", "gx", "gy", "mu"), "segment-error")

    depth = lambda df: df.groupBy("segment").agg(F.avg("mu").alias("depth"))
    once = placed(old, None, F.col("home"))
    twice = placed(old, depth(once), F.col("home"))
    after = placed(ahead, depth(twice), F.col("home") + 1).select("segment", "track_id", F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    return twice.join(after, ["segment", "track_id"]).select("segment", "track_id", (F.col("nx") - F.col("gx")).alias("ex"), (F.col("ny") - F.col("gy")).alias("ey"))


def step_biases(errors: DataFrame, warps: DataFrame) -> DataFrame:
    """(segment, track_id, bx, by): each step's share of the segment's error; none in the last segment that has warps."""
    steps = warps.groupBy("segment").agg(F.count("*").alias("steps"))
    last = warps.agg(F.max("segment").alias("last"))
    on = errors.join(small(steps), "segment").join(F.broadcast(last)).filter("segment < last")
    return on.select("segment", "track_id", *((F.col(e) / F.col("steps")).alias(b) for e, b in (("ex", "bx"), ("ey", "by"))))


def with_bias(points: DataFrame, biases: DataFrame) -> DataFrame:
    """points (segment, track_id, step, gx, gy, ...) with x and y: the ground point and the step's share of the error."""
    on = points.join(biases, ["segment", "track_id"], "left")
    return on.withColumns({n: F.col(g) + F.coalesce(F.col(b), F.lit(0.0)) * F.col("step") for n, g, b in (("x", "gx", "bx"), ("y", "gy", "by"))})


def anchor_selection(inliers: DataFrame, threshold: int, most_pseudo: int) -> DataFrame:
    """inliers (video_id, frame, n_inliers) with what each frame becomes.

    The first frame is an anchor; low frames use up pseudo anchors, and the one after most_pseudo of them makes the frame
    before it an anchor and starts over. low_no counts low frames of the video.
    """
    order = Window.partitionBy("video_id").orderBy("frame")
    low = (F.col("n_inliers") < threshold).cast("long")
    first = F.row_number().over(order) == 1
    counted = inliers.withColumn("low_no", F.sum(low).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pseudo = (F.col("n_inliers") < threshold) & (F.col("low_no") % (most_pseudo + 1) != 0)
    promoted = (F.col("n_inliers") < threshold) & (F.col("low_no") % (most_pseudo + 1) == 0)
    kind = F.when(first, "anchor").when(promoted, "promotes_previous").when(pseudo, "pseudo").otherwise("plain")
    return counted.withColumn("kind", kind)


def anchor_list(selected: DataFrame) -> DataFrame:
    """(video_id, frame) of the anchors of anchor_selection's frames: the first, each frame before one that promotes it, and
    at the end the number of frames, one past the last."""
    promoted = selected.filter("kind = 'promotes_previous'").select("video_id", (F.col("frame") - 1).alias("frame"))
    ends = selected.groupBy("video_id").agg((F.max("frame") + 1).alias("frame"))
    return selected.filter("kind = 'anchor'").select("video_id", "frame").unionByName(promoted).unionByName(ends)


def pseudo_usage(selected: DataFrame, most_pseudo: int) -> DataFrame:
    """(video_id, anchor_no, pseudo): the pseudo anchors used in each stretch between two promotions."""
    return selected.groupBy("video_id", F.floor(F.col("low_no") / (most_pseudo + 1)).alias("anchor_no")).agg(F.count_if(F.col("kind") == "pseudo").alias("pseudo"))


def anchor_frames(anchors: DataFrame, frames: DataFrame, *, key: str = "observation_id", most_anchors: int = 500_000, most_frames: int = 4_000_000) -> DataFrame:
    """(key, anchor_ind, obs_ind): for each anchor (key, anchor_ind, image_name) in order, the first frame (key, frame_ind,
    path), not before that of the anchor before it, whose path contains the name. Anchors without one are left out.

    Frames meet anchors by the last part of the path; only names that no frame has in that place are looked for inside
    the paths. Names may repeat: each is looked for once, and its frames are rows, so what is written doesn't grow with the
    anchors that share a name. An observation goes through its anchors and its frames in order, a block of each at a time
    (about most_anchors and most_frames rows), in rounds; in a round the observations run side by side. So there are about
    as many rounds as the longest one has blocks, and a task holds two blocks.
    """
    kind = anchors.schema[key].dataType.simpleString()
    ordered = anchors.select(key, F.col("anchor_ind").cast("long").alias("anchor_ind"), "image_name")
    paths = frames.select(key, F.col("frame_ind").cast("long").alias("frame_ind"), "path")
    names = ordered.select(key, "image_name").distinct()
    equal = cut(paths.withColumn("image_name", F.regexp_extract("path", "[^/]+$", 0)).join(small(names), [key, "image_name"]).select(key, "image_name", "frame_ind"), "anchors-equal")
    rest = cut(names.join(equal.select(key, "image_name").distinct(), [key, "image_name"], "left_anti"), "anchors-rest")
    found = equal
    if not rest.isEmpty():
        inside = paths.select(key, "path").distinct().join(small(rest.withColumnRenamed(key, "__key")), (F.col(key) == F.col("__key")) & F.col("path").contains(F.col("image_name")))
        found = equal.unionByName(paths.join(small(cut(inside.select(key, "path", "image_name"), "anchors-inside")), [key, "path"]).select(key, "image_name", "frame_ind"))
    last = found.groupBy(key, "image_name").agg(F.max("frame_ind").alias("last"))
    each = ordered.join(small(last), [key, "image_name"]).groupBy(key, "anchor_ind").agg(F.collect_set("image_name").alias("names"), F.max("last").alias("last"))
    steps, places = cut(_in_blocks(each, key, "anchor_ind", most_anchors), "anchors-steps"), cut(_in_blocks(found, key, "frame_ind", most_frames), "anchors-frames")

    at = f"{key} {kind}, a long, f long, begin long, reached long, blocks long"
    fields = [c.split(" ")[0] for c in at.split(", ")] + ["anchor_ind", "obs_ind"]

    def walk(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The anchors of a block on the frames of a block, and at the end where to go on."""
        own, first = _frames_of_names(theirs), {c: mine[c][0].as_py() for c in fields[:6]}
        reached, out, waits = first["reached"], [], None
        for k, called, end in sorted(zip(*(mine[c].to_pylist() for c in ("anchor_ind", "names", "last")), strict=True)):
            if k < first["begin"] or (reached is not None and end < reached):
                continue
            ahead = [int(f[i]) for f in (own[n] for n in called if n in own) if (i := 0 if reached is None else f.searchsorted(reached)) < len(f)]
            if not ahead:
                waits = k
                break
            reached = min(ahead)
            out.append((k, reached))
        go_on = {"a": first["a"] + (waits is None), "f": first["f"] + (waits is not None), "begin": first["begin"] if waits is None else waits, "reached": reached}
        n = len(out)
        columns = [pa.array([first[key]] * (n + 1), mine.schema.field(key).type)] + [pa.array([None] * n + [(first | go_on)[c]], pa.int64()) for c in fields[1:6]]
        return pa.table([*columns, *(pa.array([*(r[c] for r in out), None], pa.int64()) for c in (0, 1))], names=fields)

    start = (F.lit(v).cast("long").alias(n) for n, v in (("a", 1), ("f", 1), ("begin", -(1 << 63)), ("reached", None)))
    live, rounds = cut(steps.groupBy(key).agg(F.max("block").alias("blocks")).select(key, *start, "blocks"), "anchors-live"), []
    while not live.isEmpty():
        mine = steps.withColumnRenamed("block", "a").join(small(live), [key, "a"]).select(*fields[:6], "anchor_ind", "names", "last")
        theirs = places.withColumnRenamed("block", "f").join(small(live.select(key, "f")), [key, "f"]).select(key, "image_name", "frame_ind")
        got = cut(mine.groupBy(key).cogroup(theirs.groupBy(key)).applyInArrow(walk, f"{at}, anchor_ind long, obs_ind long"), "anchors-round")
        rounds.append(got.filter("a is null").select(key, "anchor_ind", "obs_ind"))
        live = got.filter("a <= blocks").select(*fields[:6])
    return reduce(DataFrame.unionByName, rounds) if rounds else steps.select(key, "anchor_ind", F.col("last").alias("obs_ind"))


def _in_blocks(rows: DataFrame, key: str, order: str, most: int, *, wide: int = 1 << 16) -> DataFrame:
    """rows with the block of the key's order that each lies in, from 1: stretches of about most rows, cut between numbers of the order."""
    wide = min(wide, most)
    at = rows.withColumn("__b", F.floor(F.col(order) / wide))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("__b")) - F.col("n")
    block = F.dense_rank().over(Window.partitionBy(key).orderBy(F.floor(F.col("before") / most))).cast("long")
    blocks = at.groupBy(key, "__b").agg(F.count("*").alias("n")).withColumn("before", before).select(key, "__b", block.alias("block"))
    return at.join(small(blocks), [key, "__b"]).drop("__b")


def _frames_of_names(frames: pa.Table) -> dict[str, np.ndarray]:
    """Each name's frames in order."""
    named = frames["image_name"].combine_chunks().dictionary_encode()
    code, at = named.indices.to_numpy(), frames["frame_ind"].to_numpy()
    order = np.lexsort((at, code))
    return dict(zip(named.dictionary.to_pylist(), np.split(at[order], np.flatnonzero(np.diff(code[order])) + 1), strict=True)) if len(at) else {}


def truth_frames(log: DataFrame, frames: DataFrame, *, for_test: bool = False) -> DataFrame:
    """(frame, obs_ind) of the log's frames (frame, used_in_map, test_frame) that are used in the map.

    A used frame has its own index in frames (obs_ind), or that of the frame two before it, or, if it is the last, the last
    frame; else it drops out. for_test leaves out the frames that are for testing.
    """
    used = log.filter("used_in_map and not test_frame" if for_test else "used_in_map").select("frame")
    ends = frames.agg(F.max("obs_ind").alias("__most")).join(F.broadcast(used.agg(F.max("frame").alias("__last"))))
    own = used.join(frames.select(F.col("obs_ind").alias("frame"), F.col("obs_ind").alias("__a")), "frame", "left")
    near = own.join(frames.select((F.col("obs_ind") + 2).alias("frame"), F.col("obs_ind").alias("__b")), "frame", "left").join(F.broadcast(ends))
    found = F.coalesce("__a", "__b", F.when(F.col("frame") == F.col("__last"), F.col("__most")))
    return near.select("frame", found.alias("obs_ind")).filter("obs_ind is not null")


def clean_anchors(anchors: DataFrame, cameras: DataFrame) -> DataFrame:
    """Anchors whose image has a camera matrix."""
    return anchors.join(cameras, "image_name", "left_semi")


def clean_flight_log(log: DataFrame, cameras: DataFrame, *, seen: Observation | None = None) -> DataFrame:
    """log (frame_name, used_in_map, test_frame, ...): frames without a camera matrix are neither used nor for testing. seen
    gets the number of frames that were used or for testing (cleared), once an action has run."""
    known = cameras.select(F.col("image_name").alias("frame_name"), F.lit(True).alias("__known")).distinct()
    on = log.join(small(known), "frame_name", "left")
    if seen:
        on = on.observe(seen, F.count_if(F.col("__known").isNull() & (F.col("used_in_map") | F.col("test_frame"))).alias("cleared"))
    return on.withColumns({c: F.col(c) & F.col("__known").isNotNull() for c in ("used_in_map", "test_frame")}).drop("__known")


def frames_per_flight(frames: DataFrame, flight: str) -> DataFrame:
    """(flight, n, before): the frames of each flight and of all flights before it. There are few flights."""
    n = frames.groupBy(F.col(flight).alias("flight")).agg(F.count("*").alias("n"))
    before = Window.orderBy("flight").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mean_mu(points: DataFrame, frame: Column, mu: Column) -> DataFrame:
    """(frame, mu): the mean depth of the tracks present in a frame; where none has one, 0."""
    return points.groupBy(frame.alias("frame")).agg(F.coalesce(F.avg(mu), F.lit(0.0)).alias("mu"))


def inliers_per_segment(warps: DataFrame, threshold: int, most_pseudo: int) -> DataFrame:
    """(segment, least, mean, low, over_limit) of the inliers of a segment's warps."""
    low = F.count_if(F.col("n_inliers") < threshold)
    return warps.groupBy("segment").agg(F.min("n_inliers").alias("least"), F.avg("n_inliers").alias("mean"), low.alias("low"), (low > most_pseudo).alias("over_limit"))


def map_bundle(cameras: DataFrame, offsets: DataFrame, raster: DataFrame, *, key: str = "observation_id") -> DataFrame:
    """cameras (key, p03, p13, p23, ...) with their project's offset (key, ox, oy, oz) and the size of its raster (key, xr,
    yr, elev): width, height, cells and least elevation. Projects without an offset or a raster have nulls there."""
    shape = raster.groupBy(key).agg((F.max("xr") + 1).alias("width"), (F.max("yr") + 1).alias("height"), F.count("*").alias("n_cells"), F.min("elev").alias("least"))
    return cameras.join(small(offsets), key, "left").join(small(shape), key, "left")


def _product(a: tuple, b: tuple) -> tuple:
    """Of two affine warps as six numbers by rows, b first."""
    return (
        a[0] * b[0] + a[1] * b[3], a[0] * b[1] + a[1] * b[4], a[0] * b[2] + a[1] * b[5] + a[2],
        a[3] * b[0] + a[4] * b[3], a[3] * b[1] + a[4] * b[4], a[3] * b[2] + a[4] * b[5] + a[5],
    )


def warp_chain(warps: DataFrame) -> DataFrame:
    """(segment, step, c00..c12): the product of the segment's warps up to each step. Segments may have any length: products
    of the ranges before give what a range begins with."""
    names = list(IDENTITY)
    chain = lambda state, row: (state and _product(state, row[1:])) or row[1:]
    fold = Fold(None, lambda state, row: (chain(state, row),) * 2, None, chain, lambda total, state: _product(state, total) if state else total)
    schema = f"segment {warps.schema['segment'].dataType.simpleString()}, step long, " + ", ".join(f"{n.replace('m', 'c')} double" for n in names)
    return range_scan(warps.withColumn("step", F.col("step").cast("long")), "segment", "step", names, fold, schema)

"""Density surfaces over bounded grids: KDE, hotspots, geographic profiles, Hawkes intensity, Gaussian process."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct.blocks.far_field import cauchy_sums
from precinct.blocks.ranks import global_cumulate
from precinct.blocks.shared import materialize
from precinct.functions.geo import KM_PER_DEGREE

MAX_GRID = 500


def bandwidths(points: DataFrame, mult: float = 1.0) -> dict[str, float]:
    """Silverman's rule for each axis, the count and the bounding box, in one pass."""
    r = points.agg(F.count("*").alias("n"), F.stddev_samp("lat").alias("sy"), F.stddev_samp("lon").alias("sx"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1")).first().asDict()
    for axis in "yx":
        r[f"h{axis}"] = 0.01 if r["n"] < 2 else max(1.06 * r[f"s{axis}"] * r["n"] ** -0.2 * mult, 1e-6)
    return r


def accumulate(points: DataFrame, lats: np.ndarray, lons: np.ndarray, kernel, columns: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """(row, value array): each partition adds its points' grids up, then rows of partial grids meet by row number.

    kernel(points, lats, lons) gives the sum over its points as a len(lats) x len(lons) array."""
    assert len(lats) <= MAX_GRID and len(lons) <= MAX_GRID

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                part = kernel(pdf.iloc[k : k + 2000], lats, lons)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"row": range(len(lats)), "value": list(total)})

    part = points.select(*columns).mapInPandas(run, "row int, value array<double>")
    cells = part.select("row", F.posexplode("value").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("value"))
    place = lambda x, i: F.element_at(F.array(*[F.lit(float(v)) for v in x]), F.col(i) + 1)
    return cells.withColumns({"lat": place(lats, "row"), "lon": place(lons, "col")})


def gaussian_sum(hy: float, hx: float):
    """Separable Gaussian kernels: one matrix product for all points."""

    def kernel(p: pd.DataFrame, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
        a = np.exp(-0.5 * ((lats[:, None] - p["lat"].to_numpy()) / hy) ** 2)
        b = np.exp(-0.5 * ((lons[:, None] - p["lon"].to_numpy()) / hx) ** 2)
        return a @ b.T

    return kernel


def kde(points: DataFrame, n: int = 50, bbox: tuple | None = None, mult: float = 1.0) -> DataFrame:
    """row, col, lat, lon, density (sums to 1) at the centres of n x n cells."""
    points = materialize(points.filter("lat is not null and lon is not null").select("lat", "lon"), "kde-points")
    n = max(n, 4)
    b = bandwidths(points, mult)
    y0, y1, x0, x1 = bbox or (b["y0"], b["y1"], b["x0"], b["x1"])
    dy, dx = (y1 - y0) / n, (x1 - x0) / n
    lats, lons = y0 + (np.arange(n) + 0.5) * dy, x0 + (np.arange(n) + 0.5) * dx
    out = accumulate(points, lats, lons, gaussian_sum(max(b["hy"], dy / 2), max(b["hx"], dx / 2)))
    total = F.sum("value").over(Window.partitionBy())  # over the cells of a bounded grid
    return out.select("row", "col", "lat", "lon", (F.col("value") / total).alias("density"))


def hotspots(surface: DataFrame, points: DataFrame, top_k: int = 5, radius: float = 0.02) -> DataFrame:
    """Greedy peaks with a suppression radius: rank, lat, lon, peak density, mass and points inside the box around it."""
    cells = materialize(surface, "surface")
    peaks: list[tuple] = []
    for rank in range(1, top_k + 1):
        free = cells.filter("density > 0")
        for _, y, x, _ in peaks:
            free = free.filter((F.col("lat") - y) ** 2 + (F.col("lon") - x) ** 2 > radius * radius)
        best = free.orderBy(F.desc("density"), "row", "col").limit(1).collect()
        if not best:
            break
        peaks.append((rank, best[0]["lat"], best[0]["lon"], best[0]["density"]))
    spots = cells.sparkSession.createDataFrame(peaks, "rank int, lat double, lon double, peak double")
    h = radius / 2
    box = lambda c, axis: F.col(c).between(F.col(axis) - h, F.col(axis) + h)
    mass = cells.select(F.col("lat").alias("y"), F.col("lon").alias("x"), "density").join(F.broadcast(spots), box("y", "lat") & box("x", "lon")).groupBy("rank").agg(F.sum("density").alias("mass"))
    inside = points.filter("lat is not null").select(F.col("lat").alias("y"), F.col("lon").alias("x")).join(F.broadcast(spots), box("y", "lat") & box("x", "lon")).groupBy("rank").agg(F.count("*").alias("crimes"))
    return spots.join(mass, "rank", "left").join(inside, "rank", "left").withColumns({"mass": F.coalesce("mass", F.lit(0.0)), "crimes": F.coalesce("crimes", F.lit(0))})


def area_fraction(surface: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: the least fraction of cells that holds the share of the mass."""
    w = Window.orderBy(F.desc("density"), "row", "col")  # over the cells of a bounded grid
    c = surface.select(F.sum("density").over(w).alias("cum"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"), F.sum("density").over(Window.partitionBy()).alias("all"))
    return c.filter(F.col("cum") >= share * F.col("all")).agg((F.min("k") / F.first("n")).alias("fraction"))


def grid_hits(surface: DataFrame, points: DataFrame, n: int, bbox: tuple) -> DataFrame:
    """Cells with their number of points; a point on an edge belongs to both cells."""
    y0, y1, x0, x1 = bbox
    at = lambda c, a, b: (F.col(c) - a) / ((b - a) / n)
    both = lambda v: F.when(v == F.floor(v), F.array(F.floor(v) - 1, F.floor(v))).otherwise(F.array(F.floor(v)))
    p = points.filter("lat is not null").select(F.explode(both(at("lat", y0, y1))).alias("row"), "lon").select("row", F.explode(both(at("lon", x0, x1))).alias("col"))
    hits = p.groupBy("row", "col").agg(F.count("*").alias("hits"))
    return surface.join(hits, ["row", "col"], "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "y": F.when(F.col("hits") > 0, 1).otherwise(0)})


def rossmo(buffer_km: float, f: float, g: float):
    """Sum over points (w times each, if they have a weight) of Rossmo's contribution, in degrees. lats and lons ascend."""
    b = buffer_km / KM_PER_DEGREE

    def kernel(p: pd.DataFrame, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lats), len(lons)))
        y, x = p["lat"].to_numpy(), p["lon"].to_numpy()
        weights = p["w"].to_numpy() if "w" in p else np.ones(len(p))
        # beyond four buffers a point adds nothing
        rows, cols = (np.searchsorted(axis, np.stack([at - 4.01 * b, at + 4.01 * b])).T for axis, at in ((lats, y), (lons, x)))
        for y, x, w, row, col in zip(y, x, weights, rows.tolist(), cols.tolist(), strict=True):
            row, col = slice(*row), slice(*col)
            d = np.sqrt((lats[row, None] - y) ** 2 + (lons[None, col] - x) ** 2)
            with np.errstate(divide="ignore"):
                far = np.where(d < 4 * b, np.power(np.maximum(d, 1e-30), -f), 0.0)
            out[row, col] += w * np.where(d <= b, b ** (g - f) / np.maximum(2 * b - d, 1e-10) ** g, far)
        return out

    return kernel


def smooth(surface: DataFrame, rows: int, cols: int, sigma: float = 1.5) -> DataFrame:
    """Separable Gaussian smoothing with clamped edges, as two joins with the taps."""
    half = math.ceil(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    k /= k.sum()
    taps = F.array(*[F.struct(F.lit(i - half).alias("o"), F.lit(float(v)).alias("w")) for i, v in enumerate(k)])

    def along(df: DataFrame, axis: str, size: int) -> DataFrame:
        other = "col" if axis == "row" else "row"
        want = df.select("row", "col", F.explode(taps).alias("t")).select("row", "col", F.greatest(F.lit(0), F.least(F.lit(size - 1), F.col(axis) + F.col("t.o"))).alias("src"), F.col("t.w").alias("w"))
        src = df.select(F.col(axis).alias("src"), F.col(other).alias("_o"), "value")
        return want.join(src, (F.col(other) == F.col("_o")) & (want["src"] == src["src"])).groupBy("row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("value"))

    return along(along(surface.select("row", "col", "value"), "col", cols), "row", rows)


def geographic_profile(points: DataFrame, n: int = 80, buffer_km: float = 0.5, f: float = 1.2, g: float = 1.2) -> DataFrame:
    """row, col, lat, lon, p (sums to 1) of the likely anchor."""
    points = materialize(points.filter("lat is not null and lon is not null").select("lat", "lon"), "profile-points")
    b = bandwidths(points)
    margin = max(0.05, 4 * buffer_km / KM_PER_DEGREE)
    lats, lons = np.linspace(b["y0"] - margin, b["y1"] + margin, n), np.linspace(b["x0"] - margin, b["x1"] + margin, n)
    raw = accumulate(points, lats, lons, rossmo(buffer_km, f, g))
    made = smooth(raw, n, n).join(raw.select("row", "col", "lat", "lon"), ["row", "col"])
    return made.select("row", "col", "lat", "lon", (F.col("value") / F.sum("value").over(Window.partitionBy())).alias("p"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row: the peak cell and the km2 that hold 50 and 80 % of the mass."""
    return _summaries(materialize(profile, "profile").withColumn("series_id", F.lit(0))).drop("series_id")


def _summaries(p: DataFrame) -> DataFrame:
    """A row a series from its cells (series_id, row, col, lat, lon, p); grids are of bounded size."""
    w = Window.partitionBy("series_id").orderBy(F.desc("p"), "row", "col")
    c = p.select("*", F.sum("p").over(w).alias("cum"), F.row_number().over(w).alias("k"))
    need = lambda share: F.min(F.when(F.col("cum") >= share - 1e-12, F.col("k")))
    box = [f(c).alias(a) for f, c, a in ((F.min, "lat", "y0"), (F.max, "lat", "y1"), (F.min, "lon", "x0"), (F.max, "lon", "x1"))]
    one = c.groupBy("series_id").agg(F.min_by(F.struct("lat", "lon", "p"), "k").alias("peak"), need(0.5).alias("k50"), need(0.8).alias("k80"), *box, (F.max("row") + 1).alias("n"))
    km = lambda a, b: (F.col(b) - F.col(a)) / (F.col("n") - 1) * KM_PER_DEGREE
    cell = km("y0", "y1") * km("x0", "x1") * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    return one.select("series_id", "peak.lat", "peak.lon", F.col("peak.p").alias("peak_p"), (F.col("k50") * cell).alias("area50_km2"), (F.col("k80") * cell).alias("area80_km2"))


#: Places of a series that are added up in one task, or more.
PLACES = 2000


def series_profiles(members: DataFrame, n: int = 80, buffer_km: float = 0.5, f: float = 1.2, g: float = 1.2, least: int = 3) -> DataFrame:
    """series_id with peak and areas, for all series with at least `least` located members. members: series_id, lat, lon.

    Members at one place are one with a weight, which adds to the cells within four buffers of it. Every batch of places adds up one grid
    a series; the partial grids of a series, each of n x n numbers, meet by its id."""
    located = members.filter("lat is not null and lon is not null").groupBy("series_id", "lat", "lon").agg(F.count("*").alias("w"))
    located = materialize(located, "places-of-series")
    margin = max(0.05, 4 * buffer_km / KM_PER_DEGREE)
    boxes = located.groupBy("series_id").agg(F.sum("w").alias("size"), F.ceil(F.count("*") / PLACES).alias("parts"), (F.min("lat") - margin).alias("y0"), (F.max("lat") + margin).alias("y1"), (F.min("lon") - margin).alias("x0"), (F.max("lon") + margin).alias("x1"))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = located.join(boxes.filter(F.col("size") >= least), "series_id").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), "parts"))
    rows = rows.repartition(tasks, "series_id", "part").sortWithinPartitions("series_id", "part").drop("part", "parts")
    kernel, taps = rossmo(buffer_km, f, g), _taps(1.5)
    axes = lambda y0, y1, x0, x1: (np.linspace(y0, y1, n), np.linspace(x0, x1, n))
    box = ["y0", "y1", "x0", "x1"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (series, *b), mine in pdf.groupby(["series_id", *box]):
                yield pd.DataFrame({"series_id": [series], **{c: [v] for c, v in zip(box, b, strict=True)}, "grid": [kernel(mine, *axes(*b)).ravel()]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = None, None
        for pdf in batches:
            for r in pdf.itertuples():
                if held is not None and r.series_id != held.series_id:
                    yield cells(held, sums)
                    held = None
                held, sums = (r, np.array(r.grid)) if held is None else (held, sums + r.grid)
        if held is not None:
            yield cells(held, sums)

    def cells(r, sums: np.ndarray) -> pd.DataFrame:
        grid = _smoothed(sums.reshape(n, n), taps)
        lats, lons = axes(r.y0, r.y1, r.x0, r.x1)
        row, col = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"series_id": r.series_id, "row": row, "col": col, "lat": lats[row], "lon": lons[col], "p": (grid / grid.sum()).ravel()})

    grids = rows.mapInPandas(partial, "series_id string, y0 double, y1 double, x0 double, x1 double, grid array<double>")
    dealt = grids.repartition("series_id").sortWithinPartitions("series_id")
    return _summaries(dealt.mapInPandas(whole, "series_id string, row int, col int, lat double, lon double, p double"))


def _taps(sigma: float) -> np.ndarray:
    half = math.ceil(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return k / k.sum()


def _smoothed(grid: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Separable smoothing with clamped edges."""
    half = len(taps) // 2
    for axis in (1, 0):
        n = grid.shape[axis]
        grid = sum(w * np.take(grid, np.clip(np.arange(n) + k - half, 0, n - 1), axis) for k, w in enumerate(taps))
    return grid


def map_hotspots(points: DataFrame, top_k: int = 8) -> DataFrame:
    """Hotspots of a map: a box with a tenth (at least 0.01) to spare, 40 x 40 cells; none for fewer than three points."""
    located = points.filter("lat is not null and lon is not null")
    b = bandwidths(located)
    if b["n"] < 3:
        return points.sparkSession.createDataFrame([], "rank int, lat double, lon double, peak double, mass double, crimes long")
    dy, dx = max(0.1 * (b["y1"] - b["y0"]), 0.01), max(0.1 * (b["x1"] - b["x0"]), 0.01)
    return hotspots(kde(located, 40, (b["y0"] - dy, b["y1"] + dy, b["x0"] - dx, b["x1"] + dx)), located, top_k)


# -- Hawkes --------------------------------------------------------------------------------------------------------------


def _window(beta: float) -> float:
    return min(20 / beta, 90.0)


#: Events that a task compares one by one with as many others; of longer runs, those that come whole after others are summed up by place.
BLOCK_EVENTS = 2000
#: Blocks of all events: each goes to one pair with every other, so what pairs carry grows with the events, not with their square ...
BLOCKS = 12
#: ... up to blocks of so many events, which is what a task holds twice.
MOST_EVENTS = 1_000_000
#: Places compared at a time, and pairs of places that are compared one by one; of more, far ones are summed by boxes.
TILE, FEW_PAIRS = (250, 1000), 200_000_000


def _blocks(events: DataFrame, side: str) -> DataFrame:
    """Events packed in blocks of equal size that follow each other in time: block, t0, t1 and the events as arrays."""
    e = events.select("id", F.col("t").cast("double").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    ranked = global_cumulate(e, [F.col("t"), F.col("id")], {}, "rank")
    size = min(max(-(-events.count() // BLOCKS), BLOCK_EVENTS), MOST_EVENTS)
    block = F.floor((F.col("rank") - 1) / size).alias(f"{side}_block")
    packed = ranked.groupBy(block).agg(F.min("t").alias(f"{side}_t0"), F.max("t").alias(f"{side}_t1"), F.array_sort(F.collect_list(F.struct("t", "id", "lat", "lon"))).alias(side))
    return materialize(packed, f"{side}-blocks")


def _all_pairs(u: np.ndarray, v: np.ndarray, held: np.ndarray, sigmas: list[float]) -> np.ndarray:
    """As cauchy_sums, place by place."""
    sums = np.zeros((len(sigmas), len(u), held.shape[1]))
    (uy, ux), (vy, vx) = (np.ascontiguousarray(x.T) for x in (u, v))
    tiles = np.empty((3, *TILE))  # filled again and again: new memory for each step takes longer than the sums
    for i in range(0, len(u), TILE[0]):
        rows = slice(i, i + TILE[0])
        for j in range(0, len(v), TILE[1]):
            near = slice(j, j + TILE[1])
            d2, dx, weight = tiles[:, : len(uy[rows]), : len(vy[near])]
            np.square(np.subtract(uy[rows, None], vy[near], out=d2), out=d2)
            d2 += np.square(np.subtract(ux[rows, None], vx[near], out=dx), out=dx)
            for k, s in enumerate(sigmas):
                np.divide(s * s, np.add(d2, s * s, out=weight), out=weight)
                sums[k, rows] += weight @ held[near]
    return sums


def _whole(late: tuple, early: tuple, candidates: list[tuple[float, float]]) -> np.ndarray:
    """Sums over events all of which come first and lie in the window: exp(-beta dt) is a product of a factor for each side, so
    places are compared once for all times at them, and many of them by boxes that see each other as smooth."""
    (bt, _, by, bx), (at, _, ay, ax) = late, early
    out = np.zeros((len(candidates), len(bt)))
    u, of_late = np.unique(by + 1j * bx, return_inverse=True)
    v, of_early = np.unique(ay + 1j * ax, return_inverse=True)
    betas, sigmas = (list(dict.fromkeys(c[k] for c in candidates)) for k in (0, 1))
    # weights at the earlier events' end, by place
    held = np.stack([np.bincount(of_early, b * np.exp(-b * (at[-1] - at)), len(v)) for b in betas], axis=1)
    place = lambda z: np.column_stack([z.real, z.imag])
    sums = (cauchy_sums if len(u) * len(v) >= FEW_PAIRS else _all_pairs)(place(u), place(v), held, sigmas)
    for k, (b, s) in enumerate(candidates):
        out[k] = np.exp(-b * (bt - at[-1])) * sums[sigmas.index(s), of_late, betas.index(b)]
    return out


def _one_by_one(late: tuple, early: tuple, candidates: list[tuple[float, float]], strict: bool) -> np.ndarray:
    """Sums over the pairs of two short runs of events."""
    (bt, bid, by, bx), (at, aid, ay, ax) = late, early
    out = np.zeros((len(candidates), len(bt)))
    for i in range(0, len(bt), 250):
        rows = slice(i, i + 250)
        t, betas = bt[rows], {b for b, _ in candidates}
        reach = {b: (int(np.searchsorted(at, t[0] - _window(b))), int(np.searchsorted(at, t[-1], side="right"))) for b in betas}
        low, high = min(x for x, _ in reach.values()), max(x for _, x in reach.values())
        if low >= high:
            continue
        dt = t[:, None] - at[low:high]
        before = dt > 0 if strict else (dt > 0) | ((dt == 0) & (aid[low:high] < bid[rows, None]))
        d2 = (by[rows, None] - ay[low:high]) ** 2 + (bx[rows, None] - ax[low:high]) ** 2
        near = {s: s * s / (d2 + s * s) for s in {s for _, s in candidates}}
        for b in betas:
            cut = slice(reach[b][0] - low, reach[b][1] - low)
            inside = before[:, cut] & (dt[:, cut] <= _window(b))
            if not inside.any():
                continue
            lead = b * (at[reach[b][0] : reach[b][1]] - t[0])
            products = lead.max() < 500  # else a factor would overflow
            fade = inside if products else np.where(inside, b * np.exp(-b * np.maximum(dt[:, cut], 0)), 0.0)
            for k, (beta, s) in enumerate(candidates):
                if beta == b:
                    weighed = near[s][:, cut] * fade
                    out[k, rows] = np.exp(-b * (t - t[0])) * (weighed @ (b * np.exp(lead))) if products else weighed.sum(1)
    return out


def _faded(late: tuple, early: tuple, candidates: list[tuple[float, float]], strict: bool) -> np.ndarray:
    """Sums over two runs of events in the order of (t, id), a row a candidate. Runs are halved until all of one comes first and in
    the window, or nothing does, or both are short."""
    out = np.zeros((len(candidates), len(late[0])))
    todo = [(0, len(late[0]), 0, len(early[0]), list(range(len(candidates))))]
    while todo:
        a, b, c, d, open_ = todo.pop()
        mine, other = tuple(x[a:b] for x in late), tuple(x[c:d] for x in early)
        (bt, bid), (at, aid) = mine[:2], other[:2]
        if at[0] > bt[-1] or (strict and at[0] == bt[-1]):
            continue
        first = at[-1] < bt[0] or (not strict and at[-1] == bt[0] and aid[-1] < bid[0])
        open_ = [k for k in open_ if bt[0] - at[-1] <= _window(candidates[k][0])]
        whole = [k for k in open_ if first and bt[-1] - at[0] <= _window(candidates[k][0])]
        if whole:
            out[whole, a:b] += _whole(mine, other, [candidates[k] for k in whole])
        part = [k for k in open_ if k not in whole]
        if not part:
            continue
        if max(b - a, d - c) <= BLOCK_EVENTS:
            out[part, a:b] += _one_by_one(mine, other, [candidates[k] for k in part], strict)
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d, part), ((a + b) // 2, b, c, d, part)]
        else:
            todo += [(a, b, c, (c + d) // 2, part), (a, b, (c + d) // 2, d, part)]
    return out


def excitation(targets: DataFrame, events: DataFrame, candidates: list[tuple[float, float]], strict: bool, early: DataFrame | None = None) -> DataFrame:
    """(id, x0, x1, ...): for each (beta, sigma), the sum over earlier events within the window of
    beta exp(-beta dt) s2 / (d2 + s2). Earlier is by t alone if strict, else by (t, id).

    Blocks of equal size follow each other in time, however events bunch; a pair of blocks meets once, and only if the window of the
    later one reaches the earlier one. There are few, large blocks: what the pairs carry is their number times all events. Pairs of
    events exist only as arrays inside a task; events at one place count as one there.
    early: the blocks of events, where they are at hand."""
    days = max(_window(b) for b, _ in candidates)
    early = _blocks(events, "early") if early is None else early
    late = _blocks(targets, "late") if targets is not events else early.select(*[F.col(c).alias(c.replace("early", "late")) for c in early.columns])
    names = [f"x{k}" for k in range(len(candidates))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = None
        for batch in batches:
            for k, side in enumerate(batch["side"].to_pylist()):
                block = tuple(x.to_numpy(zero_copy_only=False) for x in batch["block"][k].values.flatten())
                if side == 0:  # the earlier block of the pair comes next
                    late = block
                    continue
                sums = _faded(late, block, candidates, strict)
                yield pa.RecordBatch.from_arrays([pa.array(late[1], pa.int64()), *map(pa.array, sums)], names=["id", *names])

    # blocks meet in the windows' buckets that both touch: the earlier one's own, the later one's and those its window reaches
    bucket = lambda c: F.floor(F.col(c) / days).cast("long")
    heads = [d.select(f"{side}_block", f"{side}_t0", f"{side}_t1") for side, d in (("late", late), ("early", early))]
    a = heads[0].withColumn("k", F.explode(F.sequence(bucket("late_t0") - 1, bucket("late_t1"))))
    b = heads[1].withColumn("k", F.explode(F.sequence(bucket("early_t0"), bucket("early_t1"))))
    met = a.join(b, "k").filter((F.col("early_t0") <= F.col("late_t1")) & (F.col("late_t0") - F.col("early_t1") <= days)).select("late_block", "early_block").distinct()
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(met.withColumn("pair", F.expr("late_block * (late_block + 1) div 2 + early_block")), "block-pairs")
    both = lambda k, side, d: F.broadcast(met.select("pair", "late_block", "early_block")).join(d.select(f"{side}_block", F.col(side).alias("block")).repartition(tasks), f"{side}_block").select("pair", "late_block", F.lit(k).alias("side"), "block")  # noqa: E731 - a row a pair of blocks
    sent = both(0, "late", late).union(both(1, "early", early)).repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int"))
    sent = sent.sortWithinPartitions("pair", "late_block", "side").select("side", "block")
    return sent.mapInArrow(run, "id long, " + ", ".join(f"{x} double" for x in names)).groupBy("id").agg(*[F.sum(x).alias(x) for x in names])


def hawkes_nll(events: DataFrame, candidates: list[tuple[float, float, float, float]], early: DataFrame | None = None) -> list[float]:
    """Negative log-likelihood of each (mu, alpha, beta, sigma), all in one pass over the pairs of blocks. Candidates that differ
    in mu and alpha alone share the sums of their pairs."""
    shapes = list(dict.fromkeys((b, s) for _, _, b, s in candidates))
    return _nll(events, excitation(events, events, shapes, strict=False, early=early), shapes, candidates)


def _nll(events: DataFrame, sums: DataFrame, shapes: list[tuple[float, float]], candidates: list[tuple]) -> list[float]:
    ends = events.agg(F.max("t").alias("t1"), F.min("t").alias("t0")).first()
    span = ends["t1"] - ends["t0"] if ends["t1"] > ends["t0"] else 1.0
    rows = events.select("id", "t").join(sums, "id", "left")
    agg = []
    for k, (mu, a, b, s) in enumerate(candidates):
        x = F.coalesce(F.col(f"x{shapes.index((b, s))}"), F.lit(0.0))
        agg.append((-F.sum(F.log(mu + a * x)) + mu * span + F.sum(a * (1 - F.exp(-b * (ends["t1"] - F.col("t")))))).alias(f"n{k}"))
    return list(rows.agg(*agg).first())


BOUNDS = {0: (1e-6, 10.0), 1: (1e-6, 0.99), 2: (0.1, 20.0), 3: (1e-5, 0.5)}


class _Sums:
    """Tables of the events' sums over pairs, each written once: (t, x0, x1, ...) for candidates (beta, sigma)."""

    def __init__(self, events: DataFrame):
        self.events, self.early, self.held = events, _blocks(events, "early"), {}
        ends = events.agg(F.max("t").alias("t1"), F.min("t").alias("t0")).first()
        self.t1, self.span = ends["t1"], ends["t1"] - ends["t0"] if ends["t1"] > ends["t0"] else 1.0

    def table(self, shapes: list[tuple[float, float]]) -> DataFrame:
        key = tuple(shapes)
        if key not in self.held:
            sums = self.events.select("id", "t").join(excitation(self.events, self.events, shapes, strict=False, early=self.early), "id", "left")
            self.held[key] = materialize(sums.select("t", *[F.coalesce(f"x{k}", F.lit(0.0)).alias(f"x{k}") for k in range(len(shapes))]), "hawkes-sums")
        return self.held[key]

    def nll(self, shapes: list[tuple[float, float]], mixed: np.ndarray, candidates: list[tuple]) -> list[float]:
        """Of each (mu, alpha, beta, sigma); its sums are those of `shapes` times its row of `mixed`."""
        mu, alpha, beta = (np.array([c[k] for c in candidates]) for k in range(3))
        t1, names = self.t1, [f"x{k}" for k in range(len(shapes))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(candidates))
            for batch in batches:
                x = np.stack([batch[n].to_numpy() for n in names], axis=1) @ mixed.T
                t = batch["t"].to_numpy()
                total += (alpha * (1 - np.exp(-beta * (t1 - t[:, None])))).sum(0) - np.log(mu + alpha * np.maximum(x, 0)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

        found = self.table(shapes).mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        got = {r["k"]: r["v"] for r in found}
        return [got.get(k, 0.0) + c[0] * self.span for k, c in enumerate(candidates)]


def _nodes(lo: float, hi: float, strip: float) -> np.ndarray:
    """Chebyshev nodes in an interval, enough for sums analytic within `strip` of the real axis to be known to 11 digits in all of it."""
    r = 2 * strip / (hi - lo)
    n = math.ceil(11 * math.log(10) / math.log(r + math.sqrt(r * r + 1)))
    return (lo + hi) / 2 - (hi - lo) / 2 * np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))


def _mixed(nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What each node's value counts for at each place: a row a place (barycentric interpolation)."""
    n = len(nodes)
    w = (-1.0) ** np.arange(n) * np.sin((2 * np.arange(n) + 1) * np.pi / (2 * n))
    d = at[:, None] - nodes
    hit = d == 0
    c = np.where(hit.any(1, keepdims=True), hit, w / np.where(hit, 1.0, d))
    return c / c.sum(1, keepdims=True)


def fit_hawkes(events: DataFrame, sweeps: int = 10, width: int = 16, rounds: int = 4) -> dict:
    """Coordinate descent; each line search narrows its interval by `width` candidates a pass. Gives parameters, nll, sweeps.

    For mu and alpha the sums over pairs don't change. For beta and sigma the first pass weighs the pairs for candidates of the whole
    interval; between two neighbours of its best one, each event's sum is a smooth function (beta exp(-beta dt) is bounded for
    logarithms within pi / 2 of the real axis, and s2 / (d2 + s2) has no pole there), so the later passes interpolate it from one
    weighing at Chebyshev nodes. The winner is weighed itself before it is taken. What was weighed before isn't weighed again."""
    sums = _Sums(materialize(events.select("id", "t", "lat", "lon"), "hawkes-events"))
    now, best, done = [0.1, 0.3, 0.5, 0.01], math.inf, 0
    for done in range(1, sweeps + 1):  # noqa: B007
        was = best
        for axis, (low, high) in BOUNDS.items():
            lo, hi, nodes = math.log(low), math.log(high), None
            at = lambda xs: [tuple(float(math.exp(x)) if k == axis else v for k, v in enumerate(now)) for x in xs]  # noqa: B023, E731
            for step in range(rounds):
                grid = np.linspace(lo, hi, width)
                tries = at(grid)
                if axis < 2:
                    shapes, mixed = [tuple(now[2:])], np.ones((width, 1))
                elif nodes is None:
                    shapes, mixed = [c[2:] for c in tries], np.eye(width)
                else:
                    shapes, mixed = [c[2:] for c in at(nodes)], _mixed(nodes, grid)
                got = sums.nll(shapes, mixed, tries)
                k = int(np.argmin(got))
                lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, width - 1)]
                if axis > 1 and step == 0 and len(few := _nodes(lo, hi, math.pi / 2)) <= (rounds - 1) * width:
                    nodes = few
            value = got[k] if nodes is None else sums.nll([tries[k][2:]], np.ones((1, 1)), [tries[k]])[0]
            if value < best:
                best, now[axis] = value, tries[k][axis]
        if abs(was - best) < 1e-5:
            break
    return dict(zip(("mu", "alpha", "beta", "sigma"), now, strict=True)) | {"nll": best, "sweeps": done, "branching": now[1]}


def hawkes_intensity(targets: DataFrame, events: DataFrame, mu: float, alpha: float, beta: float, sigma: float) -> DataFrame:
    """targets (id, t, lat, lon) with the intensity from strictly earlier events."""
    x = excitation(targets, events, [(beta, sigma)], strict=True)
    return targets.join(x, "id", "left").withColumn("intensity", mu + alpha * F.coalesce("x0", F.lit(0.0))).drop("x0")


def hawkes_surface(events: DataFrame, t: float, bbox: tuple, n: int, mu: float, alpha: float, beta: float, sigma: float) -> DataFrame:
    """Intensity at the nodes of a grid, both ends included."""
    y0, y1, x0, x1 = bbox
    s2, w = sigma * sigma, _window(beta)

    def kernel(p: pd.DataFrame, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
        weight = alpha * beta * np.exp(-beta * (t - p["t"].to_numpy()))
        out = np.zeros((len(lats), len(lons)))
        for c, y, x in zip(weight, p["lat"].to_numpy(), p["lon"].to_numpy(), strict=True):
            out += c * s2 / ((lats[:, None] - y) ** 2 + (lons[None, :] - x) ** 2 + s2)
        return out

    recent = events.filter((F.col("t") < t) & (t - F.col("t") <= w))
    out = accumulate(recent, np.linspace(y0, y1, n), np.linspace(x0, x1, n), kernel, ("t", "lat", "lon"))
    return out.select("row", "col", "lat", "lon", (mu + F.col("value")).alias("intensity"))


# -- Gaussian process by random Fourier features ---------------------------------------------------------------------------


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor, row by row, in plain array operations: the matrix is small, and no threaded library is needed."""
    out = np.zeros_like(a)
    for k in range(len(a)):
        out[k, k] = math.sqrt(a[k, k] - out[k, :k] @ out[k, :k])
        out[k + 1 :, k] = (a[k + 1 :, k] - (out[k + 1 :, :k] * out[k, :k]).sum(1)) / out[k, k]
    return out


def substituted(root: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with root x = b, for a lower root."""
    x = np.array(b, float)
    for k in range(len(root)):
        x[k] = (x[k] - np.tensordot(root[k, :k], x[:k], 1)) / root[k, k]
    return x


def back_substituted(root: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with root' x = b."""
    x = np.array(b, float)
    for k in range(len(root) - 1, -1, -1):
        x[k] = (x[k] - np.tensordot(root[k + 1 :, k], x[k + 1 :], 1)) / root[k, k]
    return x


class FourierProcess:
    """Squared-exponential regression of y on (x1, x2): features are fixed by a seed, one pass adds up the Gram matrix.

    After fit, log_likelihood is log p(y) under the model: by the determinant lemma it takes the same factor of features x features."""

    def __init__(self, length: float = 1.0, scale: float = 1.0, noise: float = 0.1, features: int = 256, seed: int = 42):
        g = np.random.default_rng(seed)
        self.w, self.b = g.normal(0, 1 / length, (features, 2)), g.uniform(0, 2 * np.pi, features)
        self.amp, self.noise, self.d = scale * math.sqrt(2 / features), noise, features

    def phi(self, pdf: pd.DataFrame) -> np.ndarray:
        return self.amp * np.cos(pdf[["x1", "x2"]].to_numpy() @ self.w.T + self.b)

    def fit(self, df: DataFrame) -> FourierProcess:
        phi, d = self.phi, self.d

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((d + 1, d + 1))  # the last row: number and squares of y
            for pdf in batches:
                f, y = phi(pdf), pdf["y"].to_numpy()
                total[:d] += np.concatenate([f.T @ f, (f.T @ y)[:, None]], axis=1)
                total[d, :2] += len(y), y @ y
            yield pd.DataFrame({"row": range(d + 1), "value": list(total)})

        rows = df.select("x1", "x2", "y").mapInPandas(gram, "row int, value array<double>").select("row", F.posexplode("value").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
        m = np.zeros((d + 1, d + 1))
        m[rows["row"], rows["col"]] = rows["v"]
        self.n, self.squares, self.gram = int(m[d, 0]), m[d, 1], m[:d]
        return self.with_noise(self.noise)

    def with_noise(self, noise: float) -> FourierProcess:
        """The fit under another noise, from the same Gram matrix."""
        self.noise, d = noise, self.d
        self.root = cholesky(self.gram[:, :d] + noise**2 * np.eye(d))
        self.mean = back_substituted(self.root, substituted(self.root, self.gram[:, d]))
        fitted = self.squares - self.gram[:, d] @ self.mean
        determinant = 2 * np.log(np.diag(self.root)).sum() + (self.n - d) * math.log(noise**2)
        self.log_likelihood = -0.5 * (fitted / noise**2 + determinant + self.n * math.log(2 * math.pi))
        return self

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        # the factor's inverse, once: a row then takes one product, not a substitution of as many steps as there are features in each batch
        phi, mean, half, noise = self.phi, self.mean, substituted(self.root, np.eye(self.d)).T, self.noise

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                f = phi(pdf)
                yield pd.DataFrame({key: pdf[key], "mean": f @ mean, "variance": noise**2 * np.square(f @ half).sum(1)})

        return df.select(key, "x1", "x2").mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, mean double, variance double")


def choose_kernel(df: DataFrame, lengths: list[float], noises: list[float], features: int = 256) -> tuple[FourierProcess, list[tuple[float, float, float]]]:
    """The process of the greatest log marginal likelihood, fitted, and (length, noise, log likelihood) of all that were tried. A
    length takes a pass over df; noises take none. Of equal ones the first wins."""
    tried, best = [], None
    for length in lengths:
        process = FourierProcess(length, features=features).fit(df)
        for noise in noises:
            value = process.with_noise(noise).log_likelihood
            if best is None or value > max(t[2] for t in tried):
                best = (process, noise)
            tried.append((length, noise, float(value)))
    return best[0].with_noise(best[1]), tried

"""Polygons on a grid of square cells, and catchment areas computed on it.

Cell (x, y) spans ``[x, x + 1) * size`` by ``[y, y + 1) * size``. What a
polygon holds or covers is kept as runs of cells of one row (row, first, last),
so a zone of a hundred thousand cells is a few hundred rows. Runs come from the
polygon's edges, cut at the rows, by sums and windows over (key, row); no task
sees a whole polygon, and no geometry library is needed. Sums over zones and
surfaces of zones are sweeps along each row of cells: zones are never expanded
into cells, only tracts are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachwell import guards
from reachwell.constants import BAND_WEIGHTS, PER_CAPITA, THRESHOLDS
from reachwell.functions import weights as wt
from reachwell.functions.geometry import polygon_area, polygon_length
from reachwell.operators import grid
from reachwell.storage import Store, kept

#: Digits to which a covered fraction is exact; less is the noise of its sums.
DIGITS = 12
#: Pieces of edges that one task cuts, about.
PIECES = 250_000


def dealt(shapes: DataFrame, size: float) -> DataFrame:
    """``shapes`` dealt to as many tasks as their pieces in cells of ``size`` ask for.

    A small file of polygons, read by one task, makes many pieces; their number
    is about that of the edges and of the sides that these cross.
    """
    pieces = 2 * polygon_length(F.col("polygon")) / size + 2 * F.size(F.flatten("polygon"))
    n = shapes.agg(F.sum(F.when(guards.finite(pieces), pieces))).head()[0] or 0.0
    return shapes.repartition(int(n // PIECES) + 1) if n > PIECES else shapes


def edges(shapes: DataFrame, *keys: str) -> DataFrame:
    """Every edge of each row's ``polygon``: keys, part, n, x1, y1, x2, y2; rings may be closed or not."""
    rings = shapes.select(*keys, F.posexplode("polygon").alias("part", "ring"))
    following = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    rows = rings.where(F.size("ring") > 0).select(*keys, "part", F.posexplode(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))).alias("n", "e"))
    rows = rows.select(*keys, "part", "n", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    return rows.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _rising(rows: DataFrame, *keys: str) -> DataFrame:
    """Edges that aren't level, from their lower end: keys, xa, ya, xb, yb, and ``down`` (1 if the edge goes down, -1 if up).

    An edge that two polygons share gives both the same numbers.
    """
    down = F.col("y2") < F.col("y1")
    ends = [F.when(down, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("x2", "x1", "xa"), ("y2", "y1", "ya"), ("x1", "x2", "xb"), ("y1", "y2", "yb"))]
    return rows.where("y1 <> y2").select(*keys, *ends, F.when(down, 1.0).otherwise(-1.0).alias("down"))


def _x_at(y: Column) -> Column:
    inside = F.col("xa") + (y - F.col("ya")) * ((F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya")))
    return F.when(y <= F.col("ya"), F.col("xa")).when(y >= F.col("yb"), F.col("xb")).otherwise(inside)


def _first_centre(at: Column, size: float) -> Column:
    """The first cell whose centre is at or beyond."""
    return F.ceil(at / size - 0.5).cast("long")


def _span(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def centre_runs(shapes: DataFrame, size: float, *keys: str) -> DataFrame:
    """The cells whose centres a polygon holds: keys, row, first, last.

    The crossings of a row of centres with the edges, in order, bound the runs.
    Low sides are inclusive and high ones exclusive, so polygons that share
    edges share no cell.
    """
    rows = _rising(edges(dealt(shapes, size), *keys), *keys)
    rows = rows.withColumn("row", F.explode(_span(_first_centre(F.col("ya"), size), _first_centre(F.col("yb"), size) - 1)))
    rows = rows.select(*keys, "row", _first_centre(_x_at((F.col("row") + 0.5) * size), size).alias("at"))
    rows = rows.groupBy(*keys, "row").agg(F.array_sort(F.collect_list("at")).alias("at"))  # a row's crossings with one polygon
    rows = rows.select(*keys, "row", "at", F.explode(F.sequence(F.lit(1), F.size("at") - 1, F.lit(2))).alias("i"))
    return rows.select(*keys, "row", F.col("at")[F.col("i") - 1].alias("first"), (F.col("at")[F.col("i")] - 1).alias("last")).where("first <= last")


def coverage_runs(shapes: DataFrame, size: float, *keys: str) -> DataFrame:
    """The cells that a polygon meets, with the exact fraction of each that it covers: keys, row, first, last, fraction.

    A downward edge covers what lies to its right and an upward one takes it
    away. Edges are cut at the cells' sides; in its own cell a piece covers the
    part to its right, in all later cells of the row its whole height. So the
    fractions are running sums over the row's pieces, and between two cells
    with pieces they are constant.
    """
    rows = _rising(edges(dealt(shapes, size), *keys), *keys)
    rows = rows.withColumn("row", F.explode(F.sequence(F.floor(F.col("ya") / size), F.floor(F.col("yb") / size))))
    low, high = F.greatest(F.col("ya"), F.col("row") * size), F.least(F.col("yb"), (F.col("row") + 1) * size)
    rows = rows.where(high > low).select(*keys, "row", "down", (high - low).alias("dy"), _x_at(low).alias("xl"), _x_at(high).alias("xh"))
    rows = rows.select(*keys, "row", "down", "dy", F.least("xl", "xh").alias("x0"), F.greatest("xl", "xh").alias("x1"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    a, b = F.greatest(F.col("x0"), F.col("at") * size), F.least(F.col("x1"), (F.col("at") + 1) * size)
    share = F.when(F.col("x1") == F.col("x0"), 1.0).otherwise((b - a) / (F.col("x1") - F.col("x0")))
    height = F.col("down") * F.col("dy") * share / size
    right = F.col("at") + 1 - (a + b) / (2 * size)
    pieces = rows.select(*keys, "row", "at", height.alias("height"), (height * right).alias("part"))
    pieces = pieces.groupBy(*keys, "row", "at").agg(F.sum("height").alias("height"), F.sum("part").alias("part"))
    along = Window.partitionBy(*keys, "row").orderBy("at")
    upto = F.sum("height").over(along.rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.select(*keys, "row", "at", "part", "height", upto.alias("upto"), F.lead("at").over(along).alias("next"))
    own = F.struct(F.col("at").alias("first"), F.col("at").alias("last"), (F.col("upto") - F.col("height") + F.col("part")).alias("fraction"))
    then = F.struct((F.col("at") + 1).alias("first"), (F.col("next") - 1).alias("last"), F.col("upto").alias("fraction"))
    runs = pieces.select(*keys, "row", F.inline(F.array(own, then))).where("first <= last")
    return runs.withColumn("fraction", F.least(F.round("fraction", DIGITS), F.lit(1.0))).where("fraction > 0")


def banded(shapes: DataFrame, size: float, *keys: str) -> DataFrame:
    """The edges that aren't level, cut at the rows: keys, row, xa, ya, xb, yb, from the lower end."""
    rows = _rising(edges(shapes, *keys), *keys)
    rows = rows.withColumn("row", F.explode(F.sequence(F.floor(F.col("ya") / size), F.floor(F.col("yb") / size))))
    low, high = F.greatest(F.col("ya"), F.col("row") * size), F.least(F.col("yb"), (F.col("row") + 1) * size)
    return rows.where(high > low).select(*keys, "row", _x_at(low).alias("xa"), low.alias("ya"), _x_at(high).alias("xb"), high.alias("yb"))


def crossings(shapes: DataFrame, *keys: str) -> DataFrame:
    """Pairs of a polygon's edges that cross or lie upon each other: keys and the numbers of both.

    Edges meet in the cells of a grid as wide as the polygon's mean edge, so an
    edge is in about as many cells as its length says, and few edges share one.
    Edges that only touch, as neighbours do, don't cross.
    """
    flat = F.flatten("polygon")
    step = F.greatest(polygon_length(F.col("polygon")) / F.size(flat), F.lit(1e-300))
    rows = edges(shapes.where(F.size(flat) > 0).select(*keys, "polygon", step.alias("step")), *keys, "step")
    rows = rows.withColumn("id", F.shiftleft(F.col("part").cast("long"), 32) + F.col("n"))
    slack, y0, y1 = 1e-6, F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = rows.withColumn("cy", F.explode(F.sequence(F.floor(y0 / F.col("step") - slack), F.floor(y1 / F.col("step") + slack))))

    def x_at(y: Column) -> Column:
        inside = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
        return F.least(F.greatest(F.coalesce(inside, F.col("x1")), F.least("x1", "x2")), F.greatest("x1", "x2"))

    low, high = F.greatest(y0, F.col("cy") * F.col("step")), F.least(y1, (F.col("cy") + 1) * F.col("step"))
    level = F.col("y1") == F.col("y2")
    xl, xh = F.when(level, F.col("x1")).otherwise(x_at(low)), F.when(level, F.col("x2")).otherwise(x_at(high))
    first, last = (F.floor(F.col(c) / F.col("step") + d) for c, d in (("xl", -slack), ("xh", slack)))
    rows = rows.withColumns({"xl": F.least(xl, xh), "xh": F.greatest(xl, xh)}).withColumn("cx", F.explode(F.sequence(first, last)))
    one = rows.select(*keys, "cx", "cy", "id", *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    two = rows.select(*keys, "cx", "cy", F.col("id").alias("other"), *[F.col(c).alias(f"q{c}") for c in ("x1", "y1", "x2", "y2")])

    def side(a: str, b: str, c: str) -> Column:
        """On which side of the line from a to b point c lies."""
        (ax, ay), (bx, by), (cx, cy) = ((F.col(f"{p[0]}x{p[1]}"), F.col(f"{p[0]}y{p[1]}")) for p in (a, b, c))
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    s1, s2, s3, s4 = side("p1", "p2", "q1"), side("p1", "p2", "q2"), side("q1", "q2", "p1"), side("q1", "q2", "p2")
    through = (s1 * s2 < 0) & (s3 * s4 < 0)
    dx, dy = F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1")
    along = lambda x, y: ((F.col(x) - F.col("px1")) * dx + (F.col(y) - F.col("py1")) * dy) / (dx * dx + dy * dy)
    t1, t2 = along("qx1", "qy1"), along("qx2", "qy2")
    upon = (s1 == 0) & (s2 == 0) & (F.least(F.greatest(t1, t2), F.lit(1.0)) - F.greatest(F.least(t1, t2), F.lit(0.0)) > 1e-12)
    found = one.join(grid.apart(two), [*keys, "cx", "cy"]).where((F.col("id") < F.col("other")) & (through | upon))
    return found.select(*keys, F.col("id").alias("edge"), "other").distinct()


def valid(shapes: DataFrame, key: str) -> DataFrame:
    """``shapes``, if every polygon has area, rings of three points at least, finite points, and edges that don't cross."""
    point = F.flatten("polygon")
    bad = F.exists("polygon", lambda ring: F.size(ring) < 3) | F.exists(point, lambda p: ~(guards.finite(p["x"]) & guards.finite(p["y"])))
    bad = F.coalesce((F.size("polygon") < 1) | bad, F.lit(True))
    guards.refuse_any(
        ("polygon without three finite points a ring", shapes.where(bad), key),
        ("polygon whose edges cross", crossings(shapes.where(~bad), key), key),
        ("polygon without area", shapes.where(polygon_area(F.col("polygon")) <= 0), key),
    )
    return shapes


def cell_id(x: Column, y: Column) -> Column:
    """One number for a cell; coordinates are below 2 ** 31."""
    return F.shiftleft(y.cast("long"), 32) + x


def cells_of_runs(runs: DataFrame) -> DataFrame:
    """Runs as cells: cell_x, cell_y, cell_id and the other columns."""
    rest = [c for c in runs.columns if c not in ("row", "first", "last")]
    rows = runs.select(*rest, F.col("row").alias("cell_y"), F.explode(F.sequence("first", "last")).alias("cell_x"))
    return rows.withColumn("cell_id", cell_id(F.col("cell_x"), F.col("cell_y")))


def tract_geometry(tracts: DataFrame, size: float) -> DataFrame:
    """Each tract's area and the number of cells whose centres it holds, null if none: geoid, area, n_cells."""
    counts = centre_runs(tracts, size, "geoid").groupBy("geoid").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_cells"))
    return tracts.select("geoid", polygon_area(F.col("polygon")).alias("area")).join(grid.apart(counts), "geoid", "left")


class Grid(NamedTuple):
    """Populations on cells, and how much of each tract lies in a cell."""

    cells: DataFrame  #: cell_id, cell_x, cell_y, pop
    bridge: DataFrame  #: geoid, cell_id, cell_x, cell_y, area
    size: float


def build_grid(tracts: DataFrame, size: float, alloc: str = "area", check: bool = True) -> Grid:
    """Tracts (geoid, pop, polygon) on cells of one size.

    ``area`` allocates each population in proportion to the area in each cell
    and conserves it; ``center`` in equal parts to the cells whose centres the
    tract holds, which loses the populations of tracts that hold none.
    """
    if alloc not in ("area", "center"):
        raise guards.CatchmentError(f"no allocation {alloc!r}")
    if check:
        valid(tracts, "geoid")
    pop = tracts.select("geoid", "pop")
    bridge = cells_of_runs(coverage_runs(tracts, size, "geoid")).withColumn("area", F.col("fraction") * (size * size)).drop("fraction")
    if alloc == "area":
        cells = grid.allocate_by_area(pop, bridge, check=check)
    else:
        held = grid.allocate_by_center(pop, cells_of_runs(centre_runs(tracts, size, "geoid")))
        cells = bridge.select("cell_id").distinct().join(grid.apart(held), "cell_id", "left").select("cell_id", F.coalesce("pop", F.lit(0.0)).alias("pop"))
    y = F.shiftright(F.col("cell_id") + (1 << 31), 32)
    return Grid(cells.select("cell_id", (F.col("cell_id") - F.shiftleft(y, 32)).alias("cell_x"), y.alias("cell_y"), "pop"), bridge, size)


class Zones(NamedTuple):
    """Zones on cells, made once for all years and specialties: coord_id, band and runs."""

    cover: DataFrame
    centres: DataFrame


def prepare_zones(zones: DataFrame, size: float) -> Zones:
    """Zones (coord_id, minutes, polygon) as covered fractions and as held centres; bands are whole minutes."""
    rows = zones.select("coord_id", F.round("minutes").cast("int").alias("band"), "polygon")
    return Zones(coverage_runs(rows, size, "coord_id", "band"), centre_runs(rows, size, "coord_id", "band"))


def stored_grid(store: Store, tracts: Callable[[], DataFrame], size: float, alloc: str = "area", **key: object) -> Grid:
    """The grid of a key, such as vintage and year; ``tracts`` is asked for them only where the store lacks it."""
    made: list[Grid] = []

    def part(name: str) -> DataFrame:
        if not made:
            made.append(build_grid(tracts(), size, alloc))
        return getattr(made[0], name)

    key = {**key, "size": size, "alloc": alloc}
    return Grid(*[store.table(f"grid_{n}", lambda n=n: part(n), **key) for n in ("cells", "bridge")], size)


def stored_zones(store: Store, zones: Callable[[], DataFrame], size: float, **key: object) -> Zones:
    """The prepared zones of a key; ``zones`` is asked for them only where the store lacks them."""
    made: list[Zones] = []

    def part(name: str) -> DataFrame:
        if not made:
            made.append(prepare_zones(zones(), size))
        return getattr(made[0], name)

    return Zones(*[store.table(f"zones_{n}", lambda n=n: part(n), **key, size=size) for n in ("cover", "centres")])


def zonal_population(cells: DataFrame, cover: DataFrame, *keys: str) -> DataFrame:
    """Population in each zone, cells counted by the fraction covered: keys (coord_id, band unless told otherwise), pop.

    A run's population is the difference of the row's running sums at its ends.
    """
    keys = keys or ("coord_id", "band")
    ends = F.inline(F.array(*[F.struct(at.alias("at"), times.alias("times")) for at, times in ((F.col("last"), F.col("fraction")), (F.col("first") - 1, -F.col("fraction")))]))
    asked = cover.select("row", *keys, ends).withColumn("pop", F.lit(0.0))
    rows = asked.unionByName(cells.select(F.col("cell_y").alias("row"), F.col("cell_x").alias("at"), "pop"), allowMissingColumns=True)
    along = Window.partitionBy("row").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("pop").over(along)).where("times is not null")
    return rows.groupBy(*keys).agg(F.greatest(F.sum(F.col("times") * F.col("upto")), F.lit(0.0)).alias("pop"))


def surface(cells: DataFrame, centres: DataFrame, ratios: DataFrame, step2: DataFrame, *by: str) -> DataFrame:
    """Access of every cell, the weighted ratios of the zones that hold its centre: by, cell_id, pop, access.

    ``ratios`` has ``by``, coord_id and ratio; ``step2`` has ``by``, band and w,
    a few rows. Each run adds its value where it begins and takes it away behind
    its end; cells in no run have exactly 0.
    """
    values = centres.join(F.broadcast(step2), "band").join(grid.apart(ratios.where("ratio > 0")), [*by, "coord_id"])
    value = F.col("w") * F.col("ratio")
    steps = F.inline(F.array(*[F.struct(at.alias("at"), (sign * value).alias("v"), F.lit(sign).alias("n")) for at, sign in ((F.col("first"), 1), (F.col("last") + 1, -1))]))
    steps = values.select(*by, "row", steps).groupBy(*by, "row", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = cells.crossJoin(F.broadcast(step2.select(*by).distinct())) if by else cells
    rows = rows.select(*by, F.col("cell_y").alias("row"), F.col("cell_x").alias("at"), F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("n"), "cell_id", "pop")
    along = Window.partitionBy(*by, "row").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(steps, allowMissingColumns=True)
    rows = rows.select(*by, "cell_id", "pop", F.when(F.sum("n").over(along) > 0, F.sum("v").over(along)).otherwise(0.0).alias("access"))
    return rows.where("cell_id is not null")


def provider_ratios(supply: DataFrame, populations: DataFrame, step1: DataFrame, *by: str) -> DataFrame:
    """Every origin's supply over its weighted demand: by, coord_id, supply, weighted_demand, ratio, ratio_for_surface, zero_demand, excluded_supply.

    An origin without reachable demand has no ratio, adds nothing to the
    surface, and its supply counts as excluded. ``step1`` has by, band and w.
    """
    demand = populations.join(F.broadcast(step1), "band").groupBy(*by, "coord_id").agg(F.sum(F.col("w") * F.col("pop")).alias("weighted_demand"))
    rows = supply.select("coord_id", "supply")
    rows = rows.crossJoin(F.broadcast(step1.select(*by).distinct())) if by else rows
    rows = rows.join(grid.apart(demand), [*by, "coord_id"], "left").withColumn("weighted_demand", F.coalesce("weighted_demand", F.lit(0.0)))
    some = F.col("weighted_demand") > 0
    ratio = F.when(some, F.col("supply") / F.col("weighted_demand"))
    return rows.select("*", ratio.alias("ratio"), F.coalesce(ratio, F.lit(0.0)).alias("ratio_for_surface"), (~some).alias("zero_demand"), F.when(some, 0.0).otherwise(F.col("supply")).alias("excluded_supply"))


class RasterAccess(NamedTuple):
    """What :func:`raster_access` finds."""

    access: DataFrame  #: geoid, access_mean_area, access_mean_population and both per 100,000
    ratios: DataFrame
    audit: DataFrame  #: one row: n_zero_demand_origins, supply_zero_demand, share_supply_zero_demand, bands_outside, runs_dropped
    national: DataFrame
    surface: DataFrame


def raster_access(on: Grid, zones: Zones, supply: DataFrame, weights: Mapping[int, float] = BAND_WEIGHTS, power: float = 1.0, scale: float = PER_CAPITA, thresholds: Sequence[float] = THRESHOLDS, check: bool = True) -> RasterAccess:
    """Two-step access on a grid: populations of zones by covered fractions, a surface over centres, means by tract.

    Demand is weighted by ``weights`` whatever the power; ``power`` 2 makes the
    second step that of the modified method. Zones of origins without a supply
    are left out; zones of bands without a weight are left out and counted.
    """
    if check:
        guards.unique_key(supply, "coord_id", what="supply repeats an origin")
    spark = supply.sparkSession
    step1, step2 = (spark.createDataFrame(list(wt.incremental(weights, p).items()), "band int, w double") for p in (1.0, power))
    own = zones.cover.join(supply.select("coord_id"), "coord_id", "left_semi")
    known = F.col("band").isin([int(b) for b in weights])
    ratios = provider_ratios(supply, zonal_population(on.cells, own.where(known)), step1)
    centres = zones.centres.where(known)
    found = surface(on.cells, centres, ratios.select("coord_id", F.col("ratio_for_surface").alias("ratio")), step2)
    means = grid.zonal_means(found, on.bridge)
    access = means.select("geoid", F.col("mean").alias("access_mean_area"), F.col("weighted_mean").alias("access_mean_population"), (F.col("mean") * scale).alias("access_mean_area_scaled"), (F.col("weighted_mean") * scale).alias("access_mean_population_scaled"))
    lost = F.coalesce(F.sum("excluded_supply"), F.lit(0.0))
    audit = ratios.agg(F.count_if("zero_demand").alias("n_zero_demand_origins"), lost.alias("supply_zero_demand"), F.when(F.sum("supply") > 0, lost / F.sum("supply")).otherwise(0.0).alias("share_supply_zero_demand"))
    outside = own.where(~known).agg(F.array_sort(F.collect_set("band")).alias("bands_outside"), F.count("*").alias("runs_dropped"))
    return RasterAccess(access, ratios, audit.crossJoin(outside), grid.cell_summaries(found, thresholds, scale), found)


def raster_variants(grids: Mapping[int, tuple[Grid, Zones]], supply: DataFrame, variants: Mapping[str, dict] | None = None) -> DataFrame:
    """Access of every tract under each variant of weights, power and resolution: variant, geoid, mean, weighted_mean.

    ``grids`` has the grid and the zones of each resolution. Zones are summed
    once a resolution, however many variants share it.
    """
    variants = variants or wt.variants()
    spark, out = supply.sparkSession, None
    for resolution, (on, zones) in grids.items():
        own = {n: v for n, v in variants.items() if v["resolution"] == resolution}
        if not own:
            continue
        table = wt.variant_table(spark, own)
        populations = zonal_population(on.cells, zones.cover.join(supply.select("coord_id"), "coord_id", "left_semi"))
        ratios = provider_ratios(supply, populations, table.select("variant", "band", F.col("step1").alias("w")), "variant")
        found = surface(on.cells, zones.centres, ratios.select("variant", "coord_id", F.col("ratio_for_surface").alias("ratio")), table.select("variant", "band", F.col("step2").alias("w")), "variant")
        means = grid.zonal_means(found, on.bridge, "variant")
        out = means if out is None else out.unionByName(means)
    missing = {v["resolution"] for v in variants.values()} - set(grids)
    if missing:
        raise guards.CatchmentError(f"no grid of resolution {sorted(missing)}")
    return out


def seam_populations(current: DataFrame, former: DataFrame, size: float, within: float = 1e-9) -> DataFrame:
    """One year's population on cells under the tracts of two vintages, by four methods: method, vintage, cell_id, cell_x, cell_y, pop.

    ``current`` has geoid, pop and polygon; ``former`` geoid and polygon. The
    former tracts get what lies in them of the current tracts' cells, and
    allocate it anew. ``raw`` allocates to centres, ``mass_conserving`` by
    area; ``equal_total`` is ``raw`` with both at the current vintage's total,
    and ``mass_conserving_eqtot`` takes the former vintage to the current one's
    total. Totals that should be equal are checked.
    """
    def sum_of(df: DataFrame) -> float:
        return df.agg(F.coalesce(F.sum("pop"), F.lit(0.0))).head()[0]

    guards._refuse("negative population", current.where("pop < 0"), "geoid")
    valid(current, "geoid"), valid(former, "geoid")
    found, total, cover = {}, {}, kept(coverage_runs(former, size, "geoid"))
    for method, alloc in (("raw", "center"), ("mass_conserving", "area")):
        own = kept(build_grid(current, size, alloc, check=False).cells)
        inside = zonal_population(own, cover, "geoid")
        moved = kept(former.select("geoid", "polygon").join(grid.apart(inside), "geoid", "left").withColumn("pop", F.coalesce("pop", F.lit(0.0))))
        found[method] = (own, kept(build_grid(moved, size, alloc, check=False).cells))
        total[method] = [sum_of(c) for c in found[method]]
        if alloc == "area":
            for tracts, cells in zip((current, moved), total[method], strict=True):
                guards.conserved(sum_of(tracts), cells, 1e-6, "population on the grid")
    scaled = lambda cells, own, to: cells.withColumn("pop", F.col("pop") * (to / own)) if own else cells
    (a, b), (a_total, b_total) = found["raw"], total["raw"]
    found["equal_total"] = (scaled(a, a_total, a_total), scaled(b, b_total, a_total))
    (a, b), (a_total, b_total) = found["mass_conserving"], total["mass_conserving"]
    found["mass_conserving_eqtot"] = (a, scaled(b, b_total, a_total))
    out = None
    for method, pair in found.items():
        if method.startswith("equal") or method.endswith("eqtot"):
            guards.conserved(*map(sum_of, pair), within, f"{method} population")
        for vintage, cells in zip(("current", "former"), pair, strict=True):
            rows = cells.select(F.lit(method).alias("method"), F.lit(vintage).alias("vintage"), "cell_id", "cell_x", "cell_y", "pop")
            out = rows if out is None else out.unionByName(rows)
    return out

"""Queries over polygons: a lattice of tracts, some with a hole, and nested zones around suppliers.

The SQL goes other ways: it enumerates the cells of bounding boxes, counts
crossings for each centre, and integrates every edge over every cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachwell.functions.geometry import POLYGON, polygon_area, polygon_centroid
from reachwell.operators import coverage, geometry, grid, raster
from reachwell.plans.binding import Binding, origin
from reachwell.plans.registry import query, r

#: Tracts of a row of the lattice, and the length of a cell in the lattice's unit.
ROW, SIZE = 40, 0.5
#: Corners of a zone, in multiples of its reach, turning to the left.
CORNERS = ((1.0, 0.2), (0.4, 1.0), (-0.6, 0.9), (-1.0, -0.1), (-0.3, -1.0), (0.7, -0.8))
REACH = {30: 1.2, 60: 2.4, 120: 4.8, 180: 7.2}


def _corner(i: Column, j: Column) -> Column:
    """A corner of the lattice, moved by a little; neighbours share it."""
    return F.struct((i + (F.pmod(i * 7 + j * 13, F.lit(11)) - 5) / 20.0).alias("x"), (j + (F.pmod(i * 5 + j * 3, F.lit(7)) - 3) / 16.0).alias("y"))


def tract_shapes(b: Binding) -> DataFrame:
    """geoid, pop, rurality, polygon; every fifth tract has a square hole."""
    i, j = F.col("k") % ROW, F.floor(F.col("k") / ROW)
    at = lambda dx, dy: F.struct((i + dx).alias("x"), (j + dy).alias("y"))
    outer = F.array(_corner(i, j), _corner(i + 1, j), _corner(i + 1, j + 1), _corner(i, j + 1))
    hole = F.array(at(0.35, 0.35), at(0.35, 0.65), at(0.65, 0.65), at(0.65, 0.35))
    polygon = F.when(F.col("k") % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return b.tracts.select("geoid", "k", "pop", "rurality", polygon.cast(POLYGON).alias("polygon"))


def zone_shapes(b: Binding) -> DataFrame:
    """coord_id, minutes, polygon: four nested hexagons around each supplier, of suppliers without a supply too."""
    s = F.col("s_suppkey")
    x, y = s * 37 % 400 / 10.0, s * 53 % 350 / 10.0
    rows = b.raw("supplier").select(origin("s_suppkey").alias("coord_id"), s.alias("s"), x.alias("x"), y.alias("y"), F.explode(F.create_map(*[F.lit(v) for kv in REACH.items() for v in kv])).alias("band", "reach"))
    reach = F.col("reach") + F.col("s") % 5 * 0.03
    ring = F.array(*[F.struct((F.col("x") + reach * a).alias("x"), (F.col("y") + reach * c).alias("y")) for a, c in CORNERS])
    return rows.select("coord_id", (F.col("band") + 0.25).alias("minutes"), F.array(ring).cast(POLYGON).alias("polygon"))


def _sql_corner(i: str, j: str) -> str:
    return f"struct_pack(x := ({i}) + ((({i}) * 7 + ({j}) * 13) % 11 - 5) / 20.0::DOUBLE, y := ({j}) + ((({i}) * 5 + ({j}) * 3) % 7 - 3) / 16.0::DOUBLE)"


_OUTER = "[" + ", ".join(_sql_corner(a, c) for a, c in (("i", "j"), ("i + 1", "j"), ("i + 1", "j + 1"), ("i", "j + 1"))) + "]"
_HOLE = "[" + ", ".join(f"struct_pack(x := i + {a}::DOUBLE, y := j + {c}::DOUBLE)" for a, c in ((0.35, 0.35), (0.35, 0.65), (0.65, 0.65), (0.65, 0.35))) + "]"
_HEX = ", ".join(f"({n}, {a}::DOUBLE, {c}::DOUBLE)" for n, (a, c) in enumerate(CORNERS))

#: Edges of tracts and zones: id, x1, y1, x2, y2.
EDGES = f"""
lattice AS (SELECT geoid, k, k % {ROW} AS i, k // {ROW} AS j FROM tracts),
rings AS (SELECT geoid, {_OUTER} AS p FROM lattice UNION ALL SELECT geoid, {_HOLE} FROM lattice WHERE k % 5 = 0),
tedges AS (SELECT geoid, p[n].x AS x1, p[n].y AS y1, p[n % 4 + 1].x AS x2, p[n % 4 + 1].y AS y2 FROM (SELECT geoid, p, unnest(range(1, 5)) AS n FROM rings)),
around AS (SELECT s_suppkey AS s, s_suppkey * 37 % 400 / 10.0::DOUBLE AS x, s_suppkey * 53 % 350 / 10.0::DOUBLE AS y, band, reach + s_suppkey % 5 * 0.03::DOUBLE AS reach
           FROM supplier, (VALUES {", ".join(f"({b}, {v}::DOUBLE)" for b, v in REACH.items())}) v(band, reach)),
points AS (SELECT s, band, n, x + reach * a AS x, y + reach * c AS y FROM around, (VALUES {_HEX}) v(n, a, c)),
zedges AS (SELECT 'S' || lpad(CAST(p.s AS VARCHAR), 7, '0') AS coord_id, p.band, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
           FROM points p JOIN points q ON p.s = q.s AND p.band = q.band AND q.n = (p.n + 1) % 6)"""


def _boxes(name: str, edges: str, keys: str, size: float) -> str:
    """All cells of the bounding boxes."""
    return f"""{name} AS (SELECT {keys}, cx, unnest(range(y0, y1 + 1)) AS cy FROM (SELECT *, unnest(range(x0, x1 + 1)) AS cx FROM (
  SELECT {keys}, CAST(floor(min(x1) / {size}) AS BIGINT) AS x0, CAST(floor(max(x1) / {size}) AS BIGINT) AS x1, CAST(floor(min(y1) / {size}) AS BIGINT) AS y0, CAST(floor(max(y1) / {size}) AS BIGINT) AS y1
  FROM {edges} GROUP BY {keys})))"""


def _centres(name: str, edges: str, keys: str, size: float) -> str:
    """Cells whose centres have an odd number of edges to their right."""
    px, py = f"((cx + 0.5) * {size}::DOUBLE)", f"((cy + 0.5) * {size}::DOUBLE)"
    return _boxes(f"{name}_box", edges, keys, size) + f""", {name} AS (
  SELECT {keys}, cx, cy FROM {name}_box JOIN {edges} USING ({keys}) WHERE (y1 > {py}) <> (y2 > {py}) AND {px} < x1 + ({py} - y1) / (y2 - y1) * (x2 - x1)
  GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _covers(name: str, edges: str, keys: str, size: float) -> str:
    """Covered fractions: each edge's integral of x, held within the cell's sides, over the cell's height."""
    g = lambda t: f"CASE WHEN {t} < 0 THEN 0 WHEN {t} < {size} THEN {t} * {t} / 2 ELSE {size} * {size} / 2 + {size} * ({t} - {size}) END"
    held = lambda t: f"greatest(0, least({size}, {t}))"
    return _boxes(f"{name}_box", edges, keys, size) + f""", {name}_cut AS (
  SELECT {keys}, cx, cy, x1, y1, (x2 - x1) / (y2 - y1) AS slope, greatest(cy * {size}::DOUBLE, least((cy + 1) * {size}::DOUBLE, y1)) AS ya, greatest(cy * {size}::DOUBLE, least((cy + 1) * {size}::DOUBLE, y2)) AS yb
  FROM {name}_box JOIN {edges} USING ({keys}) WHERE y1 <> y2),
{name}_at AS (SELECT *, x1 + (ya - y1) * slope - cx * {size}::DOUBLE AS s, x1 + (yb - y1) * slope - cx * {size}::DOUBLE AS t FROM {name}_cut WHERE ya <> yb),
{name} AS (SELECT * FROM (
  SELECT {keys}, cx, cy, sum((yb - ya) * CASE WHEN abs(t - s) < 1e-9 THEN {held('s')} ELSE (({g('t')}) - ({g('s')})) / (t - s) END) / ({size} * {size}) AS fraction
  FROM {name}_at GROUP BY {keys}, cx, cy) WHERE fraction > 1e-9)"""


TRACT_CELLS = EDGES + ", " + _centres("tcent", "tedges", "geoid", SIZE)
TRACT_COVER = EDGES + ", " + _covers("tcov", "tedges", "geoid", SIZE)


def _chain(size: float, tag: str = "") -> str:
    """From polygons to the surface: cells, zone populations, and runs of centres."""
    return f"""{_covers(f"tcov{tag}", "tedges", "geoid", size)}, {_covers(f"zcov{tag}", "zedges", "coord_id, band", size)}, {_centres(f"zcent{tag}", "zedges", "coord_id, band", size)},
rbridge{tag} AS (SELECT geoid, cx, cy, fraction * {size} * {size} AS area FROM tcov{tag}),
rcells{tag} AS (SELECT cx, cy, sum(pop * area / whole) AS pop FROM rbridge{tag} JOIN tracts USING (geoid) JOIN (SELECT geoid, sum(area) AS whole FROM rbridge{tag} GROUP BY 1) USING (geoid) GROUP BY 1, 2),
rpop{tag} AS (SELECT coord_id, band, sum(pop * fraction) AS pop FROM zcov{tag} JOIN rcells{tag} USING (cx, cy) SEMI JOIN supply USING (coord_id) GROUP BY 1, 2)"""


CHAIN = EDGES + ", " + _chain(SIZE) + """,
rratio AS (SELECT s.coord_id, supply, coalesce(d, 0) AS weighted_demand, CASE WHEN d > 0 THEN supply / d END AS ratio, coalesce(CASE WHEN d > 0 THEN supply / d END, 0) AS ratio_for_surface,
           coalesce(d, 0) <= 0 AS zero_demand, CASE WHEN d > 0 THEN 0 ELSE supply END AS excluded_supply
           FROM supply s LEFT JOIN (SELECT coord_id, sum(w1 * pop) AS d FROM rpop JOIN w USING (band) GROUP BY 1) USING (coord_id)),
rsurf AS (SELECT cx, cy, pop, coalesce(a, 0) AS a FROM rcells LEFT JOIN (SELECT cx, cy, sum(w1 * ratio) AS a FROM zcent JOIN rratio USING (coord_id) JOIN w USING (band) GROUP BY 1, 2) USING (cx, cy))"""


def _grid(b: Binding, size: float = SIZE, check: bool = False) -> raster.Grid:
    """The tracts' grid; ``raster_population`` and ``raster_access`` check what the others read too."""
    return raster.build_grid(tract_shapes(b), size, check=check)


def _access(b: Binding, check: bool = False, **more) -> raster.RasterAccess:
    return raster.raster_access(_grid(b, check=check), raster.prepare_zones(zone_shapes(b), SIZE), b.supply, check=check, **more)


@query(f"SELECT geoid, {r('area', 'x', 'y', digits=9)}, n_cells FROM (SELECT geoid, sum(x1 * y2 - x2 * y1) / 2 AS area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / sum(x1 * y2 - x2 * y1) / 3 AS x, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / sum(x1 * y2 - x2 * y1) / 3 AS y FROM tedges GROUP BY 1) LEFT JOIN (SELECT geoid, count(*) AS n_cells FROM tcent GROUP BY 1) USING (geoid)", TRACT_CELLS, digits=9)
def tract_geometry(b: Binding) -> DataFrame:
    shapes = tract_shapes(b)
    x, y = polygon_centroid(F.col("polygon"))
    return raster.tract_geometry(shapes, SIZE).join(grid.apart(shapes.select("geoid", x.alias("x"), y.alias("y"))), "geoid")


@query("SELECT geoid, cx AS cell_x, cy AS cell_y FROM tcent", TRACT_CELLS)
def tract_cells(b: Binding) -> DataFrame:
    return raster.cells_of_runs(raster.centre_runs(tract_shapes(b), SIZE, "geoid")).select("geoid", "cell_x", "cell_y")


@query(f"SELECT geoid, cx AS cell_x, cy AS cell_y, {r('fraction', digits=9)} FROM tcov", TRACT_COVER, digits=9)
def cell_coverage(b: Binding) -> DataFrame:
    return raster.cells_of_runs(raster.coverage_runs(tract_shapes(b), SIZE, "geoid")).select("geoid", "cell_x", "cell_y", "fraction")


@query(f"SELECT cx AS cell_x, cy AS cell_y, {r('pop', digits=4)} FROM rcells", EDGES + ", " + _chain(SIZE), digits=4)
def raster_population(b: Binding) -> DataFrame:
    return _grid(b, check=True).cells.select("cell_x", "cell_y", "pop")


@query(f"SELECT coord_id, band, {r('pop', digits=3)} FROM rpop", EDGES + ", " + _chain(SIZE), digits=3)
def raster_zonal_population(b: Binding) -> DataFrame:
    zones = raster.prepare_zones(zone_shapes(b), SIZE).cover.join(b.supply.select("coord_id"), "coord_id", "left_semi")
    return raster.zonal_population(_grid(b).cells, zones).where("pop > 1e-6")


@query(f"SELECT coord_id, {r('supply', 'weighted_demand', 'ratio * 1e5 AS ratio', 'ratio_for_surface * 1e5 AS ratio_for_surface', 'excluded_supply', digits=3)}, zero_demand FROM rratio", CHAIN, digits=3)
def raster_ratios(b: Binding) -> DataFrame:
    return _access(b).ratios.withColumns({c: F.col(c) * 1e5 for c in ("ratio", "ratio_for_surface")})


@query(f"SELECT geoid, {r('1e5 * sum(a * area) / sum(area) AS mean', '1e5 * sum(a * area * pop) / nullif(sum(area * pop), 0) AS weighted_mean', digits=5)} FROM rbridge JOIN rsurf USING (cx, cy) GROUP BY 1", CHAIN, digits=5)
def raster_access(b: Binding) -> DataFrame:
    return _access(b, check=True).access.select("geoid", F.col("access_mean_area_scaled").alias("mean"), F.col("access_mean_population_scaled").alias("weighted_mean"))


@query(f"SELECT count(*) FILTER (zero_demand) AS n_zero_demand_origins, {r('sum(excluded_supply) AS supply_zero_demand', 'sum(excluded_supply) / sum(supply) AS share_supply_zero_demand')}, [] :: INTEGER[] AS bands_outside, CAST(0 AS BIGINT) AS runs_dropped FROM rratio", CHAIN)
def raster_audit(b: Binding) -> DataFrame:
    return _access(b).audit


@query(
    f"""SELECT count(*) AS n_cells_valid, {r('sum(pop) AS pop_valid_total', 'sum(pop * a * 1e5) / sum(pop) AS mean_scaled', 'sum(CASE WHEN a * 1e5 >= t THEN pop ELSE 0 END) / sum(pop) AS share_pop', digits=5)}, t AS threshold
  FROM rsurf, (VALUES (0.0::DOUBLE), (1.0), (5.0), (10.0), (20.0), (50.0)) v(t) GROUP BY t""",
    CHAIN, digits=5,
)
def raster_national(b: Binding) -> DataFrame:
    return _access(b).national.select("n_cells_valid", "pop_valid_total", "mean_scaled", "share_pop", "threshold")


_HALF = CHAIN.replace("w1 * ratio", "w2 * ratio")


@query(f"SELECT geoid, {r('1e5 * sum(a * area) / sum(area) AS mean', digits=5)} FROM rbridge JOIN rsurf USING (cx, cy) GROUP BY 1", _HALF, digits=5)
def raster_access_modified(b: Binding) -> DataFrame:
    return _access(b, power=2.0).access.select("geoid", F.col("access_mean_area_scaled").alias("mean"))


_BY_SIZE = EDGES + "".join(f", {_chain(size, tag)}" for size, tag in ((1.0, "_1"), (0.5, "_2"))) + ", " + ", ".join(
    f"""rmean{tag} AS (SELECT geoid, sum(coalesce(a, 0) * area) / sum(area) AS a FROM rbridge{tag} LEFT JOIN (
  SELECT cx, cy, sum(w1 * supply / d) AS a FROM zcent{tag} JOIN supply USING (coord_id) JOIN (SELECT coord_id, sum(w1 * pop) AS d FROM rpop{tag} JOIN w USING (band) GROUP BY 1 HAVING d > 0) USING (coord_id) JOIN w USING (band) GROUP BY 1, 2) USING (cx, cy) GROUP BY 1)"""
    for tag in ("_1", "_2")
)


@query(" UNION ALL ".join(f"SELECT '{name}' AS variant, geoid, {r('1e5 * a AS mean', digits=5)} FROM rmean{tag}" for name, tag in (("base", "_1"), ("res500", "_2"))), _BY_SIZE, digits=5)
def raster_resolutions(b: Binding) -> DataFrame:
    """The variants that differ by the size of cells alone."""
    shapes, zones = tract_shapes(b), zone_shapes(b)
    grids = {m: (raster.build_grid(shapes, m / 1000, check=False), raster.prepare_zones(zones, m / 1000)) for m in (1000, 500)}
    variants = {n: v for n, v in raster.wt.variants().items() if n in ("base", "res500")}
    return raster.raster_variants(grids, b.supply, variants).select("variant", "geoid", (F.col("mean") * 1e5).alias("mean"))


#: Boxes: tracts (whole, fifths shifted) and the zones of an hour around suppliers with a supply.
_BOXED = """tb AS (SELECT geoid, pop, k % 40 AS x0, k % 40 + 1 + k % 5 * 0.2::DOUBLE AS x1, k // 40 AS y0, k // 40 + 1 + k % 3 * 0.3::DOUBLE AS y1 FROM tracts),
zb AS (SELECT coord_id, x - 1.3::DOUBLE AS u0, x + 1.1::DOUBLE AS u1, y - 0.9::DOUBLE AS v0, y + 1.7::DOUBLE AS v1
       FROM (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS coord_id, s_suppkey * 37 % 400 / 10.0::DOUBLE AS x, s_suppkey * 53 % 350 / 10.0::DOUBLE AS y FROM supplier)),
cut AS (SELECT geoid, greatest(x0, u0) AS a0, least(x1, u1) AS a1, greatest(y0, v0) AS b0, least(y1, v1) AS b1 FROM tb, zb WHERE x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1),
xs AS (SELECT geoid, x, lead(x) OVER (PARTITION BY geoid ORDER BY x) AS nx FROM (SELECT geoid, a0 AS x FROM cut UNION SELECT geoid, a1 FROM cut)),
ys AS (SELECT geoid, y, lead(y) OVER (PARTITION BY geoid ORDER BY y) AS ny FROM (SELECT geoid, b0 AS y FROM cut UNION SELECT geoid, b1 FROM cut)),
covered AS (SELECT geoid, sum((nx - x) * (ny - y)) AS a FROM xs JOIN ys USING (geoid) WHERE nx IS NOT NULL AND ny IS NOT NULL
            AND EXISTS (SELECT 1 FROM cut c WHERE c.geoid = xs.geoid AND c.a0 <= x AND c.a1 >= nx AND c.b0 <= y AND c.b1 >= ny) GROUP BY 1),
uf AS (SELECT geoid, pop, coalesce(a, 0) / ((x1 - x0) * (y1 - y0)) AS fraction FROM tb LEFT JOIN covered USING (geoid))"""


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])).cast(POLYGON)


def _union(b: Binding) -> DataFrame:
    k, s = F.col("k"), F.col("s_suppkey")
    i, j = k % ROW, F.floor(k / ROW)
    tracts = b.tracts.select("geoid", "pop", _box(i, j, i + 1 + k % 5 * 0.2, j + 1 + k % 3 * 0.3).alias("polygon"))
    x, y = s * 37 % 400 / 10.0, s * 53 % 350 / 10.0
    zones = b.raw("supplier").select(origin("s_suppkey").alias("zone"), _box(x - 1.3, y - 0.9, x + 1.1, y + 1.7).alias("polygon"))
    return tracts.select("geoid", "pop").join(geometry.union_fractions(zones, tracts, 1.0), "geoid")


@query(f"SELECT geoid, {r('fraction', digits=9)} FROM uf", _BOXED, digits=9)
def union_fractions(b: Binding) -> DataFrame:
    return _union(b).select("geoid", "fraction")


@query(
    f"""SELECT {r('t AS total_population', 'a AS accessible_population')}, n_tracts_total, n_tracts_with_access, {r('100 * p AS percent_accessible', '100 * sqrt(p * (1 - p) / t) AS percent_se', '100 * p - 196 * sqrt(p * (1 - p) / t) AS percent_ci_lower', '100 * p + 196 * sqrt(p * (1 - p) / t) AS percent_ci_upper')}
  FROM (SELECT *, a / t AS p FROM (SELECT sum(CAST(pop AS DOUBLE)) AS t, sum(fraction * pop) AS a, count(*) AS n_tracts_total, count(*) FILTER (fraction >= 0.001) AS n_tracts_with_access FROM uf))""",
    _BOXED,
)
def accessible_population(b: Binding) -> DataFrame:
    """Coverage of one band with its error: areas of the zones' union, counted once where they overlap."""
    return coverage.accessible_population(_union(b))


def former_shapes(b: Binding) -> DataFrame:
    """Tracts of another vintage: boxes that fit neither the cells nor the lattice: geoid, polygon."""
    i, j = F.col("k") % 26 * 1.7 - 1, F.floor(F.col("k") / 26) * 1.3 - 1
    return b.tracts.select("geoid", _box(i, j, i + 1.7, j + 1.3).alias("polygon"))


def _center(tag: str, pops: str, cents: str) -> str:
    return f"{tag} AS (SELECT cx, cy, sum(pop / n) AS pop FROM {cents} JOIN {pops} USING (geoid) JOIN (SELECT geoid, count(*) AS n FROM {cents} GROUP BY 1) USING (geoid) GROUP BY 1, 2)"


def _recaptured(tag: str, cells: str) -> str:
    return f"{tag} AS (SELECT geoid, sum(pop * fraction) AS pop FROM fcov JOIN {cells} USING (cx, cy) GROUP BY 1)"


_SEAM = f"""{EDGES}, frings AS (SELECT geoid, k % 26 * 1.7::DOUBLE - 1 AS a, k // 26 * 1.3::DOUBLE - 1 AS b FROM tracts),
fpoints AS (SELECT geoid, [{{'x': a, 'y': b}}, {{'x': a + 1.7::DOUBLE, 'y': b}}, {{'x': a + 1.7::DOUBLE, 'y': b + 1.3::DOUBLE}}, {{'x': a, 'y': b + 1.3::DOUBLE}}] AS p FROM frings),
fedges AS (SELECT geoid, p[n].x AS x1, p[n].y AS y1, p[n % 4 + 1].x AS x2, p[n % 4 + 1].y AS y2 FROM (SELECT geoid, p, unnest(range(1, 5)) AS n FROM fpoints)),
{_covers("tcov", "tedges", "geoid", SIZE)}, {_covers("fcov", "fedges", "geoid", SIZE)}, {_centres("tcent", "tedges", "geoid", SIZE)}, {_centres("fcent", "fedges", "geoid", SIZE)},
area_a AS (SELECT cx, cy, sum(pop * fraction / whole) AS pop FROM tcov JOIN tracts USING (geoid) JOIN (SELECT geoid, sum(fraction) AS whole FROM tcov GROUP BY 1) USING (geoid) GROUP BY 1, 2),
{_center("raw_a", "tracts", "tcent")}, {_recaptured("farea", "area_a")}, {_recaptured("fraw", "raw_a")}, {_center("raw_b", "fraw", "fcent")},
area_b AS (SELECT cx, cy, sum(pop * fraction / whole) AS pop FROM fcov JOIN farea USING (geoid) JOIN (SELECT geoid, sum(fraction) AS whole FROM fcov GROUP BY 1) USING (geoid) GROUP BY 1, 2),
seams AS ({" UNION ALL ".join(f"SELECT '{m}' AS method, '{v}' AS vintage, cx, cy, pop{scale} AS pop FROM {t}" for m, v, t, scale in (
    ("raw", "current", "raw_a", ""), ("raw", "former", "raw_b", ""), ("equal_total", "current", "raw_a", ""), ("equal_total", "former", "raw_b", " * (SELECT sum(pop) FROM raw_a) / (SELECT sum(pop) FROM raw_b)"),
    ("mass_conserving", "current", "area_a", ""), ("mass_conserving", "former", "area_b", ""), ("mass_conserving_eqtot", "current", "area_a", ""), ("mass_conserving_eqtot", "former", "area_b", " * (SELECT sum(pop) FROM area_a) / (SELECT sum(pop) FROM area_b)")))})"""


@query(f"SELECT method, vintage, {r('sum(pop) AS total', 'sum(pop * cx) / sum(pop) AS x', 'sum(pop * cy) / sum(pop) AS y', 'max(pop) AS most', digits=4)} FROM seams GROUP BY 1, 2", _SEAM, digits=4)
def seam_populations(b: Binding) -> DataFrame:
    """Totals, centres and greatest cells of the populations that the seam test compares."""
    rows = raster.seam_populations(tract_shapes(b), former_shapes(b), SIZE)
    mean = lambda c: F.sum(F.col("pop") * F.col(c)) / F.sum("pop")
    return rows.groupBy("method", "vintage").agg(F.sum("pop").alias("total"), mean("cell_x").alias("x"), mean("cell_y").alias("y"), F.max("pop").alias("most"))

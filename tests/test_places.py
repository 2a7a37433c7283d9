"""Projection constants, polygons, nearest searches, grids."""

import math
import random

from florapark.functions import projection as P
from florapark.operators import grid as G, mapping as MP, properties as R, raster as RA, spatial as SP
from pyspark.sql import functions as F

SIDES = "area_code int, ring_id int, x1 double, y1 double, x2 double, y2 double"


def ring(area, points, ring_id=0):
    return [(area, ring_id, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def crossings(x, y, sides):
    return sum(1 for _, _, x1, y1, x2, y2 in sides if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)) % 2 == 1


def test_grid_extent_constants(spark):
    r = spark.range(1).select(P.project_x(F.lit(180.0)).alias("x"), P.project_y(F.lit(85.0445664)).alias("y")).first()
    assert abs(r["x"] - 17367530.445) < 0.01 and abs(r["y"] - 7314540.831) < 0.05


def test_inverse_projection(spark):
    pts = spark.range(2000).selectExpr("id * 0.179D - 179 AS lon", "id * 0.0899D - 89.9 AS lat")
    back = pts.select("lon", "lat", P.unproject_lon(P.project_x("lon")).alias("lon2"), P.unproject_lat(P.project_y("lat")).alias("lat2"))
    r = back.agg(F.max(F.abs(F.col("lon") - F.col("lon2"))).alias("a"), F.max(F.abs(F.col("lat") - F.col("lat2"))).alias("b")).first()
    assert r["a"] < 1e-9 and r["b"] < 1e-6


def test_points_in_random_polygons(spark):
    rng = random.Random(5)
    sides = []
    for a in range(6):
        cx, cy, n = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randrange(3, 12)
        pts = [(cx + rng.uniform(0.4, 1.5) * math.cos(2 * math.pi * i / n), cy + rng.uniform(0.4, 1.5) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        sides += ring(a, pts)
    # a hole
    sides += ring(9, [(4, 4), (6, 4), (6, 6), (4, 6)]) + ring(9, [(4.5, 4.5), (5.5, 4.5), (5.5, 5.5), (4.5, 5.5)], 1)
    pts = [(rng.uniform(-5, 7), rng.uniform(-5, 7)) for _ in range(800)] + [(5.0, 5.0), (4.2, 4.2)]
    got = SP.containing_areas(spark.createDataFrame(pts, "lon double, lat double"), spark.createDataFrame(sides, SIDES))
    want = {(x, y, a) for x, y in pts for a in {s[0] for s in sides} if crossings(x, y, [s for s in sides if s[0] == a])}
    assert {tuple(r) for r in got.collect()} == want and want


def test_points_on_the_grid_and_in_a_ragged_coast(spark):
    """Sides on the edges and corners of cells, level and upright ones, and very many sides in few cells."""
    rng = random.Random(15)
    sides = ring(1, [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]) + ring(1, [(0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7)], 1)
    sides += ring(2, [(-1.0, -1.0), (0.0, 0.0), (1.0, -1.0), (0.0, -2.0)])  # slopes through the corners of cells
    n = 3000
    coast = [(3 + (1 + 0.2 * rng.random()) * math.cos(2 * math.pi * i / n), 3 + (1 + 0.2 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    sides += ring(3, coast)
    pts = {(i / 10 + d, j / 10 + e) for i in range(-12, 24) for j in range(-22, 24) for d, e in ((0.0, 0.0), (0.05, 0.0), (0.0, 0.05), (0.03, 0.07))}
    pts |= {(rng.uniform(1.7, 4.3), rng.uniform(1.7, 4.3)) for _ in range(1500)}
    by_area = {a: [s for s in sides if s[0] == a] for a in (1, 2, 3)}
    got = {tuple(r) for r in SP.containing_areas(spark.createDataFrame(list(pts), "lon double, lat double"), spark.createDataFrame(sides, SIDES)).collect()}
    want = {(x, y, a) for x, y in pts for a in by_area if crossings(x, y, by_area[a])}
    assert got == want


def test_no_list_of_sides_is_built(spark):
    sides = spark.createDataFrame(ring(1, [(0, 0), (2, 0), (1, 1)]), SIDES)
    plan = SP.containing_areas(spark.createDataFrame([(1.0, 0.5)], "lon double, lat double"), sides)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_nearest_area_near_and_far(spark):
    rng = random.Random(6)
    sides = []
    for a in range(5):
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        sides += ring(a, [(cx, cy), (cx + 1, cy), (cx + 0.5, cy + 1)])
    pts = [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(60)] + [(170.0, -80.0), (-179.0, 85.0), (90.0, 0.0)]

    def dist(x, y, s):
        _, _, x1, y1, x2, y2 = s
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    got = {(r["lon"], r["lat"]): r["area_code"] for r in SP.nearest_area(
        spark.createDataFrame(pts, "lon double, lat double"), spark.createDataFrame(sides, SIDES)).collect()}
    assert len(got) == len(pts)
    for x, y in pts:
        assert got[(x, y)] == min(sides, key=lambda s: (dist(x, y, s), s[0]))[0]


def wrapped(x, y, s):
    _, _, x1, y1, x2, y2 = s
    out = []
    for px in (x, x - 360, x + 360):
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        out.append(math.hypot(px - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
    return min(out)


def test_nearest_area_over_the_meridian_and_far_out(spark):
    rng = random.Random(16)
    sides = []
    for a in range(12):
        cx, cy, r = rng.uniform(-179, 179), rng.uniform(-60, 60), rng.choice([0.05, 0.5, 8.0])
        sides += ring(a, [(cx, cy), (cx + r, cy), (cx + r / 2, cy + r)])
    sides += ring(20, [(179.2, 10.0), (179.9, 10.0), (179.5, 10.7)]) + ring(21, [(-179.0, 40.0), (-178.0, 40.0), (-178.5, 41.0)])
    pts = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(150)]
    pts += [(-179.95, 10.1), (-179.5, 10.2), (179.9, 40.2), (-180.0, 10.0), (180.0, 40.0), (-150.0, -90.0), (0.0, 90.0)]
    got = {(r["lon"], r["lat"]): r["area_code"] for r in SP.nearest_area(
        spark.createDataFrame(pts + [(None, 1.0)], "lon double, lat double"), spark.createDataFrame(sides, SIDES)).collect()}
    assert len(got) == len(set(pts))
    for x, y in pts:
        assert got[(x, y)] == min(sides, key=lambda s: (wrapped(x, y, s), s[0]))[0], (x, y)
    assert got[(-179.95, 10.1)] == 20 and got[(179.9, 40.2)] == 21
    none = spark.createDataFrame([], SIDES)
    assert SP.nearest_area(spark.createDataFrame(pts, "lon double, lat double"), none).count() == 0


def test_far_points_meet_few_cells(spark):
    """A coast round half the globe: a tile in the open sea looks at a small part of its cells."""
    coast = [(-90 + i * 0.05, 30 * math.sin(i / 90)) for i in range(3600)]
    cells = spark.createDataFrame({(math.floor(x / 0.75) % 480, math.floor(y / 0.75), True) for x, y in coast}, "_cx long, _cy long, ends boolean")
    tiles = spark.createDataFrame([(240, 0), (200, -100), (300, 90)], "px long, py long")
    n = {(r["px"], r["py"]): r["count"] for r in SP.far_candidates(tiles, cells).groupBy("px", "py").count().collect()}
    assert len(n) == 3 and max(n.values()) * 10 < cells.count()


def test_cells_touched_by_a_triangle(spark):
    """Against a fine sampling of the sides plus the test of cell centres."""
    tri = ring(1, [(8.0, 46.0), (8.13, 46.02), (8.05, 46.09)])
    df = spark.createDataFrame(tri, SIDES)
    got = {(r["gx"], r["gy"]) for r in SP.area_cells(df).collect()}
    proj = [(r["ax"] / 1000, r["ay"] / 1000) for r in df.select(P.project_x("x1").alias("ax"), P.project_y("y1").alias("ay")).collect()]
    want = set()
    for (ax, ay), (bx, by) in zip(proj, proj[1:] + proj[:1]):
        for i in range(40001):
            f = i / 40000
            want.add((math.floor(ax + f * (bx - ax)), math.floor(ay + f * (by - ay))))
    xs, ys = [p[0] for p in proj], [p[1] for p in proj]
    flat = [(0, 0, *a, *b) for a, b in zip(proj, proj[1:] + proj[:1])]
    for gx in range(math.floor(min(xs)), math.ceil(max(xs))):
        for gy in range(math.floor(min(ys)), math.ceil(max(ys))):
            if crossings(gx + 0.5, gy + 0.5, flat):
                want.add((gx, gy))
    assert want <= got and len(got - want) <= 1


def test_fill_uses_the_nearest_valid_pixel_within_the_radius(spark):
    rng = random.Random(8)
    pixels = [("a", r, c, (float(r * 1000 + c) if rng.random() < 0.002 else None)) for r in range(80) for c in range(80)]
    raster = spark.createDataFrame(pixels, "layer string, pix_row bigint, pix_col bigint, value double")
    pts = raster.withColumn("id", F.monotonically_increasing_id())
    got = {(r["pix_row"], r["pix_col"]): (r["value"], r["filled"]) for r in RA.fill_nodata_nearest(pts, raster, radius=20).collect()}
    valid = [(r, c, v) for _, r, c, v in pixels if v is not None]
    for _, r, c, v in pixels:
        if v is not None:
            assert got[(r, c)] == (v, False)
            continue
        d2, vr, vc, best = min(((r - a) ** 2 + (c - b) ** 2, a, b, x) for a, b, x in valid)
        assert got[(r, c)] == ((best, True) if d2 <= 400 else (None, False))


def test_fill_sees_over_the_borders_of_tiles(spark):
    # valid pixels on either side of row and column 512, 1024 and of zero; two layers; a repeated pixel
    valid = [("a", 510, 511, 1.0), ("a", 515, 515, 2.0), ("a", 1030, -3, 3.0), ("b", 511, 513, 4.0), ("b", 511, 513, 5.0), ("a", 900, 900, None)]
    wanted = [("a", 512, 512), ("a", 511, 514), ("a", 1020, 4), ("a", 1023, 30), ("b", 513, 511), ("b", 700, 700), ("a", 900, 900)]
    raster = spark.createDataFrame(valid, "layer string, pix_row bigint, pix_col bigint, value double")
    points = spark.createDataFrame([(*w, None) for w in wanted] + [(None, None, None, None)],
                                   "layer string, pix_row bigint, pix_col bigint, value double")
    got = {tuple(r)[:3]: r["value"] for r in RA.fill_nodata_nearest(points, raster, radius=20).select("layer", "pix_row", "pix_col", "value").collect()}
    want = {}
    for layer, r, c in wanted:
        near = [((r - a) ** 2 + (c - b) ** 2, a, b, v) for la, a, b, v in valid if la == layer and v is not None]
        best = min(near)
        want[(layer, r, c)] = best[3] if best[0] <= 400 else None
    assert got == {**want, (None, None, None): None}
    assert want[("a", 512, 512)] == 1.0 and want[("b", 513, 511)] == 4.0 and want[("a", 1020, 4)] == 3.0


def test_fill_moves_each_pixel_once(spark):
    raster = spark.range(10).selectExpr("'a' AS layer", "id AS pix_row", "id AS pix_col", "IF(id % 2 = 0, id * 1.0D, NULL) AS value")
    plan = RA.fill_nodata_nearest(raster, raster)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Cross" not in plan


def test_nearest_background_equals_brute_force(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(0, 2), rng.uniform(0, 1)) for i in range(150)]
    res = 0.1
    bg = spark.createDataFrame(pts, "point_id int, lon double, lat double")
    box = spark.createDataFrame([(0.05, 0.05, 1.9, 0.95)], "min_x double, min_y double, max_x double, max_y double")
    got = {(r["row"], r["col"]): r["point_id"] for r in MP.nearest_background(bg, box, res).collect()}
    grid = {(r["row"], r["col"]): (r["lon"], r["lat"]) for r in G.regular_grid(box, res).collect()}
    inside = [p for p in pts if 0.05 <= p[1] <= 1.9 and 0.05 <= p[2] <= 0.95]
    want = {}
    for k, (x, y) in grid.items():
        d, i = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, a, b in inside)
        if d <= 1.5 * res:
            want[k] = i
    assert got == want and want


def test_regular_grid_keeps_the_far_edge(spark):
    box = spark.createDataFrame([(0.0, 0.0, 1.0, 0.5)], "min_x double, min_y double, max_x double, max_y double")
    g = G.regular_grid(box, 0.25).collect()
    assert len(g) == 5 * 3 and {r["flat_index"] for r in g} == set(range(15))


def test_flat_map_rescales_to_zero_and_all_cells_stand_in(spark):
    rows = [(1, 0.3, True), (1, 0.3, True), (2, 0.1, False), (2, 0.9, False)]
    df = spark.createDataFrame(rows, "species_id int, value double, in_range boolean")
    got = sorted((r["species_id"], r["value"], r["scaled"]) for r in MP.rescale(df, "linear", 0, 100).collect())
    assert got == [(1, 0.3, 0.0), (1, 0.3, 0.0), (2, 0.1, 0.0), (2, 0.9, 1.0)]


def test_golden_sampling_properties(spark):
    """Three published property rows: cells in range, visited, observed."""
    golden = [(0, 2539656, 154116, 1613, 6.068380914580557, 1.0466142386254509),
              (1, 2157437, 996089, 1294, 46.170015625021726, 0.129908070463583),
              (2, 6357364, 280023, 14418, 4.404702955501683, 5.148862771986587)]
    # one area per species, with so many locations, built by Spark
    locations = None
    for s, n, v, k, _, _ in golden:
        part = spark.range(n).selectExpr(f"id + {s} * 10000000 AS location_id", f"{s} AS area_code", f"id < {v} AS seen", f"id < {k} AS own")
        locations = part if locations is None else locations.unionByName(part)
    presence = locations.where("own").selectExpr("location_id", "area_code AS species_id").unionByName(
        locations.where("seen AND NOT own").selectExpr("location_id", "-1 AS species_id"))
    species = spark.createDataFrame([(s,) for s, *_ in golden], "species_id int")
    ranges = spark.createDataFrame([(s, s) for s, *_ in golden], "species_id int, area_code int")
    got = {r["species_id"]: r for r in R.sampling_properties(species, presence, locations, ranges).collect()}
    for s, n, v, k, se, rp in golden:
        r = got[s]
        assert (r["n_cells_in_range"], r["n_cells_visited_in_range"], r["n_species_obs"]) == (n, v, k)
        assert math.isclose(r["sampling_effort"], se, rel_tol=1e-12) and math.isclose(r["relative_prevalence"], rp, rel_tol=1e-12)


def test_species_of_one_range_share_their_grid(spark):
    """The shared grid is the grid of each species; pairs of species and locations are not formed."""
    import random

    from florapark.operators import mapping as MP

    rng = random.Random(3)
    places = [(i, rng.choice([1, 2, 3, None]), rng.randrange(40) * 0.25, rng.randrange(30) * 0.5) for i in range(400)]
    ranges = [(1, 1), (1, 2), (2, 2), (2, 1), (2, 1), (3, 3), (4, 9)]
    seen = [(rng.randrange(1, 6), rng.randrange(400)) for _ in range(200)]
    locations = spark.createDataFrame(places, "location_id bigint, area_code int, lon double, lat double")
    species_area = spark.createDataFrame(ranges, "species_id int, area_code int")
    presence = spark.createDataFrame(seen + seen[:9], "species_id int, location_id bigint")
    pairs = locations.join(species_area.distinct(), "area_code")
    want = MP.occurrence_grid(pairs, presence.join(pairs.drop("lon", "lat"), ["species_id", "location_id"], "left_semi").join(locations, "location_id"), max_dim=25)
    shared = MP.range_grids(locations, species_area, presence, 25)
    key = lambda df: sorted(tuple(r) for r in df.select("species_id", "row", "col", "category", "step").collect())
    assert key(shared) == key(want) and shared.count() > 100
    assert "range_id" in shared._jdf.queryExecution().analyzed().toString()

"""Tables larger than the test tables: whole results, and work that is done for many rows at once."""

import os
import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from test_stored import buildings

import __spark_entry__ as entry
from terrafoot import fixtures, queries, queries_shapes
from terrafoot.functions import geometry
from terrafoot.operators import joins, matching, overlay
from terrafoot.operators.stored import store_lookup
from terrafoot.plans.country import BuildConfig, build_country


def compared(spark, name, folder):
    """Sorted rows of the query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    return sorted(map(plain, map(tuple, df.select(*columns).collect())), key=repr), sorted(map(plain, want), key=repr)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Parts whose numbers are those of larger tables, up to the grid's rows beyond the northern end of the scale factor 0.1."""
    folder = tmp_path_factory.mktemp("far")
    rows = [(i, i % 50 + 1) for k in (0, 199_990, 1_199_990, 7_199_990, 9_000_000) for i in range(k, k + 10)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i,) for i in range(40)], "event_id long").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["occupancy_classify", "occupancy_distribution", "profile_summary", "source_distribution", "completeness_score", "floorspace_estimate", "height_parse", "height_source_distribution"])
def test_no_building_of_a_larger_grid_is_cut_off(spark, far, name):
    found, want = compared(spark, name, far)
    assert found == want and found


def _odd_batch():
    polygon, multi = geometry.encode_polygon, geometry.encode_multipolygon
    at = lambda pts, x: [(px + x, py) for px, py in pts]
    square, hole, bow = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)], [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]
    forms = []
    for x in (0.0, 10.5, -7.25):
        s, h, out = at(square, x), at(hole, x), at(hole, x + 2.5)
        forms += [polygon([s, h]), polygon([s, h], little=False), polygon([s, out]), polygon([s, at(hole, x - 1)]), polygon([s, [*h[:-1], (1.5, 1.5)]]), polygon([s, [*h[:2], *h[1:]]]), polygon([h, s])]
        forms += [multi([polygon([s]), polygon([at(square, x + 20)])]), multi([polygon([s]), polygon([at(square, x + 2)])]), multi([polygon([s, h]), polygon([at(bow, x + 9)])]), multi([polygon([s[:3]]), polygon([s])])]
        forms += [multi([polygon([s])]), polygon([s]), polygon([at(bow, x)]), polygon([[*s[:2], (float("nan"), 1.0), *s[2:]], h]), b"\x01\x06\x00\x00\x00\x02", b"xyz", None, polygon([]), polygon([[]]), multi([])]
    return forms


def test_shapes_of_one_structure_are_read_and_tested_together(monkeypatch):
    """Batches give what shapes give one by one, and shapes of several rings don't go through the general test of a single shape."""
    batch = _odd_batch()
    shapes = geometry.Shapes(pa.array(batch, pa.binary()))
    for i, data in enumerate(batch):
        found = geometry.parsed(data)
        assert shapes.kinds[i] == (found and found[0])
        for (p, h, pts), (q, g, own) in zip(found[1] if found else [], shapes.rings(i), strict=True):
            assert (p, h) == (q, g) and np.array_equal(pts, own, equal_nan=True)
    assert shapes.valid().tolist() == [bool(f and f[1]) and geometry.valid(f[1]) for f in map(geometry.parsed, batch)]
    assert 10 < shapes.valid().sum() < len(batch) - 10
    back = geometry.Shapes(shapes.encoded())
    assert np.array_equal(back.pts, shapes.pts, equal_nan=True) and (np.diff(back.row_at) == np.diff(shapes.row_at)).all()

    def refused(*_):
        raise AssertionError("one by one")

    plain = [geometry.encode_polygon([[(x, 0), (x + 4, 0), (x + 4, 4), (x, 4), (x, 0)], [(x + 1, 1), (x + 1, 3), (x + 3, 3), (x + 3, 1), (x + 1, 1)]]) for x in range(50)]
    monkeypatch.setattr(geometry, "valid", refused)
    monkeypatch.setattr(geometry, "parsed", refused)
    assert geometry.Shapes(pa.array(plain, pa.binary())).valid().all()


@pytest.mark.parametrize("name", ["centroid", "shape_measures"])
def test_measures_come_from_one_pass_over_a_batch(spark, far, name):
    """No expression over nested arrays: those took 0.4 ms a shape."""
    plan = entry.queries()[name](spark, str(far))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "measures" in plan


def test_features_are_reprojected_by_batches(monkeypatch):
    """One call for all points of a batch; the result is each feature's own."""
    calls, own = [], geometry.to_degrees
    monkeypatch.setattr(geometry, "to_degrees", lambda x, y, srid: calls.append(len(x)) or own(x, y, srid))
    rows = [geometry.encode_polygon([[(4e6 + i, 3e6), (4e6 + i + 9, 3e6), (4e6 + i, 3e6 + 9), (4e6 + i, 3e6)]]) for i in range(20)]
    rows += [geometry.encode_multipolygon(rows[:2]), None, b"x"]
    found = geometry.reproject_wkb(3035).func(pa.array(rows, pa.binary())).to_pylist()
    assert calls == [1, 88] and found[21] is None and found[22] is None
    lon, lat = own(np.array([4e6 + 3]), np.array([3e6]), 3035)
    assert geometry.parse_wkb(found[3])[1][0][2][0].tolist() == [lon[0], lat[0]] and geometry.parse_wkb(found[20])[0] == "MULTIPOLYGON"


@pytest.mark.parametrize("whole", [0, 1536])
def test_union_of_many_features(spark, monkeypatch, whole):
    """Many shapes with holes and overlapping neighbours: closed in blocks of cells, or as small groups, to the same polygons."""
    monkeypatch.setattr(overlay, "WHOLE_POINTS", whole)
    ell = fixtures.SHAPES[1][0]
    at = lambda x, y: bytearray(geometry.encode_polygon([[(10 + x * 1e-3 + dx * 1e-4, 52 + y * 1e-3 + dy * 1e-4) for dx, dy in ring] for ring in ell]))
    rows = [(str(k), at(x, y)) for k in range(3) for x in range(40) for y in range(3 * k, 3 * k + 2)]
    rows += [("row", bytearray(geometry.encode_polygon([[(10 + x * 1e-3, 52), (10 + x * 1e-3 + 2e-3, 52), (10 + x * 1e-3 + 2e-3, 52.0005), (10 + x * 1e-3, 52.0005), (10 + x * 1e-3, 52)]]))) for x in range(60)]
    found = {r.name: geometry.parse_wkb(bytes(r.geom_wkb))[1] for r in overlay.union(spark.createDataFrame(rows, "name string, geom_wkb binary"), "name").collect()}
    assert {g: (sum(not h for _, h, _ in r), sum(h for _, h, _ in r)) for g, r in found.items()} == {"0": (80, 80), "1": (80, 80), "2": (80, 80), "row": (1, 0)}
    assert all(geometry.valid(r) for r in found.values())


def test_cells_leave_room_for_each_feature(spark, monkeypatch):
    """More features than the bound of cells don't end in one cell for all of them."""
    levels, own = [], overlay.grid_level
    monkeypatch.setattr(overlay, "MOST_CELLS", 10)
    monkeypatch.setattr(overlay, "WHOLE_POINTS", 0)
    monkeypatch.setattr(overlay, "grid_level", lambda *a: levels.append(own(*a)) or levels[-1])
    rows = [(bytearray(geometry.encode_polygon([[(x, y), (x + 0.5, y), (x, y + 0.5), (x, y)]])),) for x in range(20) for y in range(20)]
    assert len(geometry.parse_wkb(bytes(overlay.union(spark.createDataFrame(rows, "geom_wkb binary")).first().geom_wkb))[1]) == 400
    assert levels[0] > 0 or own(spark.createDataFrame(rows, "geom_wkb binary"), 600) == 0


def test_holes_meet_the_shells_around_them_only(monkeypatch):
    tried, own = [], overlay.inside_ring
    monkeypatch.setattr(overlay, "inside_ring", lambda ring, pts: tried.append(1) or own(ring, pts))
    square = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)
    rings = [square(0, 0, 1000), square(1, 1, 998)[::-1]]
    rings += [r for x in range(40) for y in range(20) for r in (square(10 + 10 * x, 10 + 10 * y, 8), square(11 + 10 * x, 11 + 10 * y, 6)[::-1])]
    polygons, loose = overlay._assembled(rings)
    assert len(polygons) == 801 and not loose and all(len(p) == 2 for p in polygons) and len(tried) < 1000


def test_tile_files_are_written_at_once(spark, tmp_path, monkeypatch):
    """Two writes and a table, however many tiles there are."""
    spark.createDataFrame([(i, i % 50 + 1) for i in range(0, 400_000, 997)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    writes, own = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: writes.append(path) or own(self, path, *a, **k))
    found, want = compared(spark, "tile_files", tmp_path)
    assert found == want and found and len(writes) == 3


def test_empty_coarse_joins_are_left_out_and_hot_tiles_are_split(spark, monkeypatch):
    box = lambda s, rows: spark.createDataFrame(rows, f"{s} int, {s}_xmin double, {s}_ymin double, {s}_xmax double, {s}_ymax double")
    points = [(i, x := 10 + i % 13 * 1e-4, y := 52 + i % 7 * 1e-4, x, y) for i in range(300)]
    shapes = [(i, 10 + i * 1e-4, 51.9, 10 + i * 1e-4 + 2e-4, 52.0003) for i in range(10)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    one = joins.overlap_join(box("l", points), box("r", shapes), left_fits=True)
    assert "Union" not in plan(one)
    want = sorted((p[0], s[0]) for p in points for s in shapes if s[1] <= p[1] <= s[3] and s[2] <= p[2] <= s[4])
    monkeypatch.setattr(joins.by_tile, "__defaults__", (None, 20))
    parts = joins.overlap_join(box("l", points), box("r", shapes), left_fits=True)
    assert "part" in plan(parts) and sorted(map(tuple, one.select("l", "r").collect())) == want == sorted(map(tuple, parts.select("l", "r").collect()))


@pytest.mark.parametrize("name", ["nearest_far", "nearest_far_stored", "shape_contains", "shape_distance"])
def test_shared_coordinates_are_searched_once(spark, tmp_path, monkeypatch, name):
    """Events whose numbers differ by 4,200,000 share their coordinates."""
    spark.createDataFrame([(i, i % 50 + 1) for i in range(2000)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i + 4_200_000 * k,) for i in range(40) for k in range(3)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    sizes = []
    for module in (matching, queries_shapes):
        own = module.materialised
        monkeypatch.setattr(module, "materialised", lambda df, label="rows", own=own: (sizes.append((label, (back := own(df, label)).count())), back)[1])
    found, want = compared(spark, name, tmp_path)
    assert found == want and found and all(n <= 40 for label, n in sizes if label == "places") and sizes


def test_heights_patterns_are_searched_once(spark, far):
    """Patterns inlined into every choice made code that was too large to be compiled."""
    plan = queries.clean(spark, str(far))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 4


def test_small_lookup_has_few_buckets(spark):
    """A stored lookup's buckets grow with its buildings, not with the session's shuffles alone: each region has a file of each."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        lookup = store_lookup(buildings(spark, [(10 + i * 1e-2, 52.0, 10 + i * 1e-2 + 4e-4, 52.0005) for i in range(50)]), f"few_{uuid.uuid4().hex}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {lookup.table}").collect()}
    assert int(told["Num Buckets"]) == 3 * spark.sparkContext.defaultParallelism and lookup.buildings().count() == 50


def test_each_coordinate_is_answered_once(spark, tmp_path):
    """Responses are made and read before they are attached to the points that share a coordinate; rows are the SQL's."""
    spark.createDataFrame([(i, i % 50 + 1) for i in range(300)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i + 420_000 * k,) for i in range(120) for k in range(3)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    found, want = compared(spark, "point_responses", tmp_path)
    assert found == want and len(found) == 360
    assert "to_json" not in entry.queries()["point_responses"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_shape_facts_run_once_where_rows_are_dealt(spark, tmp_path):
    """A filter on the facts was moved below the dealing of rows to cores: they were found twice, first in the few tasks that read the file."""
    spark.createDataFrame([(i, i % 50 + 1) for i in range(100)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = queries.clean(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("facts(") == 1 and plan.index("facts(") < plan.index("Repartition")


def test_null_shapes_are_no_buildings(spark, far):
    raw = fixtures.raw_footprints(spark, str(far)).withColumn("geometry", F.when(F.col("id") % 2 == 0, F.col("geometry")))
    found = build_country(raw, None, BuildConfig(fixtures.WORLD)).select("building_id").collect()
    want = queries.clean(spark, str(far)).where("building_id % 2 = 0").count()
    assert want == len(found) > 0 and all(int(r.building_id) % 2 == 0 for r in found)


def test_coordinates_are_parsed_once(spark, monkeypatch):
    """A filter on validity before the grouping parsed each text three times."""
    plans, own = [], matching.materialised
    monkeypatch.setattr(matching, "materialised", lambda df, label="rows": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, label))
    rows = spark.createDataFrame([(1, "10.5", "52"), (2, "10.50", " 52.0"), (3, "abc", "52"), (4, "200.5", "52"), (5, None, None), (6, "-180", "90"), (7, "0", "-0.0"), (8, "0", "0")], "k int, lon string, lat string")
    found = matching.with_places(matching.with_points(rows, "lat", "lon", "k"))
    assert sorted((r["__lon"], r["__lat"]) for r in found.collect()) == [(-180.0, 90.0), (0.0, 0.0), (10.5, 52.0)]
    assert plans[0].count("RLIKE") == 2


def test_stored_lookup_is_sorted_once(spark, monkeypatch):
    """Its writer sorts each bucket's rows by tile: sorting them by another order before moved all columns twice."""
    plans, own = [], DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, name, *a, **k: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or own(self, name, *a, **k))
    lookup = store_lookup(buildings(spark, [(10 + i * 37 % 101 * 1e-2, 52.0, 10 + i * 37 % 101 * 1e-2 + 4e-4, 52.0005) for i in range(101)]), f"sorted_{uuid.uuid4().hex}", buckets=3)
    assert len(plans) == 2 and not any("Sort" in p for p in plans)
    files = spark.table(lookup.table).inputFiles()
    tiles = [[(r.tx, r.ty) for r in spark.read.parquet(f).select("tx", "ty").coalesce(1).collect()] for f in files]
    assert sum(map(len, tiles)) >= 101 and len(files) > 2 and all(t == sorted(t) for t in tiles)

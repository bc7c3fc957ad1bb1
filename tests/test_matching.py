import math
import random

import pytest
from pyspark.sql import functions as F

from terrafoot.fixtures import rectangle
from terrafoot.operators.joins import clip, overlap_join
from terrafoot.functions.crs import azimuthal
from terrafoot.operators.matching import candidate_centroids, enrich, lookup_points, match, with_places, with_points
from terrafoot.operators.profile import DISTRIBUTIONS, distribution, match_summary, profile_sets, profile_summary, write_profile
from terrafoot.plans.country import BuildConfig, build_country, run_country
from terrafoot.plans.lookup import prepare_lookup
from terrafoot.sources.footprints import write_clean

RAW = "id long, xmin double, ymin double, xmax double, ymax double, height string, occupancy string, floorspace string"


def raw(spark, rows):
    df = spark.createDataFrame([(i, *b, "H:2", "RES1", None) for i, b in rows], RAW)
    return df.select("id", "height", "occupancy", "floorspace", F.lit("OSM").alias("source"), F.lit("120210").alias("quadkey"), F.lit(None).cast("timestamp").alias("last_update"), rectangle("xmin", "ymin", "xmax", "ymax").alias("geometry"), F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox"))


@pytest.fixture(scope="module")
def lookup(spark, tmp_path_factory):
    rows = [(1, (10.0, 52.0, 10.01, 52.01)), (2, (10.002, 52.002, 10.003, 52.003)), (3, (10.02, 52.0, 10.03, 52.01)), (4, (20.0, 52.0, 20.001, 52.001))]
    clean = run_country(raw(spark, rows), None, BuildConfig((9.0, 51.0, 11.0, 53.0)), str(tmp_path_factory.mktemp("out") / "clean"), str(tmp_path_factory.mktemp("profile")))
    assert profile_summary(clean).first()["total_buildings"] == 3
    return prepare_lookup(clean).cache()


@pytest.mark.parametrize("most_tiles", [4, 256])
def test_overlap_join_is_brute_force(spark, most_tiles):
    pick = random.Random(1)

    def boxes(n):
        return [(i, *(lambda x, y, w, h: (x, y, x + w, y + h))(pick.uniform(9, 9.2), pick.uniform(50, 50.1), pick.choice([0, 0.001, 0.05]), pick.uniform(0, 0.01))) for i in range(n)]

    a, b = boxes(150), boxes(150)
    left, right = (spark.createDataFrame(rows, f"{s} int, {s}_xmin double, {s}_ymin double, {s}_xmax double, {s}_ymax double") for s, rows in (("l", a), ("r", b)))
    found = [tuple(r) for r in overlap_join(left, right, most_tiles=most_tiles).select("l", "r").collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(found) == len(set(found)) and set(found) == want


def test_enrich(spark, lookup):
    rows = [(1, "10.0025", "52.0025", "a"), (2, "10.005", "52.005", None), (3, "10.0305", "52.005", "c"), (4, "abc", "52", "d"), (5, "10.5", "52.5", "e"), (6, "10.03", "52.01", "f"), (6, "10.03", "52.01", "f")]
    exposure = spark.createDataFrame(rows, "k int, lon string, lat string, building_source string")
    out = enrich(exposure, lookup, radius=100.0)
    found = sorted((r.k, r.coordinate_valid, r.building_match_type, r.building_building_id, r.building_confidence) for r in out.collect())
    assert found == [(1, True, "inside_polygon", "2", "high"), (2, True, "inside_polygon", "1", "high"), (3, True, "nearest_polygon", "3", "low"), (4, False, "none", None, "none"), (5, True, "none", None, "none"), (6, True, "inside_polygon", "3", "high"), (6, True, "inside_polygon", "3", "high")]
    assert len(out.columns) == len(set(out.columns)) == 3 + 4 + 27
    assert tuple(match_summary(out).first())[:5] == (7, 6, 4, 1, 2)
    gated = enrich(exposure.where("k = 3"), lookup, radius=40.0, candidates="centroid").first()
    assert gated.building_match_type == "none" and enrich(exposure.where("k = 3"), lookup, radius=40.0).first().building_match_type == "nearest_polygon"
    assert enrich(exposure.limit(0), lookup).count() == 0
    with pytest.raises(ValueError):
        enrich(exposure, lookup, lat="nowhere")
    points = lookup_points(exposure, lookup, radius=500.0)
    found = sorted((r.k, r.coordinate_valid, r.match_type, r.confidence, r.building and r.building.building_id) for r in points.collect())
    assert found == [(1, True, "inside_polygon", "high", "2"), (2, True, "inside_polygon", "high", "1"), (3, True, "nearest", "low", "3"), (4, False, "none", "none", None), (5, True, "none", "none", None), (6, True, "inside_polygon", "high", "3"), (6, True, "inside_polygon", "high", "3")]


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_clip(spark, most_bytes):
    rows = raw(spark, [(i, (10 + i / 100, 52.0, 10 + i / 100 + 0.004, 52.004)) for i in range(40)]).select("id", F.col("geometry").alias("geom_wkb"), *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    area = spark.createDataFrame([(1, 10.1, 51.0, 10.203, 53.0), (2, 10.15, 51.0, 10.25, 53.0)], "feature_id long, xmin double, ymin double, xmax double, ymax double")
    area = area.select("feature_id", rectangle("xmin", "ymin", "xmax", "ymax").alias("geom_wkb"))
    assert sorted(r.id for r in clip(rows, area, most_bytes=most_bytes).collect()) == list(range(10, 26))


def test_top_500_candidates(spark):
    """600 centroids around one point: the 500 nearest are candidates, and a polygon beyond them isn't found."""
    rows = [(i, (10.0 + 1e-6 * i, 52.0, 10.0 + 1e-6 * i + 2e-7, 52.0 + 2e-7)) for i in range(1, 601)]
    rows += [(1000, (10.0, 52.0005, 10.0001, 52.0017))]  # its wall is 34 m away, its centroid farther than 600 others
    buildings = prepare_lookup(build_country(raw(spark, rows), None, BuildConfig((9.0, 51.0, 11.0, 53.0)))).cache()
    points = with_points(spark.createDataFrame([(1, "9.9999", "52.0")], "k int, lon string, lat string"), "lat", "lon", "k")
    places = with_places(points)
    found = candidate_centroids(places, buildings, 60.0).collect()
    assert len(found) == 500 and {r.building_id for r in found} == {str(i) for i in range(1, 501)} and sorted(r["rank"] for r in found) == list(range(1, 501))
    far = points.withColumn("__lat", F.lit(52.0003)).withColumn("__lon", F.lit(10.0))
    by_window = match(far, buildings, "inside_nearest", 60.0).first()
    by_centroid = match(far, buildings, "inside_nearest", 60.0, candidates="centroid").first()
    assert by_window.building_id == "1000" and by_centroid.building_id == "1"


def test_each_coordinate_is_matched_once(spark, lookup):
    """Many rows on one coordinate, -0.0 and 0.0, and rows in the order of the input."""
    rows = [(i, "10.0025", "52.0025") for i in range(500)] + [(500, "-0.0", "0"), (501, "0.0", "-0")]
    exposure = spark.createDataFrame(rows, "k int, lon string, lat string")
    assert with_places(with_points(exposure, "lat", "lon", "k")).count() == 2
    out = enrich(exposure, lookup, key="k", ordered=True).collect()
    assert [r.k for r in out] == list(range(502)) and all(r.building_building_id == "2" for r in out[:500]) and all(r.building_match_type == "none" for r in out[500:])


def test_local_metric(spark):
    """Far from Europe the local metric finds what the default grid places too far away."""
    rows = [(1, (-76.801, 18.0, -76.8008, 18.0002))]
    clean = build_country(raw(spark, rows), None, BuildConfig((-78.5, 17.6, -76.0, 18.7))).cache()
    exposure = spark.createDataFrame([(1, "-76.80035", "18.00065")], "k int, lon string, lat string")
    metric = azimuthal(-76.8, 18.0)
    true = 1000 * math.dist((0.45 * 111.19 * math.cos(math.radians(18)) / 1000 * 1000, 0.45 * 111.19), (0, 0)) / 1000
    near = enrich(exposure, prepare_lookup(clean, metric), radius=80.0, key="k", metric=metric).first()
    assert near.building_match_type == "nearest_polygon" and abs(near.building_distance_m - true) < 0.5
    grid = enrich(exposure, prepare_lookup(clean), radius=80.0, key="k").first()
    assert grid.building_distance_m is None or abs(grid.building_distance_m - true) > 5


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    rows, out = spark.range(2500), f"{tmp_path}/clean"
    write_clean(rows, out, rows_per_file=1000)
    with pytest.raises(Exception, match="already exists"):
        write_clean(rows, out)
    write_clean(rows.limit(3), out, force=True)
    assert spark.read.parquet(out).count() == 3


def test_distribution_order(spark):
    df = spark.createDataFrame([(x,) for x in "bbbaacc"] + [(None,)], "k string")
    assert [(r.k, r.building_count) for r in distribution(df, "k").collect()] == [("b", 3), ("a", 2), ("c", 2), (None, 1)]


def test_profile_reads_the_table_once(spark, tmp_path):
    """Summary and distributions are those of their own functions, null values and empty tables too, and the plan has one scan."""
    rows = [(float(i), [None, "Unknown", "Mixed"][i % 3], [None, 3.0][i % 2], 1.0, 0.5, "exact_height_m", ["a", "b", None, "a"][i % 4]) for i in range(50)]
    schema = "footprint_area_m2 double, occupancy_group string, height_m double, floorspace_est_m2 double, attribute_completeness_score double, height_source_type string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/clean")
    whole = spark.read.parquet(f"{tmp_path}/clean")
    for clean in (whole, whole.limit(0)):
        write_profile(clean, f"{tmp_path}/p")
        want = profile_summary(clean).first().asDict()
        found = spark.read.json(f"{tmp_path}/p/summary").first().asDict()
        assert {k: v for k, v in want.items() if v is not None} == pytest.approx(found)
        for name, key in DISTRIBUTIONS.items():
            want = [(r[key], r.building_count, pytest.approx(r.share)) for r in distribution(clean, key).collect()]
            schema = f"{key} string, building_count long, share double"
            assert [tuple(r) for r in spark.read.option("header", True).schema(schema).csv(f"{tmp_path}/p/{name}_distribution").collect()] == want
    plan = profile_sets(whole)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1

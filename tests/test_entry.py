import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from terrafoot import queries_shapes, queries_sources

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")
OWN = ["coordinate_validation", "height_parse", "occupancy_classify", "floorspace_estimate", "completeness_score", "boundary_clip", "quadkey_encode", "tile_cover", "footprint_area", "occupancy_distribution", "geocode_flatten", "csv_round_trip", "match_summary", "stored_match", "nearest_far_stored", "nearest_far_centroid", "stream_summary", "point_responses", *queries_shapes.QUERIES, *queries_sources.QUERIES]


def compared(spark, name):
    """Sorted rows of the query and of its SQL over the smallest tables, with columns by name."""
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    return sorted(map(plain, map(tuple, df.select(*columns).collect())), key=repr), sorted(map(plain, want), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, name):
    found, want = compared(spark, name)
    assert found == want and found


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "terrafoot", tmp_path / "terrafoot", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'inside_match' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
    (tmp_path / "corpus_pipeline.py").write_text("import nowhere_to_be_found")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env=os.environ | {"PYTHONPATH": ""})
    assert broken.returncode and b"nowhere_to_be_found" in broken.stderr  # a fault of the corpus part isn't swallowed

"""Rejected lines, line numbers and the listing of source files."""

import time

from terrafoot.sources.exposures import numbered_lines, read_exposures_checked
from terrafoot.sources.footprints import existing


def test_every_line_is_accepted_or_rejected(spark, tmp_path):
    good = ["1,10.5,a", '2,11.5,"b,c"', "3,,", '4,1.25,"say ""x"""']
    bad = ["5,1.5", "6,2.5,x,y", "7"]
    (tmp_path / "a.csv").write_text("\n".join(["id,lon,name", good[0], bad[0], "", good[1], bad[1], "   "]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(["id,lon,name", bad[2], good[2], good[3]]))
    accepted, rejected = read_exposures_checked(spark, str(tmp_path))
    assert accepted.dtypes == [("id", "int"), ("lon", "double"), ("name", "string")]
    assert sorted(map(tuple, accepted.collect()), key=repr) == [(1, 10.5, "a"), (2, 11.5, "b,c"), (3, None, None), (4, 1.25, 'say "x"')]
    assert sorted((r.file.rpartition("/")[2], r.line_number, r.line) for r in rejected.collect()) == [("a.csv", 3, bad[0]), ("a.csv", 6, bad[1]), ("b.csv", 2, bad[2])]


def test_values_of_another_type_are_rejected(spark, tmp_path):
    """Types come from a share of the rows, so later rows may not fit them."""
    lines = ["id,lon"] + [f"{i},{i}.5" for i in range(2000)]
    lines[1500] = "x1499,1.5"
    (tmp_path / "a.csv").write_text("\n".join(lines))
    for ratio in (0.01, 1.0):
        accepted, rejected = read_exposures_checked(spark, str(tmp_path), ratio)
        found = [(r.line_number, r.line) for r in rejected.collect()]
        assert accepted.count() + len(found) == 2000 and found == ([(1501, "x1499,1.5")] if accepted.dtypes[0][1] == "int" else [])


def test_line_numbers_of_split_files(spark, tmp_path):
    names = {}
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 500)):
        names[name] = [f"{name} {i} {'x' * (i % 50)}" for i in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(names[name]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3501 and all(names[r.file.rpartition("/")[2]][r.line_number - 1] == r.line for r in rows)


def test_files_are_found_by_one_listing(spark, tmp_path):
    for i in range(5000):
        (tmp_path / f"{i}.parquet").touch()
    asked = [f"{tmp_path}/{i}.parquet" for i in range(10_000)]
    began = time.time()
    assert existing(spark, [*asked, "/nowhere/at/all.parquet", f"{tmp_path}/*.parquet"]) == [*asked[:5000], f"{tmp_path}/*.parquet"]
    assert existing(spark, [f"file://{tmp_path}/7.parquet", f"file://{tmp_path}/x.parquet"]) == [f"file://{tmp_path}/7.parquet"]
    assert time.time() - began < 10

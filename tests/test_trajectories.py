"""Trajectory scans: only the frames and atoms asked for, from text and from blocks."""

import pytest
from pyspark.sql import functions as F
from strandline.sources import trajectories as tr

ATOMS = [(1, "N", "ALA", 1), (2, "CA", "ALA", 1), (3, "HA", "ALA", 1), (4, "CB", "ALA", 1), (5, "O", "HOH", 2)]


def frames(spark, n):
    rows = [(f, *a, float(f), a[0] / 8, -234.5, 0.25) for f in range(n) for a in ATOMS]
    return spark.createDataFrame(rows, "frame long, serial long, name string, residue string, resid int, x double, y double, z double, b double")


@pytest.fixture(scope="module")
def pdb(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pdb") / "run")
    tr.write_pdb(frames(spark, 30), at)
    return at


@pytest.mark.parametrize(("asked", "want"), [({}, range(30)), ({"first": 3, "last": 20, "stride": 5}, range(3, 21, 5)), ({"stride": 7}, range(0, 30, 7)), ({"last": 0}, [0])])
def test_frames_of_text(spark, pdb, asked, want):
    rows = tr.read_pdb(spark, pdb, **asked).collect()
    assert sorted({r["frame"] for r in rows}) == list(want) and len(rows) == 5 * len(list(want))
    r = next(r for r in rows if r["serial"] == 4)
    assert (r["name"], r["residue"], r["resid"], r["x"], r["y"], r["z"], r["b"]) == ("CB", "ALA", 1, float(r["frame"]), 0.5, -234.5, 0.25)


@pytest.mark.parametrize(("select", "want"), [("alpha", "2"), ("backbone", "125"), ("minimal", "1245"), ("heavy", "1245"), ("protein", "1234"), (["HA"], "3"), (None, "12345")])
def test_selections(spark, pdb, select, want):
    got = {r["serial"] for r in tr.read_pdb(spark, pdb, last=0, select=select).collect()}
    assert got == set(map(int, want))


def test_blocks_that_are_not_asked_for_are_not_read(spark, tmp_path):
    at = f"{tmp_path}/blocks"
    tr.write_blocks(frames(spark, 60).withColumn("file", F.lit("a")), at, 10)
    scan = tr.scan_blocks(spark, at, 25, 31, 3, "alpha", 10)
    assert sorted((r["frame"], r["serial"]) for r in scan.collect()) == [(25, 2), (28, 2), (31, 2)]
    plan = spark._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "formatted")
    filters = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert ">= 2" in filters and "<= 3" in filters and "GreaterThanOrEqual(frame,25)" in plan and "EqualTo(name,CA)" in plan
    assert scan.select(F.input_file_name().alias("f")).distinct().count() == 2


def test_text_without_models_and_bad_arguments(spark, tmp_path):
    (tmp_path / "x.pdb").write_text("REMARK none\nMODEL        1\nATOM   junk\nENDMDL\nEND\n")
    rows = tr.read_pdb(spark, f"{tmp_path}/x.pdb").collect()
    assert [(r["frame"], r["x"]) for r in rows] == [(1, None)]
    with pytest.raises(ValueError):
        tr.read_pdb(spark, f"{tmp_path}/x.pdb", stride=0)
    with pytest.raises(ValueError):
        tr.read_pdb(spark, f"{tmp_path}/x.pdb", select="beta")

"""The jobs against their SQL, over growing input, and by their command line."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import combined_export, delivered_spots, queries
from jobs.common import settings

TABLES = ("part", "lineitem")


def _rows(df, columns=None):
    return sorted(map(repr, map(tuple, df.select(*(columns or sorted(df.columns))).collect())))


@pytest.mark.parametrize("name", ["job1_delivered_spots", "job2_combined_export"])
def test_sql(spark, sf_dir, name):
    query, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    got = _rows(query(spark, sf_dir), columns)
    assert got == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())) and got


@pytest.fixture(scope="module")
def pieces(spark, sf_dir):
    """The samples in three parts that cut acquisitions and spots anywhere."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return [lines.filter(F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(3)) == i) for i in range(3)]


def _spots(spark, out):
    return _rows(spark.read.parquet(f"{out}/spots").select("acq_id", "spot_id", "layer", "n_rows", "tier", *[F.round(c, 6) for c in ("a", "b", "sigma_a", "sigma_b", "weight", "distance")]))


def test_growing_samples(spark, sf_dir, pieces, tmp_path):
    plan, inbox = f"{sf_dir}/part.parquet", f"{tmp_path}/inbox"
    one = lambda: delivered_spots.run(spark, inbox, plan, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    sizes = [p.count() for p in pieces]
    pieces[0].write.parquet(inbox)
    assert one() == sizes[0] and one() == 0
    early = _spots(spark, f"{tmp_path}/out")
    pieces[1].write.mode("append").parquet(inbox)
    pieces[2].write.mode("append").parquet(inbox)
    assert one() == sizes[1] + sizes[2] and one() == 0
    grown = _spots(spark, f"{tmp_path}/out")
    assert grown != early and len(grown) == len(early)  # every spot of the plan, measured or missing
    delivered_spots.run(spark, f"{sf_dir}/lineitem.parquet", plan, f"{tmp_path}/all", f"{tmp_path}/all-checkpoint")
    assert grown == _spots(spark, f"{tmp_path}/all")
    delivered_spots.run(spark, inbox, plan, f"{tmp_path}/slow", f"{tmp_path}/slow-checkpoint", delivered_spots.Settings(files_at_once=1))
    assert grown == _spots(spark, f"{tmp_path}/slow")


def test_only_new_groups_are_written(spark, sf_dir, pieces, tmp_path):
    plan, inbox, out = f"{tmp_path}/part.parquet", f"{tmp_path}/inbox", f"{tmp_path}/out"
    part, lines = spark.read.parquet(f"{sf_dir}/part.parquet"), pieces[0]
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 500)).write.parquet(plan)  # a second acquisition
    s = delivered_spots.Settings(groups=64)
    run = lambda: delivered_spots.run(spark, inbox, plan, out, f"{tmp_path}/checkpoint", s)
    times = lambda: {(f.parent.name, f.name) for f in Path(f"{out}/spots").rglob("part-*.parquet")}
    lines.write.parquet(inbox)
    run()
    first = times()
    lines.withColumn("l_partkey", F.col("l_partkey") + 500).write.mode("append").parquet(inbox)
    run()
    assert first < times()  # the files of the first acquisition are still the same
    assert {r["acq_id"] for r in spark.read.parquet(f"{out}/spots").select("acq_id").distinct().collect()} == {0, 1}


def test_a_batch_run_again_changes_nothing(spark, sf_dir, pieces, tmp_path):
    """As after a failure between the writes and the checkpoint: the last batch's commit is lost."""
    plan, inbox, out = f"{sf_dir}/part.parquet", f"{tmp_path}/inbox", f"{tmp_path}/out"
    run = lambda: delivered_spots.run(spark, inbox, plan, out, f"{tmp_path}/checkpoint")
    pieces[0].write.parquet(inbox)
    run()
    pieces[1].write.mode("append").parquet(inbox)
    run()
    want = _spots(spark, out)
    for f in Path(f"{tmp_path}/checkpoint/commits").glob("*1*"):
        f.unlink()
    run()
    assert _spots(spark, out) == want


def test_samples_that_do_not_count(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.filter("l_linenumber >= 6").write.parquet(f"{tmp_path}/inbox")  # one axis is missing in each
    assert delivered_spots.run(spark, f"{tmp_path}/inbox", f"{sf_dir}/part.parquet", f"{tmp_path}/out", f"{tmp_path}/checkpoint") > 0
    with pytest.raises(ValueError):
        delivered_spots.Settings(pass_mm=3.0, warn_mm=2.0)


def test_export_of_a_range_leaves_the_rest(spark, sf_dir, tmp_path):
    part, lines, out = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet"), f"{tmp_path}/out"
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 500)).write.parquet(f"{tmp_path}/part")
    lines.unionByName(lines.withColumn("l_partkey", F.col("l_partkey") + 500)).write.parquet(f"{tmp_path}/lines")
    n = combined_export.run(spark, f"{tmp_path}/lines", f"{tmp_path}/part", out)
    export = lambda: spark.read.option("header", True).csv(f"{out}/export")
    assert n == export().count() and export().select("acq_id").distinct().count() == 2
    before, files = _rows(export()), {f.name for f in Path(f"{out}/export/acq_id=0").glob("part-*")}
    assert combined_export.run(spark, f"{tmp_path}/lines", f"{tmp_path}/part", out, combined_export.Settings(first=1, last=1)) == n // 2
    assert _rows(export()) == before and {f.name for f in Path(f"{out}/export/acq_id=0").glob("part-*")} == files
    for r in spark.read.parquet(f"{out}/summary").collect():
        assert r["n_planned"] == 200 and r["n_spots"] == r["n_pass"] + r["n_warn"] + r["n_fail"] == n // 2


def test_settings(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"groups": 3}))
    assert settings(spark, f"file://{tmp_path}/good.json", delivered_spots.Settings).groups == 3
    (tmp_path / "bad.json").write_text(json.dumps({"group": 3}))
    with pytest.raises(ValueError, match="group"):
        settings(spark, f"file://{tmp_path}/bad.json", delivered_spots.Settings)


def test_command_line(spark, sf_dir, tmp_path):
    root = Path(delivered_spots.__file__).parents[1]
    args = ["--samples", f"{sf_dir}/lineitem.parquet", "--plan", f"{sf_dir}/part.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"]
    done = subprocess.run([sys.executable, "-m", "jobs.delivered_spots", *args], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new samples" in done.stderr and "wrote" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/spots").count() >= 200

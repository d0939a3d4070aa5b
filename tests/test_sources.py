import gzip
import sys

import pytest
from pyspark.sql import functions as F

from beamloom import config, constants as K
from beamloom.functions import rows as R
from beamloom.sources import acquisition, export, names, partitions, plans

HEADER = "time (s),IX512 Channel Sum (nA),Fit Amplitude A (nA),Fit Amplitude B (nA),Fit Mean Position A (mm),Fit Mean Position B (mm),Gate Counter"
LINES = ["0.0,1.0,0.5,,0,0,1", "0.05,1.0,0.5,,5,0,1", "0.2,,,,,,2", "0.5,1.0,0.5,,0,bad,3.7"]


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "15186535_T0G12_100kHz_run.csv"
    path.write_text("﻿" + "\n".join([HEADER, *LINES]) + "\n", encoding="utf-8")
    return str(path)


def test_acquisition(spark, csv_file, tmp_path):
    rows = acquisition.read_acquisition(spark, csv_file).orderBy("row_idx").collect()
    assert [r["t"] for r in rows] == [0.0, 0.05, 0.2, 0.5] and rows[0]["a"] == 0.0 and rows[3]["b"] is None
    assert [r["gate"] for r in rows] == [1, 1, 2, 3] and rows[2]["fit_a"] is None
    packed = tmp_path / "x.csv.gz"
    packed.write_bytes(gzip.compress(open(csv_file, "rb").read()))
    again = acquisition.read_acquisition(spark, str(packed), acq_id=rows[0]["acq_id"]).orderBy("row_idx").collect()
    assert again == rows
    assert acquisition.has_gate_counter(acquisition.read_text(spark, csv_file).columns)
    with pytest.raises(ValueError):
        acquisition.read_text(spark, "plan.txt")
    with pytest.raises(Exception, match="(?i)cast|malformed|invalid"):
        acquisition.read_acquisition(spark, csv_file, strict=True).collect()
    df = acquisition.read_acquisition(spark, csv_file)
    assert acquisition.signal_rows(df).count() == 3 and acquisition.signal_rows(df, with_dead=True).count() == 4


def test_columns():
    acquisition.check_columns([])
    acquisition.check_columns(HEADER.split(","), "fit_amplitude_b", auto=True)
    with pytest.raises(ValueError, match="Fit Amplitude B"):
        acquisition.check_columns([c for c in HEADER.split(",") if c != K.FIT_AMPLITUDE_B], "fit_amplitude_b")


def test_names(spark):
    assert names.acquisition_stem("/a/b/x.y.CSV.GZ") == "x.y" and names.acquisition_stem("x.csv") == "x"
    assert names.plan_tag("15186535_T0G10_50kHz_2024") == "T0G10_50kHz" and names.plan_label("15186535_t0g10_50kHz_2024") == "T0G10"
    assert names.plan_tag("other") is None and names.csv_plan_label("P7_cube_v2") == "P7"
    assert names.default_export_name("/d/run.csv", True) == "run-spots-agg.csv"
    files = spark.createDataFrame([("a.csv", "15186535_T0G10_50kHz_x"), ("b.csv", "none")], "path string, stem string")
    found = spark.createDataFrame([("q.dcm", "T0G10"), ("p.dcm", "T0G10")], "path string, label string")
    assert {r["path"]: r["plan_path"] for r in names.match_plans(files, found).collect()} == {"a.csv": "p.dcm", "b.csv": None}


def test_csv_plan(spark, tmp_path):
    path = tmp_path / "P1_cube.csv"
    path.write_text("#NO,ENERGY(MeV),X_POSITION(mm),Y_POSITION(mm),CHARGE_REQ(MU),BEAM_SIZE(mm)\n1,100,0,0,1.0,5\n2,100,5,0,0,5\n3,90,5,5,-1,\n4,90,x,5,1,5\n")
    slots = plans.csv_slots(spark, str(path))
    assert plans.slot_counts(slots).collect()[0][1:] == (3, 1)
    plan = plans.read_plan(spark, str(path)).collect()
    assert [(r["spot_idx"], r["energy"], r["mu"], r["fwhm_x"]) for r in plan] == [(0, 100.0, 1.0, 5.0)]
    (tmp_path / "bad.csv").write_text("ENERGY,X_POSITION,Y_POSITION\n100,0,0\n")
    with pytest.raises(plans.PlanError):
        plans.read_plan(spark, str(tmp_path / "bad.csv"))
    assert not plans.is_supported(spark, "plan.txt") and plans.plan_columns("a,b") is None


def test_nested_plan(spark):
    beams = [[(2, 150.0, [0.0, 0.0, 1.0, 2.0, 9.0, 9.0], [1.0, 0.0], [5.0, 6.0]), (3, 140.0, [3.0, 4.0], None, [600.0, 5.0])], []]
    slots = plans.nested_slots(spark.createDataFrame([("p", beams)], plans.NESTED))
    assert plans.slot_counts(slots, True).collect()[0][1:] == (3, 2)
    kept = plans.kept_slots(slots, True).orderBy("spot_idx").collect()
    assert [(r["x"], r["y"], r["energy"], r["mu"], r["fwhm_x"]) for r in kept] == [(0.0, 0.0, 150.0, 1.0, 5.0), (3.0, 4.0, 140.0, None, None)]


def test_row_rules(spark):
    cells = spark.createDataFrame([(" 1.5 ",), ("",), (None,), ("1_0",), ("1.5f",), ("nan",), ("-2e3",)], "c string")
    assert [r[0] for r in cells.select(R.cell("c")).collect()] == [1.5, None, None, 10.0, None, None, -2000.0]
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None), (None, None)], "a double, b double")
    got = R.with_plan_axes(df).collect()
    assert [(r["mx"], r["my"], r["partial"]) for r in got] == [(2.0, 1.0, 0), (2.0, None, 1), (None, 1.0, 2), (None, None, -1)]
    assert R.with_plan_axes(df).filter(R.position_ok()).count() == 1
    assert R.with_plan_axes(df).filter(R.position_ok(heal=True)).count() == 3
    assert R.with_plan_axes(df).filter(R.position_ok(with_dead=True)).count() == 2
    w = spark.createDataFrame([(None, 0.0), (-1.0, 2.0), (3.0, None)], "channel double, fit_a double")
    assert [tuple(r) for r in w.select(R.spot_weight("channel_sum"), R.spot_weight("channel_sum", True), R.spot_weight("fit_amplitude_a"), R.charge(F.col("channel"), F.col("fit_a"))).collect()] == [(1.0, 1.0, 1e-9, 1e-18), (1e-9, 1.0, 2.0, 2.0), (3.0, 3.0, 3.0, 3.0)]


def test_export(spark, tmp_path):
    row = {c: None for c in K.EXPORT_COLUMNS}
    df = spark.createDataFrame([(1, "yes", 0, float("nan"))], "spot_index int, aggregated string, layer_index int, nominal_energy_mev double")
    for c in K.EXPORT_COLUMNS[4:]:
        df = df.withColumn(c, F.lit(row[c]).cast("double"))
    export.write_export(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(K.EXPORT_COLUMNS)
    assert export.write_export_file(df, str(tmp_path / "one.csv"), {"plan": "P"}) == 1
    text = (tmp_path / "one.csv").read_text().splitlines()
    assert text[0] == "# plan: P" and text[2] == "1,yes,0" + "," * 16


def test_config():
    assert config.parse("layer_gap_s", "0.2") == 0.2 and config.parse("layer_gap_s", "0") is None and config.parse("min_episode_rows", "2.5") is None
    assert config.parse("flier_sigma", "20") == 20 and config.parse("flier_sigma", "0.4") is None and config.parse("wet_mm", "x") is None
    assert config.parse_thresholds("1", "3") == (1, 3) and config.parse_thresholds("3", "1") is None
    assert config.weight_mode("Fit-A") == "fit_amplitude_a" and config.saved_weight_mode("what") == "channel_sum"
    assert config.resolved_mode("gate_counter", False, True) == "time_gap" and config.resolved_mode("auto", False, False) == "time_gap" and config.resolved_mode("?", True, True) == "gate_counter"
    assert config.chosen_assignment("plan_sequential") == ("auto", "plan_sequential", True) and config.chosen_mode("time_gap") == "gate_counter"
    bad = config.Config(pass_mm=3, warn_mm=1)
    assert not bad.position_qa and bad.dose_qa


def test_ion_plan_file(spark, monkeypatch):
    """An ion plan through a stand-in for the optional reader: two control points, one slot without weight."""
    from types import SimpleNamespace as Tags

    first = Tags(NumberOfScanSpotPositions=2, NominalBeamEnergy="150.0", ScanSpotPositionMap=[0, 0, 5, 1], ScanSpotMetersetWeights=[1.0, 2.0], ScanningSpotSize=[7.0, 8.0])
    second = Tags(NumberOfScanSpotPositions=2, NominalBeamEnergy=140.0, ScanSpotPositionMap=[1.0, 2.0, 3.0, 4.0], ScanSpotMetersetWeights=[0.0, 3.0])
    data = Tags(RTPlanLabel="P7", IonBeamSequence=[Tags(IonControlPointSequence=[first, second]), Tags(IonControlPointSequence=None)])
    monkeypatch.setitem(sys.modules, "pydicom", Tags(dcmread=lambda path: data))
    got = plans.read_plan(spark, "in/p.dcm").orderBy("spot_idx").collect()
    assert [(r["plan_id"], r["x"], r["y"], r["energy"], r["mu"], r["fwhm_x"]) for r in got] == [("P7", 0, 0, 150, 1, 7), ("P7", 5, 1, 150, 2, 7), ("P7", 3, 4, 140, 3, None)]
    assert plans.is_supported(spark, "in/p.dcm") and plans.label_of(spark, "in/p.dcm") == "P7"
    monkeypatch.setitem(sys.modules, "pydicom", None)
    with pytest.raises(plans.PlanError, match="pydicom"):
        plans.read_plan(spark, "in/p.dcm")


def test_empty_export(spark, tmp_path):
    none = spark.createDataFrame([], ", ".join(f"{c} double" for c in export.K.EXPORT_COLUMNS))
    with pytest.raises(ValueError, match="nothing"):
        export.write_export_file(none, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError, match="nothing"):
        export.write_export(none, str(tmp_path / "y"))
    assert not list(tmp_path.iterdir())


def test_files_in_pieces(spark, tmp_path):
    """Lines keep their numbers where files are read in many pieces, several small files in one, or as one compressed stream."""
    import gzip

    from beamloom.sources import acquisition

    lines = {"run 1+1.csv": 3000, "b.csv": 1, "c.csv": 40, "d.csv.gz": 700, "e.csv": 0}
    (tmp_path / "in").mkdir()
    for name, n in lines.items():
        text = "time (s),Fit Mean Position A (mm)\n" + "".join(f"{i}.5,{i}\n" for i in range(n))
        path = tmp_path / "in" / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = acquisition.read_acquisitions(spark, str(tmp_path / "in"))
            got = sorted((r["acq_id"], r["row_idx"], r["a"]) for r in rows.collect())
            assert got == sorted((name.removesuffix(".gz").removesuffix(".csv"), i, float(i)) for name, n in lines.items() for i in range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_acquisition_of_several_files_is_numbered_by_their_names(spark, tmp_path):
    """The second file is the larger one, which Spark reads first; no window over the acquisition puts rows into one task."""
    folder = tmp_path / "run 9.csv"
    folder.mkdir()
    for name, lines in (("part-0.csv", range(3)), ("part-1.csv", range(3, 400))):
        (folder / name).write_text("\n".join([f"{K.TIME},{K.FIT_AMPLITUDE_A}", *(f"{i},1" for i in lines)]))
    got = acquisition.read_acquisition(spark, str(folder))
    assert got.filter("row_idx = t").count() == 400 and {r[0] for r in got.select("acq_id").distinct().collect()} == {"run 9"}


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows with spaces.parquet")
    spark.range(5000).withColumn("k", F.col("id") % 300).write.parquet(path)
    rows = spark.read.parquet(path)
    assert partitions.partitions(rows) is None and partitions.partitions(spark.range(10)) is None
    monkeypatch.setattr(partitions, "SMALL", 0)
    monkeypatch.setattr(partitions, "EACH", 1000)
    dealt = partitions.spread(rows.filter("id >= 0"), "k")
    assert dealt.rdd.getNumPartitions() > 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.count() == 5000

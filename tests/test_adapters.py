"""Adapters, captions, streaming and the signature test on small inputs."""

import pytest
from pyspark.sql import functions as F

from corvellum.operators import learn
from corvellum.plans import captions
from corvellum.sources import adapters
from corvellum.streaming.incremental import windowed_metrics


def test_wide_with_sheet(spark, tmp_path):
    m, s = tmp_path / "m.txt", tmp_path / "s.txt"
    m.write_text("\tc1\tc2\n\tPre_P1\tPost_P2\ng1\t1\t0\n")
    s.write_text("# x\nSample name\ttitle\tcharacteristics: patient\nSample 1\tc1\tPre_P1_T\nSample 2\tc2\tPost_P2\n")
    got = adapters.ADAPTERS["wide_with_sheet"](spark, str(m), str(s), "Sample name", "Sample", {"id": "title", "patient_timepoint": "patient"})
    assert {(r.unit_id, r.timepoint, r.patient, r.fraction) for r in got["obs"].collect()} == {("c1", "Pre", "P1", "T"), ("c2", "Post", "P2", None)}
    assert got["expr"].count() == 1 and got["malformed"].first().rows == 0


def test_libraries(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"{k}.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3\n2 2 4\n")
    obs = spark.createDataFrame([("u1", "singlet", "d", "c"), ("u2", "doublet", "d", "c"), ("u3", "singlet", "d", "c"), ("u3", "singlet", "d", "c"), ("u4", "singlet", "d", "s")], "unit_id string, state string, donor string, condition string")
    got = adapters.libraries(spark, [(str(tmp_path / "a.mtx"), ["g1", "g2"], ["u1", "u2"]), (str(tmp_path / "b.mtx"), ["g1", "g2"], ["u3", "u4"])], obs, "singlet", 1.0)
    assert {tuple(r) for r in got["expr"].collect()} == {("u1", "g1", 3.0), ("u4", "g2", 4.0)}


def test_plates(spark):
    expr = spark.createDataFrame([("w1", '"A;B"', 100.0), ("w2", "C", 90.0), ("w3", "C", 1.0)], "unit_id string, feature_id string, value double")
    design = spark.createDataFrame([("w1", "x", False), ("w2", "y", False), ("w3", "x", True)], "unit_id string, kind string, empty boolean")
    got = adapters.plates(expr, design, ["x"])
    assert [tuple(r) for r in got["expr"].collect()] == [("w1", "A", 100.0)]
    with pytest.raises(ValueError):
        adapters.plates(expr, design.where("unit_id <> 'w2'"))
    with pytest.raises(ValueError):
        adapters.plates(expr.replace(1.0, 80.0), design)


def test_captions(spark, tmp_path):
    assert captions.qc_caption(10, 8, {"too_few": 2, "any": 2}) == "8 of 10 units were kept (2 by too few)."
    captions.write_captions(str(tmp_path), {"a": captions.cluster_caption(3, 0.5, 0.9)})
    captions.write_captions(str(tmp_path), {"b": captions.calls_caption({"probable": 1, "confident": 2})})
    assert set(captions.read_captions(str(tmp_path))) == {"a", "b"}
    captions.write_table(spark.range(2).select("id", F.array("id").alias("x")), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["id", "x"]


def test_signature(spark):
    rows = [(f"u{u}", int(u >= 4), float(u >= 4) + i / 100) for u in range(8) for i in range(12)]
    got = learn.signature_p(spark.createDataFrame(rows, "unit string, y int, score double")).first()
    assert got.auc == 1.0 and got.p < 0.06 and got.units == 8
    with pytest.raises(ValueError):
        learn.signature_p(spark.createDataFrame([("u", 0, 1.0), ("u", 1, 1.0)], "unit string, y int, score double"))


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = windowed_metrics(spark.readStream.schema(events.select("ts", "event_type", "value").schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("metrics").start()
    query.processAllAvailable()
    query.stop()
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.start, r.event_type, r.n) for r in spark.table("metrics").collect()} == {(r.w.start, r.event_type, r.n) for r in batch.collect()}

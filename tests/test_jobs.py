"""The runnable jobs: whole tables against SQL, growing input, reruns, odd rows, the command line."""

import json
import os
import subprocess
import sys

import pytest

from jobs import common, evidence_manifest, label_screen, registry

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_whole_tables_against_sql(name, spark, sf, duck, same_rows):
    same_rows(registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name]))


def _manifest(spark, folder):
    return {r.evidence_id: r for r in spark.read.parquet(folder).collect()}


def test_manifest_takes_only_what_is_new(spark, tmp_path):
    source, target, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    add = lambda rows: spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(source)
    add([(5, "http://x/counts.mtx", "same"), (7, "http://x/design.txt", "same"), (8, "http://x/run.py", None), (9, None, "other"), (9, None, "other")])
    first = evidence_manifest.run(spark, source, target, mark)
    assert first == {"batches": 1, "rows": 5, "retrieved": 4, "refused": 2, "copies": 1}
    assert evidence_manifest.run(spark, source, target, mark) == {"batches": 0, "rows": 0, "retrieved": 0, "refused": 0, "copies": 0}
    before = {p: os.path.getmtime(os.path.join(d, p)) for d, _, files in os.walk(target) for p in files}
    add([(1, "http://x/a.bam", "same"), (2, "http://x/b", "new"), (3, "http://x/b", "new"), (4, "", "")])
    assert evidence_manifest.run(spark, source, target, mark) == {"batches": 1, "rows": 4, "retrieved": 3, "refused": 0, "copies": 2}
    after = {p: os.path.getmtime(os.path.join(d, p)) for d, _, files in os.walk(target) for p in files}
    assert {p: t for p, t in after.items() if p in before and p.startswith("part-")} == {p: t for p, t in before.items() if p.startswith("part-")}
    got = _manifest(spark, target)
    assert spark.read.parquet(target).count() == 9
    assert {i: r.copy_of for i, r in got.items()} == {5: None, 7: 5, 8: None, 9: None, 1: 5, 2: None, 3: 2, 4: None}
    assert {i: r.role for i, r in got.items()} == {5: "processed_matrix", 7: "sample_metadata", 8: "code", 9: "unknown", 1: "raw_reads", 2: "unknown", 3: "unknown", 4: "unknown"}
    assert got[8].status == got[4].status == "unavailable" and got[8].bytes is None and got[9].rejected and not got[4].rejected


def test_a_batch_that_failed_half_way_is_made_again(spark, tmp_path, monkeypatch):
    source, target, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    spark.createDataFrame([(i, f"http://x/{i}", f"text {i % 3}") for i in range(30)], PAGES).write.parquet(source)
    whole = common.replace_partitions

    def breaks(df, path, *by):
        whole(df.where("evidence_id % 2 = 0"), path, *by)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(common, "replace_partitions", breaks)
    with pytest.raises(Exception, match="executor lost"):
        evidence_manifest.run(spark, source, target, mark)
    monkeypatch.setattr(common, "replace_partitions", whole)
    evidence_manifest.run(spark, source, target, mark)
    got = _manifest(spark, target)
    assert len(got) == spark.read.parquet(target).count() == 30
    assert [got[i].copy_of for i in range(5)] == [None, None, None, 0, 1]


def test_batches_of_few_files_end_alike(spark, tmp_path):
    source = f"{tmp_path}/in"
    for i in range(3):
        spark.createDataFrame([(i, "http://x", "same"), (10 + i, "http://x", f"own {i}")], PAGES).coalesce(1).write.mode("append").parquet(source)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"files_per_batch": 1}))
    done = evidence_manifest.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark", str(config))
    assert (done["batches"], done["rows"], done["copies"]) == (3, 6, 2)
    assert evidence_manifest.described(spark.createDataFrame([], PAGES), evidence_manifest.SETTINGS).count() == 0


def _tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/d")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/l")
    return f"{path}/d", f"{path}/l"


def test_screen_replaces_only_what_it_was_asked_for(spark, tmp_path):
    docs = [(i, None if i == 0 else "t" * i, None if i == 1 else "ab"[i % 2], "xyz"[i % 3], i) for i in range(60)] + [(None, "", "a", None, None)]
    labels = [(i, i % 2, 0) for i in range(0, 60, 2)] + [(0, 0, 0), (999, 1, 1), (None, 1, 1)]
    paths = _tables(spark, tmp_path, docs, labels)
    first = label_screen.run(spark, *paths, f"{tmp_path}/out")
    assert set(first) == set(label_screen.SCREENS)
    table = lambda: sorted(map(str, spark.read.parquet(f"{tmp_path}/out/figures").collect()))
    figures = {(r.screen, r.subject, r.grp, r.measure): r.value for r in spark.read.parquet(f"{tmp_path}/out/figures").collect()}
    assert figures["missingness", "quality", "b", "percent"] == 100.0 and figures["missingness", "text", "a", "missing"] == 2
    assert figures["selection", "n_chars", None, "eligible"] == 61 and figures["selection", "n_chars", None, "analysed"] == 30
    assert figures["association", "lang x labelled", None, "df"] == 1
    old = table()
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"screens": ["selection"], "smd_warn": 0.0, "smd_fail": 0.0}))
    second = label_screen.run(spark, *paths, f"{tmp_path}/out", str(config))
    assert set(second) == {"selection"} and table() == old
    status = {(r.screen, r.check_name): r.status for r in spark.read.parquet(f"{tmp_path}/out/checks").collect()}
    assert status["missingness", "quality b"] == "FAIL" and status["selection", "n_chars"] == "FAIL"
    for bad in ({"screens": ["none"]}, {"screen": []}):
        config.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            label_screen.run(spark, *paths, f"{tmp_path}/out", str(config))


def test_screen_of_empty_tables(spark, tmp_path):
    paths = _tables(spark, tmp_path, [], [])
    out = label_screen.run(spark, *paths, f"{tmp_path}/out")
    assert out["selection"] == "Not applicable"


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "u", "h")], PAGES).write.parquet(f"{tmp_path}/in")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = [sys.executable, "-m", "jobs.evidence_manifest", "--source", f"{tmp_path}/in", "--target", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{root}/jobs/evidence_manifest.json"]
    done = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 new batches with 1 rows" in done.stderr and spark.read.parquet(f"{tmp_path}/out").count() == 1

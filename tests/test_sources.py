"""Readers, sinks and streams over temporary folders."""

import json
from datetime import datetime, timedelta

import pytest

from versemill.sources import readers, sinks
from versemill.streaming import reads as stream

GOOD = {
    "bundle": 1, "generated": "2024-01-01", "more": 5,
    "chapters": [{"n": 1, "name": "a", "title": "A", "verses": 2}],
    "verses": [{"id": f"1:{n}", "ch": 1, "n": n, "speaker": None, "devanagari": "द", "iast": "da", "meaning": "m", "takeaway": "t"} for n in (1, 2)],
    "feelings": [{"name": "f", "line": None, "verses": ["1:1", "1:2"]}],
}


def test_bundle(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(GOOD))
    one = readers.bundle(spark, str(tmp_path / "good.json"))
    assert readers.bundle_faults(one).count() == 0 and readers.bundle_tables(one)["verses"].count() == 2
    bad = json.loads(json.dumps(GOOD))
    bad["feelings"][0]["verses"].append("99:99")
    bad["bundle"], bad["verses"][1]["n"], bad["verses"][0]["meaning"] = 2, 3, " "
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    faults = {(r.check, r.detail) for r in readers.bundle_faults(readers.bundle(spark, str(tmp_path / "bad.json"))).collect()}
    assert ("reference", "99:99") in faults and {c for c, _ in faults} == {"reference", "version", "contiguity", "id", "blank"}


def test_optional_and_pages(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "page43.txt").write_bytes(b"a\xffb")
    (tmp_path / "page45.txt").write_text("x")
    landed = readers.pages(spark, str(tmp_path / "page*.txt"))
    assert {r.name: r.chars for r in landed.collect()} == {"page43.txt": 3, "page45.txt": 1}
    assert [r.page for r in readers.missing_pages(landed, 43, 45).collect()] == [44]


def test_readings(spark):
    html = "<p>dhṛtarāṣṭra uvāca\n<b>dharmakṣetre</b> / Bhg_01.001a\nkim akurvata // Bhg_01.001c\n</p>"
    row = readers.readings(spark.createDataFrame([("p", html)], "name string, text string")).first()
    assert (row.id, row.first, row.second, row.speaker) == ("1:1", "dharmakṣetre", "kim akurvata", "dhṛtarāṣṭra")


def test_keyed_writes(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *x: spark.createDataFrame(x, "k string, v int")
    sinks.upsert(spark, rows(("a", 1), ("b", 2)), path, "k")
    sinks.upsert(spark, rows(("a", 5)), path, "k")
    sinks.insert_new(spark, rows(("a", 9), ("c", 3)), path, "k")
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {"a": 5, "b": 2, "c": 3}
    sinks.delete_keys(spark, rows(), path, "k")
    sinks.delete_keys(spark, rows(("b", 0)), path, "k")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "c"]
    sinks.clear(spark, [path])
    assert spark.read.parquet(path).count() == 0


def test_gate_and_seed(spark, tmp_path):
    t = {"verses": spark.createDataFrame([("1:2", 2), ("1:1", 1)], "id string, n int")}
    fault = spark.createDataFrame([("x", "c", "d")], "id string, check string, detail string")
    assert sinks.gated_export(t, fault, str(tmp_path / "out"), {"verses": ["n"]}) == 1 and not (tmp_path / "out").exists()
    assert sinks.gated_export(t, fault.limit(0), str(tmp_path / "out"), {"verses": ["n"]}) == 0 and (tmp_path / "out/verses").exists()
    assert sinks.seed(spark, t, "v1", str(tmp_path / "db")) and not sinks.seed(spark, t, "v1", str(tmp_path / "db")) and sinks.seed(spark, t, "v2", str(tmp_path / "db"))
    packs = spark.createDataFrame([("ch01-1", "text")], "pack_id string, text string")
    sinks.write_packs(packs, str(tmp_path / "packs"))
    sinks.sign_off(spark, packs, "ch01-1", "approved", "2024-01-01", str(tmp_path / "status"))
    assert spark.read.parquet(str(tmp_path / "status")).first().status == "approved"
    with pytest.raises(ValueError):
        sinks.sign_off(spark, packs, "ch99-1", "approved", "", str(tmp_path / "status"))
    assert [sinks.clamped_scale(x) for x in (0.1, 1.0, 9)] == [0.85, 1.0, 1.3]


def test_debounce_over_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, i, t0 + timedelta(milliseconds=ms)) for i, ms in enumerate([0, 100, 250, 900])] + [(2, 10, t0), (None, 11, t0)]
    schema = "reader_id long, progress_id long, read_at timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream.debounced(stream.replay(spark, str(tmp_path / "in")), 300, late="1 second")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    later = [(3, 50, t0 + timedelta(hours=1)), (3, 51, t0 + timedelta(hours=2))]
    for row in later:  # the watermark moves on and the timers of readers 1 and 2 fire
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.progress_id for r in got if r.reader_id in (1, 2)) == [2, 3, 10]


def test_bookmarks_kept_current(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, 7, "1:1", t, t), (1, 7, "1:2", t, t + timedelta(hours=1)), (2, 8, "1:1", t, t)]
    spark.createDataFrame(rows, "bookmark_id long, reader_id long, verse_id string, created_at timestamp_ntz, ingested_at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream.keep_current(spark, stream.replay(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert {r.bookmark_id: r.verse_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "1:2", 2: "1:1"}

"""Sources, kernels on drawn images, the verdict step, reports and streams."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import kernels as K
from lodestrata.operators import stateful as O
from lodestrata.plans import pipeline, report, verdicts
from lodestrata.sources import files, frames, text
from lodestrata.streaming import scenes as streams

SRT = """1
00:00:00,000 --> 00:00:00,033
FrameCnt: 1 2026-08-15 19:49:39.873 [latitude: 46.5] [longitude: -7.25] [rel_alt: 1.5 abs_alt: 900.0]

2
no number here latitude: 1

3
FrameCnt: 2 [latitude: 1.2.3] [longitude: 8]
gb_yaw: -12.5 focal_len: 24.0

4
FrameCnt: 2 [longitude: 9]

5
FrameCnt: 3
"""


def test_telemetry(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "DJI_1.SRT").write_text(SRT)
    got = {r.frame_num: r for r in text.read_telemetry(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1].video_id == "DJI_1"
    assert (got[1].lat, got[1].lon, got[1].abs_alt, got[1].datetime) == (46.5, -7.25, 900.0, "2026-08-15 19:49:39")
    assert (got[2].lat, got[2].lon, got[2].yaw) == (None, 9.0, None)
    assert text.first_recording_times(text.read_telemetry(spark, str(tmp_path))).first().recorded == "2026-08-15 19:49:39"


def test_recording_time(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00", None, "x"), (None, '<CreationDate value="2021-02-03T04:05:06+01:00"/>', "x"), (None, None, "DJI_20220304050607_1.mp4"), (None, None, "x")], "t string, x string, n string")
    assert [r[0] for r in df.select(text.recording_time(F.col("t"), F.col("x"), F.col("n"))).collect()] == ["2020-01-01 00:00:00", "2021-02-03 04:05:06", "2022-03-04 05:06:07", None]


def test_listing(spark, tmp_path):
    for name in ("v/one.MP4", "v/one.SRT", "v/one.xml", "v/two.mov", "v/note.txt", "r/one.AZ/report.json", "r/one.AZ/scenes/hq/scene_01_f00010_orig.jpg", "r/one.AZ/scenes/lq/scene_01_f00010_orig.jpg", "r/one.AZ/scenes/lq/scene_00_f00002_grid_v3.jpg", "r/one.AZ/scenes/scene_01_f00010_grid_v1.jpg", "r/one.AZ/scenes/hq/odd.jpg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 100)
    every = files.listing(spark, str(tmp_path))
    found = {r.video_id: [c.rsplit("/", 1)[1] for c in r.companions] for r in files.with_companions(files.videos(every), every).collect()}
    assert found == {"one": ["one.SRT", "one.xml"], "two": []}
    assert files.report_folders(every).count() == 1
    images = files.scene_images(every)
    got = files.scene_files(spark.createDataFrame([("scene_01_f00010",), ("scene_09_f00001",)], "base string"), images).collect()
    m = {r.base: r.images for r in got}
    assert "/hq/" in m["scene_01_f00010"]["orig"] and set(m["scene_01_f00010"]) == {"orig", "v1"} and m["scene_09_f00001"] is None
    assert [r.place for r in files.originals(images).collect()] == ["hq", "lq"]


def test_contexts(spark, tmp_path):
    (tmp_path / "sea.json").write_text(json.dumps({"context": "sea"}, indent=1))
    r = text.read_contexts(spark, str(tmp_path)).first()
    assert (r.context, r.natural_list, r.name) == ("sea", "", "sea")
    assert text.preset(spark, "sar-heli").first().platform_notes and not text.preset(spark, "sar").first().platform_notes
    with pytest.raises(ValueError):
        text.preset(spark, "moon")
    empty = F.struct(*(F.lit("").alias(f) for f in text._SEARCH))
    some = F.struct(*(F.lit("x").alias(f) for f in text._SEARCH))
    got = text.resolve_context(spark.range(1).select(empty.alias("a"), some.alias("b")), "a", "b").first().resolved
    assert got.context == "x"
    assert text.text_or_file(str(tmp_path / "sea.json")).startswith("{") and text.text_or_file("plain") == "plain"


# --- kernels ---


def picture(h=480, w=640, value=110):
    rng = np.random.default_rng(0)
    return np.clip(rng.normal(value, 3, (h, w, 1)) + np.zeros(3), 0, 255).astype(np.uint8)


def test_planes():
    x = np.zeros((1, 4, 3), np.uint8)
    x[0, 0], x[0, 1], x[0, 2], x[0, 3] = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    assert K.gray(x).tolist() == [[29, 150, 76, 255]]
    assert K.hsv(x)[0].tolist() == [[120, 255, 255], [60, 255, 255], [0, 255, 255], [0, 0, 255]]
    assert np.rint(K.lab(x)[0]).tolist() == [[82, 207, 20], [224, 42, 211], [136, 208, 195], [255, 128, 128]]
    y = np.random.default_rng(1).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert np.abs(K.from_hsv(K.hsv(y)).astype(int) - y).max() <= 6
    assert np.abs(K.from_lab(K.lab(y)).astype(int) - y).max() <= 1


def test_frame_measures():
    g = np.random.default_rng(2).integers(0, 256, (96, 128)).astype(np.uint8)
    dx, dy = K.shift(g, np.roll(g, (5, -7), (0, 1)))
    assert abs(dx + 7) < 0.3 and abs(dy - 5) < 0.3
    assert K.sharpness(np.full((9, 9), 7, np.uint8)) == 0 and K.sharpness(g) > 1000
    assert K.signature(g).shape == (256,) and K.color_histogram(picture()).sum() == pytest.approx(1)


def test_enhancement():
    dark = picture(120, 160, 40)
    for v in ("v1", "v2", "v3", "v4"):
        out = K.enhanced(dark, v)
        assert out.shape == dark.shape and out.dtype == np.uint8
    assert K.gray(K.enhanced(dark, "v3")).mean() > K.gray(dark).mean() + 20
    assert (K.enhanced(dark, "orig") == dark).all()
    with pytest.raises(ValueError):
        K.enhanced(dark, "v5")


def test_color_anomaly_is_found_and_margins_are_ignored():
    x = picture()
    rng = np.random.default_rng(5)
    x[:, :, 1] = np.clip(x[:, :, 1].astype(int) + 18, 0, 255)  # a greenish ground, colourful all over
    x[:, :, 0] = np.clip(x[:, :, 0].astype(int) - rng.integers(0, 6, x.shape[:2]), 0, 255)
    x[300:316, 400:416] = (0, 120, 255)
    x[300:316, 100:116] = (0, 120, 255)
    found = K.color_anomalies(x)
    assert [f["color"] for f in found] == ["orange"] and found[0]["zone"] == 5
    b = found[0]["bbox"]
    assert abs(b["x"] - 400) <= 3 and abs(b["y"] - 300) <= 3
    assert K.color_anomalies(picture()) == []


def test_shapes_are_found():
    x = np.full((480, 640, 3), 90, np.uint8)
    x[200:240, 300:340] = 220
    yy, xx = np.indices(x.shape[:2])
    x[np.hypot(xx - 450, yy - 300) <= 30] = 230
    kinds = {(f["shape"], f["zone"]) for f in K.shapes(x)}
    assert ("circle", 6) in kinds and any(k in kinds for k in (("square", 5), ("rectangle", 5)))
    line = np.full((480, 640, 3), 90, np.uint8)
    line[250:252, 300:500] = 250
    assert any(f["shape"] == "line" and abs(f["length"] - 200) < 12 for f in K.shapes(line))
    assert K.shapes(np.full((480, 640, 3), 90, np.uint8)) == []


def test_shape_rules_agree_with_the_columns(spark):
    from lodestrata.functions import scalars as S

    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 6, 8):
        turn = np.sort(rng.random(n)) * 2 * np.pi if n == 3 else np.arange(n) * 2 * np.pi / n
        p = np.rint(np.c_[200 + 60 * np.cos(turn), 200 + 60 * np.sin(turn)])
        area, length, rect = K.polygon_area(p), K.perimeter(p), K.rectangle_score(p)
        name, score, _ = K.classify(p, p, area, length)
        points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
        r = spark.range(1).select(S.shape(F.lit(area), F.lit(length), points, F.lit(rect)).alias("s")).first().s
        assert r.shape == name and r.score == pytest.approx(score, abs=1e-9)


def test_frame_source_and_image_measures(spark, tmp_path):
    for v in ("one", "two"):
        (tmp_path / v).mkdir()
        for k in range(4):
            (tmp_path / v / f"frame_{k * 10:05d}.png").write_bytes(K.png(picture(60, 80, 60 + 40 * k)))
    (tmp_path / "one" / "bad.png").write_bytes(b"no image")
    spark.dataSource.register(frames.FrameSource)
    df = spark.read.format("frames").option("frames_a_partition", 2).load(str(tmp_path))
    assert df.count() == 8
    assert sorted(r.frame_idx for r in df.filter("frame_idx >= 10 and frame_idx < 30 and video_id = 'one'").collect()) == [10, 20]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("frames").option("pushdown", "true").load(str(tmp_path)).filter("frame_idx >= 10 and frame_idx < 30")
    assert sorted(r.frame_idx for r in pushed.collect()) == [10, 10, 20, 20]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = frames.FilteredFrameReader(str(tmp_path), 500)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([GreaterThan(("frame_idx",), 10), EqualTo(("video_id",), "one")]))
    assert len(left) == 1 and sum(len(p.files) for p in reader.partitions()) == 4
    images = files.images(spark, str(tmp_path))
    got = frames.measured(images).collect()
    assert len(got) == 8 and sorted({round(r["mean"] / 10) for r in got}) == [6, 10, 14, 18]
    assert frames.color_findings(images).filter("size(color_findings) > 0").count() == 0
    assert frames.shape_findings(images).count() == 8
    pngs = frames.enhanced(images.limit(1), "v1").select(F.lit("out/a.png").alias("name"), "png")
    assert frames.write_binary(pngs, "name", "png", f"file://{tmp_path}").count() == 1
    assert files.images(spark, str(tmp_path / "out")).first().height == 60
    picks = spark.createDataFrame([("one", 10), ("one", 99)], "video_id string, frame_idx long")
    assert frames.wanted(df, picks).count() == 1


# --- verdicts, reports, streams ---


def test_verdict_step(spark):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "scene_id long, prompt string")
    asked = verdicts.ask(verdicts.tasks(rows, True), verdicts.stub, "m", parallel=3)
    v = verdicts.verdicts(asked, "m")
    merged = {r.scene_id: r for r in verdicts.merge(v, ["scene_id"]).collect()}
    by = {}
    for r in v.collect():
        by.setdefault(r.scene_id, []).append(r)
    for k, rs in by.items():
        hits = sorted((r for r in rs if r.found), key=lambda r: r.variant_order)
        m = merged[k]
        assert len(rs) == 4 and m.found == bool(hits) and m.confidence == max((r.confidence for r in hits), default=0)
        assert [f.source_variant for f in m.findings] == [r.variant for r in hits]
    calls = []

    def broken(model, image, prompt):
        calls.append(prompt)
        raise RuntimeError("down")

    got = [r.error for r in verdicts.ask(rows.coalesce(1), broken, "m").collect()]
    assert got[:3] == ["down"] * 3 and set(got[3:]) == {"skipped after repeated errors"}
    two = verdicts.two_stages(rows, verdicts.stub, "see", "think").collect()
    assert all(r.answer and r.described and r.error is None for r in two)
    ctx = verdicts.generate_context(spark.createDataFrame([("x",)], "description string"), lambda *_: 'ok {"context": "c", "natural_list": null}', "m").first()
    assert (ctx.context, ctx.natural_list, ctx.error) == ("c", "", None)


REPORT = {
    "video": "one",
    "scenes": [
        {"scene_id": 0, "best_frame": 5, "llm_fast": {"objects_found": True, "confidence": 0.7, "findings": [{"zone": "Z3", "color": "orange", "confidence": 0.6}, {"zone": "Z10"}, {"zone": "3", "confidence": 0.9}]}},
        {"scene_id": 1, "best_frame": 9, "llm_fast": {"objects_found": False, "confidence": 0.1, "findings": []}, "llm_deep": {"objects_found": True, "confidence": 0.5, "findings": [{"zone": "Z1", "color": "blue"}]}},
    ],
}


def test_reports(spark, tmp_path):
    for name, body in (("one", json.dumps(REPORT, indent=2)), ("two", json.dumps({"video": "two", "scenes": []})), ("bad", "{ not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.json").write_text(body)
    r = text.read_reports(spark, str(tmp_path))
    assert {x.video for x in r.collect()} == {"one", "two"}
    t = {x.video: x for x in report.totals(r).collect()}
    assert (t["one"].scenes, t["one"].positives, t["one"].confirmed, t["one"].findings_total) == (2, 1, 1, 4)
    s = {x.video: x for x in report.summary(r).collect()}
    assert (s[None].scenes, s["one"].status, s["two"].status) == (2, "POSITIVES", "clear")
    status = report.batch_status(spark.createDataFrame([("one",), ("three",)], "video_id string"), r)
    assert {x.video_id: x.status for x in status.collect()} == {"one": "POSITIVES", "three": "NOT ANALYZED"}
    scenes = report.scenes_of(r)
    z = {(x.scene_id, x.zone): x.confidence for x in report.zone_confidences(scenes).collect()}
    assert z == {(0, 3): 0.9, (1, 1): 0.5}
    lines = [x.line for x in report.findings_lines(r, without_color="orange").collect()]
    assert lines == ["3", "Z10"] or set(lines) == {"Z10", "3"}
    news = spark.createDataFrame([("scene_01_f00009", (0.5, {"Z1": 0.5}, [1], [], "x.jpg"))], f"base string, dynamics {schemas.DYNAMICS}")
    updated = {x.scene_id: x.dynamics and x.dynamics.anomaly_score for x in report.update_dynamics(scenes, news).collect()}
    assert updated == {0: None, 1: 0.5}
    back = report.build(scenes, spark.createDataFrame([("one",), ("two",)], "video string"))
    assert {x.video: x.scenes_found for x in back.collect()} == {"one": 2, "two": 0}
    report.write(back, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    report.append_checkpoint(scenes.select("video", "scene_id").limit(1), str(tmp_path / "done"), "fast")
    assert report.pending(scenes.select("video", "scene_id"), spark.read.parquet(str(tmp_path / "done")), "fast").count() == 1


def test_whole_plan(spark):
    rng = np.random.default_rng(8)
    kinds = rng.random((6, 256))
    rows = [(v, f, 30.0, float(rng.integers(0, 70)), 300.0, 100.0, 40.0, (kinds[f // 100 % 6] + rng.random(256) * 0.1).astype(np.float32).tolist(), rng.dirichlet(np.ones(8)).tolist()) for v in ("a", "b") for f in range(600)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, fps double, shift double, sharpness double, mean double, std double, signature array<float>, histogram array<double>")
    s = pipeline.Settings(deep_scenes=3, two_stage=False)
    good = pipeline.passed(pipeline.scored(pipeline.sampled(df, s), s), s)
    found = pipeline.scenes(good, s)
    assert found.groupBy("video_id").count().count() == 2
    where = spark.createDataFrame([("a", 50, 1.0, 0), ("a", 330, 2.0, 1)], "video_id string, frame_num long, lat double, ordinal long")
    placed = pipeline.located(found, where)
    for r in placed.collect():
        near = [k for k in (50, 330) if r.video_id == "a" and abs(k - r.best_frame) <= 30]
        assert (r.gps is None) == (not near)
    ready = placed.withColumn("prompt", F.concat_ws(":", "video_id", "scene_id")).withColumn("color_zones", F.array(F.lit(1)))
    out = pipeline.judged(ready, s).collect()
    assert len(out) == found.count() and sum(r.llm_deep is not None for r in out) <= 6
    assert pipeline.Settings(helicopter=True).threshold == 0.4 and pipeline.BATCH.dedup == 0.9


def test_each_call_is_made_once_with_its_image(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [bytearray(rng.integers(0, 256, 24 * 32 * 3, dtype=np.uint8).tobytes()) for _ in range(12)]
    shape = "height int, width int, nChannels int, data binary"
    pictures = spark.createDataFrame([("v", k, 24, 32, 3, d) for k, d in enumerate(data)], f"video_id string, scene_id long, {shape}")
    found = spark.createDataFrame([("v", k, k * 400, 0.9, f"p{k}", [1]) for k in range(12)], "video_id string, scene_id long, best_frame long, best_score double, prompt string, color_zones array<int>")
    found.write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(model, image, prompt):
        (calls / uuid.uuid4().hex).write_text(json.dumps([model, prompt, bytes(image[:4]).hex() if image else ""]))
        if model == "fast" and prompt == "p5" and len(list(calls.iterdir())) < 14:
            raise RuntimeError("down")
        return verdicts.stub(model, image, prompt)

    s = pipeline.Settings(deep_scenes=4, two_stage=False, mode="chancepeek")
    out = pipeline.judged(found, s, client, pictures, f"file://{tmp_path}/answers")
    first = out.collect()
    out.collect()
    out.count()
    made = [json.loads(c.read_text()) for c in calls.iterdir()]
    assert Counter(m for m, _, _ in made) == {"fast": 12, "deep": 4}
    assert all(head == "89504e47" for _, _, head in made)
    again = pipeline.judged(found, s, client, pictures, f"file://{tmp_path}/answers").collect()
    assert len(list(calls.iterdir())) == 17  # the one that failed
    assert len(first) == len(again) == 12 and {r.scene_id for r in first if r.error} == {5} and not any(r.error for r in again)
    two = pipeline.judged(found, pipeline.Settings(deep_scenes=0, two_stage=True), client, pictures).collect()
    assert len(two) == 12 and len(list(calls.iterdir())) == 17 + 24


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(v, f, float(rng.integers(0, 80)), float(rng.integers(0, 5)), float(rng.integers(0, 6))) for v in "ab" for f in range(120)]
    schema = "v string, f long, shift double, s double, x double"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.filter(F.col("f").between(k * 40, k * 40 + 39)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    alike = lambda a, b: abs(a - b) <= 1

    def run(op, name):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = op(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.sql(f"select * from {name}").collect()))

    assert run(lambda s: streams.adaptive_sample(s, "v", "f", "shift", None), "sampled") == sorted(map(tuple, O.adaptive_sample(df, "v", "f", "shift").collect()))
    closed = run(lambda s: streams.group_scenes(s, "v", "f", "s", "x", alike, 6, None), "grouped")
    batch = sorted(map(tuple, O.group_scenes(df, "v", "f", "s", "x", alike, 6).collect()))
    assert set(closed) <= set(batch) and {r for r in batch if r[3] < 119 - 6} <= set(closed)


def test_a_stream_that_ends_gives_its_open_scenes(spark, tmp_path):
    schema = "v string, f long, s double, x double"
    spark.createDataFrame([("a", k, 1.0, float(k // 10)) for k in range(30)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streams.group_scenes(src, "v", "f", "s", "x", lambda a, b: a == b, 300, idle=1).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(1)
        if spark.sql("select * from ended").count():
            break
    q.stop()
    got = spark.sql("select * from ended").collect()
    assert sorted((r.scene, r.first_frame, r.last_frame) for r in got) == [(0, 0, 9), (1, 10, 19), (2, 20, 29)]


def test_commands(spark, tmp_path):
    from lodestrata import __main__ as cli

    rng = np.random.default_rng(3)
    for v in ("one", "two"):
        (tmp_path / "f" / v).mkdir(parents=True)
        base = rng.integers(0, 255, (80, 120, 3)).astype(np.uint8)
        for k in range(24):
            (tmp_path / "f" / v / f"{k:05d}.png").write_bytes(K.png(np.roll(base, k, axis=1) if k < 14 else 255 - base))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.SRT").write_text("FrameCnt: 9 [latitude: 46.5] [longitude: -7.25] [abs_alt: 12.5]\n")
    root = str(tmp_path)
    go = lambda *argv: cli.run(spark, cli.parser().parse_args([root + x[1:] if x.startswith("@") else x for x in argv]))
    rows = go("batch", "@/f", "--telemetry", "@/t", "--llm-run", "--color-anomalies", "--enforce-thresholds").collect()
    assert {r.video_id for r in rows} == {"one", "two"}
    near = [r for r in rows if r.gps is not None]
    assert near and near[0].exif.latitude.d == 46 and near[0].exif.longitude_ref == "W"
    assert all(r.found is not None for r in rows)
    assert {r.video_id for r in go("video", "@/f/one", "--stride", "5", "--enforce-thresholds").collect()} <= {"one"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "report.json").write_text(json.dumps(REPORT))
    assert go("report", "@/r").count() == 2 and go("llm", "@/r").count() == 2 and go("previews", "@/r").count() == 10 and go("llm-preview", "@/r").count() == 2
    assert go("info", "@/t").count() == 0 and go("context", "find a tent").count() == 1
    assert go("colors", "@/f/one").count() == 24 and go("image", "@/f/two", "--variant", "v1").count() == 24 and go("geometry", "@/f/two").count() == 24
    from lodestrata.functions import scalars as S

    g = spark.createDataFrame([((46.5, None, 3.5),)], "gps struct<lat:double,lon:double,abs_alt:double>")
    full = F.struct(*(F.col(f"gps.{c}").alias(c) if c in ("lat", "lon", "abs_alt") else F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "abs_alt", "rel_alt", "yaw", "pitch", "roll", "focal_len", "dzoom_ratio", "distance", "speed")))
    assert g.select(S.telemetry_lines(full)).first()[0] == "Alt 3.5 m"

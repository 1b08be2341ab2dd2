"""Order-dependent operators against plain loops, and properties of joins and picks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import aggregate as A
from lodestrata.operators import joins as J
from lodestrata.operators import select as P
from lodestrata.operators import stateful as O

boxes = st.builds(lambda x, y, w, h: {"x": x, "y": y, "w": w, "h": h}, *(st.integers(0, 60),) * 2, *(st.integers(0, 40),) * 2)


@given(st.lists(st.one_of(st.none(), st.floats(0, 100)), max_size=300))
@settings(deadline=None, max_examples=60)
def test_sampler_leaves_no_long_gap(shifts):
    s, last, first = O.Sampler(), -1, None
    for k, v in enumerate(shifts):
        if s.take(v):
            assert k - last <= 20
            first, last = k if first is None else first, k
    if len(shifts) >= 10:
        assert first == 9


def test_sampler_rules():
    s = O.Sampler()
    assert [s.take(99) for _ in range(10)] == [False] * 9 + [True]
    assert s.take(61) and s.stride == 1
    for want in (2, 3, 4):
        s.take(0)
        assert s.stride == want
    s.take(9)
    assert s.stride == 3


def loop_scenes(rows, alike, gap):
    scenes = []
    for f, score, sig in rows:
        for s in scenes:
            if f - s["frames"][-1] <= gap and alike(sig, s["sig"]):
                s["frames"].append(f)
                if score > s["score"]:
                    s.update(score=score, best=f, sig=sig)
                break
        else:
            scenes.append({"frames": [f], "score": score, "best": f, "sig": sig})
    return [(s["frames"][0], s["frames"][-1], len(s["frames"]), s["best"], s["score"]) for s in scenes]


def test_scene_grouping_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(v, k * rng.choice([1, 2]), float(rng.randrange(4)), float(rng.randrange(8))) for v in "abc" for k in range(200)]
    rows = sorted({(v, f): (v, f, s, x) for v, f, s, x in rows}.values())
    alike = lambda a, b: abs(a - b) <= 1
    df = spark.createDataFrame(rows, "v string, f long, s double, x double")
    got = O.group_scenes(df, "v", "f", "s", "x", alike, 12).collect()
    for v in "abc":
        want = loop_scenes([r[1:] for r in rows if r[0] == v], alike, 12)
        assert sorted((r.first_frame, r.last_frame, r.n_frames, r.best_frame, r.best_score) for r in got if r.v == v) == sorted(want)


def test_dedup_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    hist = rng.dirichlet(np.ones(6) * 2, 80)
    rows = [("v", k, None if k % 17 == 5 else h.tolist()) for k, h in enumerate(hist)]
    got = {r.k: r.cluster for r in O.dedup_scenes(spark.createDataFrame(rows, "v string, k long, h array<double>"), "v", "k", "h", 0.7, 0.7).collect()}
    clusters = []
    for _, k, h in rows:
        best, at = 0.7, None
        for c, members in enumerate(clusters):
            rep = rows[members[0]][2]
            if h is not None and rep is not None and np.minimum(h, rep).sum() > best:
                best, at = np.minimum(h, rep).sum(), c
        if at is None:
            clusters.append([k])
        else:
            clusters[at].append(k)
    assert got == {k: c for c, members in enumerate(clusters) for k in members}


def test_merged_scenes(spark):
    s = spark.createDataFrame([("v", 0, 10, 0.5, 3, 1, 20), ("v", 1, 50, 0.9, 2, 40, 60), ("v", 2, 90, 0.9, 5, 80, 99)], "video_id string, scene long, best_frame long, best_score double, n_frames long, first_frame long, last_frame long")
    c = spark.createDataFrame([("v", 0, 0), ("v", 1, 0), ("v", 2, 0)], "video_id string, scene long, cluster long")
    r = O.merged_scenes(s, c, "video_id", "scene").first()
    assert (r.best_frame, r.best_score, r.n_frames, r.first_frame, r.last_frame, r.merged_from) == (90, 0.9, 10, 1, 99, [0, 1, 2])


@given(boxes, boxes)
def test_iou_is_symmetric_and_bounded(a, b):
    v = O.box_iou(a, b)
    assert v == O.box_iou(b, a) and 0 <= v <= 1


def test_color_merge_chain():
    f = lambda x, c, n: {"bbox": {"x": x, "y": 0, "w": 10, "h": 10}, "confidence": c, "area": n, "name": x}
    out = O.merge_color([f(0, 0.5, 1), f(4, 0.9, 2), f(8, 0.1, 4), f(50, 0.3, 8)])
    assert [(x["name"], x["area"]) for x in out] == [(4, 7), (50, 8)]


def test_shape_merge():
    box = lambda x, c, s="square": {"shape": s, "bbox": {"x": x, "y": 0, "w": 10, "h": 10}, "confidence": c}
    assert [x["confidence"] for x in O.merge_shapes([box(0, 0.5), box(2, 0.9), box(1, 0.7, "circle")])] == [0.9, 0.7]
    line = lambda a, x, c: {"shape": "line", "angle": a, "length": 50, "centroid": {"x": x, "y": 0}, "confidence": c}
    assert len(O.merge_shapes([line(179, 0, 0.5), line(1, 3, 0.6)])) == 1
    assert len(O.merge_shapes([line(179, 0, 0.5), line(20, 3, 0.6)])) == 2


@pytest.mark.parametrize("kind", [int, float])
def test_color_merges_of_many_scenes_equal_the_core(kind):
    rng = np.random.default_rng(5)
    size = np.r_[rng.integers(0, 8, 300), 60, 0, 200, 48, 49]
    n = int(size.sum())
    box = [rng.integers(0, m, n).astype(kind) + a for m, a in ((60, 0), (60, 0), (40, 1), (40, 1))]
    confidence, area = rng.integers(0, 20, n) / 20, (rng.integers(1, 1000, n) / kind(1 if kind is int else 3)).astype(kind)
    got = [[] for _ in size]
    for s, f, a in zip(*(v.tolist() for v in O.color_merges(box, confidence, area, size)), strict=True):
        got[s].append((f, a))
    end = np.cumsum(size)
    for s, e in enumerate(end):
        scene = [{"name": k, "bbox": {c: box[j][k].item() for j, c in enumerate("xywh")}, "confidence": confidence[k].item(), "area": area[k].item()} for k in range(e - size[s], e)]
        assert got[s] == [(f["name"], f["area"]) for f in O.merge_color(scene)]


def test_merged_colors_of_batches(spark):
    kind = "g long, findings array<struct<name:string,bbox:struct<x:long,y:long,w:long,h:long>,confidence:double,area:long>>"
    rng = np.random.default_rng(6)
    one = lambda k: (f"n{k}", tuple(rng.integers(1, 30, 4).tolist()), float(rng.integers(0, 9)) / 9, int(rng.integers(1, 99)))
    rows = [(g, None if g == 3 else [one(k) for k in range(g % 9)]) for g in range(60)]
    for rows in (rows, [*rows, (99, [("alone", None, 0.5, None)])]):
        df = spark.createDataFrame(rows, kind)
        want, got = (df.select("g", f.alias("findings")).collect() for f in (O.merged("findings", df, O.merge_color), O.merged_colors("findings", df)))
        assert sorted(got) == sorted(want)


def test_iou_dedup_query_equals_the_core(spark):
    from lodestrata.plans.queries import QUERIES, _boxes

    sf = "/root/testdata/sf0.001"
    own = {}
    for r in _boxes(lambda n: spark.read.parquet(f"{sf}/{n}.parquet")).collect():
        b = r.box.asDict()
        own.setdefault(r.g, []).append((r.i, {"bbox": b, "area": b["w"] * b["h"], "confidence": r.i * 31 % 97 / 97}))
    want = {g: O.merge_color([f for _, f in sorted(v, key=lambda p: p[0])]) for g, v in own.items()}
    got = {r.g: (r.n, r.area) for r in QUERIES["iou_dedup"](spark, sf).collect()}
    assert got == {g: (len(v), sum(f["area"] for f in v)) for g, v in want.items()}


def test_components():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert O.label_components(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 4]]
    rng = np.random.default_rng(0)
    m = rng.random((40, 50)) < 0.4
    label = O.label_components(m)
    seen, n = np.zeros(m.shape, bool), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not seen[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                j, i = todo.pop()
                if 0 <= j < 40 and 0 <= i < 50 and m[j, i] and not seen[j, i]:
                    seen[j, i] = True
                    assert label[j, i] == n
                    todo += [(j + a, i + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert n == label.max()


# --- joins and picks ---


def test_merge_shapes_by_pairs_in_order():
    """The rule as it is stated: each pair in order, unless one of it has gone already."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        found = [{"shape": ("box", "circle")[rng.integers(2)], "confidence": float(rng.integers(1, 5)), "bbox": {"x": int(rng.integers(0, 12)), "y": 0, "w": 8, "h": 8}} for _ in range(rng.integers(0, 9))]
        gone = [False] * len(found)
        for j, k in ((j, k) for j in range(len(found)) for k in range(j + 1, len(found))):
            if not gone[j] and not gone[k] and found[j]["shape"] == found[k]["shape"] and O.box_iou(found[j]["bbox"], found[k]["bbox"]) > 0.3:
                gone[k if found[j]["confidence"] >= found[k]["confidence"] else j] = True
        assert O.merge_shapes(found) == [f for f, g in zip(found, gone, strict=True) if not g]


def test_nearest(spark):
    left = spark.createDataFrame([("a", 100), ("a", 131), ("a", 200), ("b", 100), ("a", -5)], "v string, f long")
    right = spark.createDataFrame([("a", 70, 1, "x"), ("a", 130, 2, "y"), ("a", 230, 3, "z"), ("a", 170, 4, "w"), ("a", 20, 5, "n")], "v string, f long, o long, name string")
    want = {("a", 100): "x", ("a", 131): "y", ("a", 200): "z", ("b", 100): None, ("a", -5): "n"}
    want[("a", -5)] = "n" if abs(-5 - 20) <= 30 else None
    for out in (J.nearest_unique(left.withColumn("k", F.concat_ws(":", "v", "f")), right, "k", "f", ["v"], 30, "o"),):
        assert {(r.v, r.f): r.match and r.match.name for r in out.collect()} == want


def test_spread_topk_small_cases(spark):
    df = spark.createDataFrame([(k, float(k % 5)) for k in range(20)], "t long, s double")
    pick = lambda k: sorted(r.t for r in P.spread_topk(df, "s", "t", k).collect())
    assert pick(0) == [] and pick(1) == [4] and len(pick(None)) == 20 and len(pick(30)) == 20
    best = sorted(sorted(range(20), key=lambda t: (-(t % 5), t))[:8])
    assert pick(4) == [best[int(i * 7 / 3)] for i in range(4)]


def test_upsert_and_status(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    news = spark.createDataFrame([(1, "b"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, J.upsert(base, news, ["k"], ["v"]).collect())) == [(1, "b"), (2, None)]
    assert {r.k: r.v for r in J.with_status(base.select("k"), news, "k", "v").collect()} == {1: "b", 2: "NOT ANALYZED"}
    assert J.keep_last(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k long, o long, v string"), ["k"], "o").first().v == "y"


def test_relaxation_never_raises_a_threshold(spark):
    df = spark.createDataFrame([(1, 0.01, 0.1), (100, 0.9, 9.0)], "n_good long, ratio double, density double")
    got = [(r.quality_threshold, r.similarity_threshold) for r in A.relaxed(df, 0.2, 0.5).collect()]
    assert got == [(0.2, 0.5)] * 2
    assert [r.quality_threshold for r in A.relaxed(df).collect()] == [0.3, 0.5]


# --- scalars ---


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_names(spark):
    r = one(spark, s=S.scene_of(F.lit("x/hq/scene_05_f01101_orig.jpg")), f=S.frame_of(F.lit("scene_05_f01101_grid_v3.jpg")), n=S.scene_of(F.lit("other.jpg"), 999999), b=S.canonical_base(F.lit("a/scene_05_f01101_orig.jpg")), v=S.variant_name(F.lit(5), F.lit(1101), "v2"), z=S.zone_number(F.lit("Z2-Z4")), no=S.zone_number(F.lit("Z10")), e=S.zone_number(F.lit("")), h=S.is_helicopter(F.lit("a/Helicopter 1.mp4")))
    assert (r.s, r.f, r.n, r.b, r.v, r.z, r.no, r.e, r.h) == (5, 1101, 999999, "scene_05_f01101", "scene_05_f01101_grid_v2.jpg", 2, None, None, True)


def test_times(spark):
    r = one(spark, t=S.timecode(F.lit(111111), F.lit(30)), m=S.minute_string(F.lit(111111), F.lit(30)), d=S.duration_string(F.lit(3661.5)), a=S.absolute_time(F.lit("2024-02-28 23:59:59"), F.lit(86401)), u=S.absolute_time(F.lit("2024-02-28 23:59:59"), F.lit(1), True), n=S.absolute_time(F.lit("soon"), F.lit(1)))
    assert (r.t, r.m, r.d, r.a, r.u, r.n) == ("01:01:43.69", "61:43.70", "01:01:01.50", "2024-03-01 00:00:00", "2024-02-29 00:00:00 UTC", "n/a")


def test_zone_borders(spark):
    df = spark.createDataFrame([(x, y) for x in (0, 212, 213, 425, 426, 639) for y in (0, 159, 160, 319, 320, 479)], "x long, y long")
    for r in df.select("x", "y", S.zone_of("x", "y", F.lit(640), F.lit(480)).alias("z")).collect():
        col = 0 if r.x < 213 else 1 if r.x < 426 else 2
        assert r.z == (0 if r.y < 160 else 1 if r.y < 320 else 2) * 3 + col + 1
    assert one(spark, z=S.zone_of(F.lit(-1), F.lit(0), F.lit(9), F.lit(9))).z == 5


def test_shapes_and_signatures(spark):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    r = one(spark, g=S.regularity(square), n=S.right_angles(square), s=S.shape(F.lit(100.0), F.lit(40.0), square, F.lit(1.0)), a=S.vector_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)), c=S.correlation(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (5.0, 7.0, 9.0)))), k=S.correlation(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    assert r.g == pytest.approx(1) and r.n == 4 and (r.s.shape, r.s.score) == ("square", pytest.approx(1)) and r.a == pytest.approx(90) and r.c == pytest.approx(1) and r.k == 0


def test_json_span(spark):
    df = spark.createDataFrame([('Sure: {"a": 1} ok',), ("none",), ('{"a": ',), (None,), ("x" * 4000,)], "t string")
    got = [(r.p.result and r.p.result.a, r.p.raw and len(r.p.raw)) for r in df.select(S.parsed("t", "a int").alias("p")).collect()]
    assert got == [(1, None), (None, 4), (None, 6), (None, None), (None, 3000)]


def test_quality_reasons_and_priority(spark):
    df = spark.createDataFrame([(10.0, 70.0, 5.0, 3.0), (1000.0, None, 100.0, 50.0)], "l double, s double, m double, d double")
    rows = df.select(S.quality("l", "s", "m", "d").alias("q"), S.quality_reasons("l", "s", "m", "d").alias("r")).collect()
    assert rows[0].q == pytest.approx(0.3 * 0.5 * 0.2 * 0.5) and rows[0].r == ["blurry(10)", "fast_move(70px)", "dark", "low_contrast(3)"]
    assert rows[1].q == 1 and rows[1].r == []
    f = spark.createDataFrame([([("Z1", "Dark Blue", 0.5), ("Z1", None, 0.25), ("", "green", None)], [1, 9])], "f array<struct<zone:string,color:string,confidence:double>>, z array<int>")
    assert f.select(S.priority("f", "z").alias("p")).first().p == pytest.approx(6 + 5 + 0.75 * 3 + 4)

"""Driver queries for the engine's own operators, each with the same thing in SQL where SQL can say it.

The tables stand in for videos: ``events`` are frames of a stream (``user_id``),
``orders`` scenes with a score and a time, ``lineitem`` findings and pixels,
``embeddings`` signatures and histograms, ``documents`` with ``labels`` verdicts.
Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import select as P
from ..operators import stateful as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (t: name -> DataFrame) under its name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def r6(c):
    return F.round(c, 6)


# --- frames: quality, sampling, grouping -----------------------------------


def _frames(t):
    """events as frames with sharpness, shift, mean and deviation."""
    e = t("events")
    return e.select("event_id", "user_id", "value", (F.col("value") * 3).alias("sharp"), F.pmod(F.col("event_id") * 7, F.lit(80)).alias("shift"), F.pmod(F.col("event_id") * 13, F.lit(256)).alias("mean"), F.pmod(F.col("event_id") * 5, F.lit(60)).alias("std"))


_FRAMES = "SELECT event_id, user_id, value, value * 3 AS sharp, event_id * 7 % 80 AS shift, event_id * 13 % 256 AS mean, event_id * 5 % 60 AS std FROM events"
_QUALITY = """(CASE WHEN sharp < 50 THEN 0.3 WHEN sharp < 100 THEN 0.6 WHEN sharp < 200 THEN 0.85 ELSE 1.0 END::DOUBLE
 * CASE WHEN shift > 30 THEN 0.5 WHEN shift > 15 THEN 0.75 ELSE 1.0 END::DOUBLE
 * CASE WHEN mean < 20 THEN 0.2 WHEN mean > 240 THEN 0.4 WHEN mean > 220 THEN 0.8 ELSE 1.0 END::DOUBLE
 * CASE WHEN std < 20 THEN 0.5 ELSE 1.0 END::DOUBLE)"""


@query(f"SELECT event_id, round({_QUALITY}, 6) AS score FROM ({_FRAMES}) WHERE {_QUALITY} >= 0.5")
def quality_score(t):
    score = S.quality("sharp", "shift", "mean", "std")
    return _frames(t).filter(score >= 0.5).select("event_id", r6(score).alias("score"))


@query(
    f"""SELECT event_id, array_to_string(list_filter([
 CASE WHEN sharp < 30 THEN 'blurry(' || round_even(sharp, 0)::BIGINT || ')' WHEN sharp < 60 THEN 'soft(' || round_even(sharp, 0)::BIGINT || ')' WHEN sharp < 120 THEN 'ok(' || round_even(sharp, 0)::BIGINT || ')' END,
 CASE WHEN shift > 60 THEN 'fast_move(' || shift || 'px)' WHEN shift > 35 THEN 'move(' || shift || 'px)' END,
 CASE WHEN mean < 10 THEN 'dark' WHEN mean > 245 THEN 'overexposed' WHEN mean > 220 THEN 'bright' END,
 CASE WHEN std < 12 THEN 'low_contrast(' || std || ')' END], lambda x: x IS NOT NULL), ' ') AS reasons FROM ({_FRAMES})"""
)
def quality_reasons(t):
    return _frames(t).select("event_id", F.array_join(S.quality_reasons("sharp", "shift", "mean", "std", S.HELICOPTER), " ").alias("reasons"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 7 = 0")
def fixed_stride_sample(t):
    return P.stride(t("events").select("event_id", "user_id"), "event_id", 7)


@query("SELECT event_id FROM events WHERE event_id >= floor(29.97 * 10) AND event_id < floor(29.97 * 100)")
def time_range_scan(t):
    return P.time_range(t("events").select("event_id"), "event_id", F.lit(29.97), 10.0, 100.0)


@query(
    """WITH RECURSIVE f AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events
), s AS (
  SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, 10 AS stride, 0 AS since, false AS seen, false AS hit FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, rn, event_id, stride, CASE WHEN hit THEN 0 ELSE since END, seen OR hit, hit FROM (
    SELECT *, since >= stride OR (seen AND value > 60) AS hit FROM (
      SELECT f.user_id, f.rn, f.event_id, f.value, s.seen, s.since + 1 AS since,
        CASE WHEN NOT s.seen THEN s.stride WHEN f.value > 20 THEN 1 WHEN f.value > 8 THEN greatest(1, s.stride - 1) ELSE least(20, s.stride + 1) END AS stride
      FROM s JOIN f ON f.user_id = s.user_id AND f.rn = s.rn + 1))
)
SELECT user_id, event_id, stride FROM s WHERE hit"""
)
def adaptive_sample(t):
    return O.adaptive_sample(t("events"), "user_id", "event_id", "value")


@query(
    """WITH RECURSIVE f AS (
  SELECT user_id, event_id, value, (event_id * 37 % 101)::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events
), s AS (
  SELECT user_id, 0::BIGINT AS rn, []::STRUCT(f BIGINT, l BIGINT, n BIGINT, b BIGINT, sc DOUBLE, sig DOUBLE)[] AS st FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, rn, CASE WHEN p > 0 THEN list_transform(st, lambda x, i: CASE WHEN i = p THEN
      {'f': x.f, 'l': event_id, 'n': x.n + 1, 'b': CASE WHEN score > x.sc THEN event_id ELSE x.b END, 'sc': greatest(score, x.sc), 'sig': CASE WHEN score > x.sc THEN value ELSE x.sig END} ELSE x END)
    ELSE list_append(st, {'f': event_id, 'l': event_id, 'n': 1::BIGINT, 'b': event_id, 'sc': score, 'sig': value}) END
  FROM (SELECT f.*, s.st, coalesce(list_position(list_transform(s.st, lambda x: f.event_id - x.l <= 1500 AND abs(f.value - x.sig) <= 5), true), 0) AS p
        FROM s JOIN f ON f.user_id = s.user_id AND f.rn = s.rn + 1)
), e AS (SELECT user_id, arg_max(st, rn) AS st FROM s GROUP BY user_id)
SELECT user_id, x.f AS first_frame, x.l AS last_frame, x.n AS n_frames, x.b AS best_frame, x.sc AS best_score FROM (SELECT user_id, unnest(st) AS x FROM e)"""
)
def scene_group(t):
    frames = t("events").select("user_id", "event_id", "value", F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double").alias("score"))
    return O.group_scenes(frames, "user_id", "event_id", "score", "value", lambda a, b: abs(a - b) <= 5, 1500).drop("scene")


@query(
    """WITH g AS (SELECT l_orderkey, max(l_extendedprice) AS m, count(*) AS n_frames, min(l_linenumber) AS first_frame, max(l_linenumber) AS last_frame FROM lineitem GROUP BY 1)
SELECT g.l_orderkey, round(m, 6) AS best_score, min(l_linenumber) AS best_frame, any_value(n_frames) AS n_frames, any_value(first_frame) AS first_frame, any_value(last_frame) AS last_frame
FROM g JOIN lineitem l ON l.l_orderkey = g.l_orderkey AND l_extendedprice = m GROUP BY 1, 2"""
)
def best_frame(t):
    return A.best_frame(t("lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber").withColumn("best_score", r6(F.col("best_score")))


_HIST = "SELECT vec_id, label, list_transform(embedding, lambda x: abs(x)::DOUBLE / list_sum(list_transform(embedding, lambda y: abs(y)::DOUBLE))) AS h FROM embeddings"


@query(
    f"""WITH RECURSIVE h AS MATERIALIZED ({_HIST}), k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM h),
p AS MATERIALIZED (SELECT a.label, a.rn AS i, b.rn AS j, list_sum(list_transform(list_zip(a.h, b.h), lambda z: least(z[1], z[2]))) AS v FROM k a JOIN k b ON a.label = b.label AND b.rn < a.rn),
c AS (
  SELECT label, 0::BIGINT AS i, []::BIGINT[] AS reps, 0::BIGINT AS rep FROM (SELECT DISTINCT label FROM k)
  UNION ALL
  SELECT c.label, c.i + 1, CASE WHEN q.j IS NULL THEN list_append(c.reps, c.i + 1) ELSE c.reps END, coalesce(q.j, c.i + 1)
  FROM c JOIN k ON k.label = c.label AND k.rn = c.i + 1
  LEFT JOIN LATERAL (SELECT j FROM p WHERE p.label = c.label AND p.i = c.i + 1 AND list_contains(c.reps, p.j) AND v > 0.63 ORDER BY v DESC, j LIMIT 1) q ON true
)
SELECT k.label, k.vec_id, (dense_rank() OVER (PARTITION BY c.label ORDER BY rep) - 1) AS cluster FROM c JOIN k ON k.label = c.label AND k.rn = c.i WHERE c.i > 0"""
)
def scene_dedup(t):
    scenes = t("embeddings").select("label", "vec_id", S.l1_normalised("embedding").alias("hist"))
    return O.dedup_scenes(scenes, "label", "vec_id", "hist", threshold=0.63, floor=0.63)


@query(
    """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM c a JOIN c b ON b.vec_id = a.vec_id + 1"""
)
def pair_similarity(t):
    a = t("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", r6(S.correlation("embedding", "other")).alias("similarity"))


@query(f"WITH h AS ({_HIST}) SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.h, b.h), lambda z: least(z[1], z[2]))), 6) AS overlap FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def hist_intersection(t):
    a = t("embeddings").select("vec_id", S.l1_normalised("embedding").alias("h"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("other"))
    return a.join(b, "vec_id").select("vec_id", r6(S.histogram_intersection("h", "other")).alias("overlap"))


@query(
    """WITH l AS (SELECT event_id FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS k, value FROM events WHERE event_type = 'purchase'),
m AS (SELECT l.event_id, k, value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.event_id - k), k) AS n FROM l JOIN r ON k BETWEEN l.event_id - 30 AND l.event_id + 30)
SELECT l.event_id, m.k AS nearest, round(m.value, 6) AS lat FROM l LEFT JOIN m ON m.event_id = l.event_id AND n = 1"""
)
def nearest_telemetry(t):
    e = t("events")
    left = e.filter("event_type = 'error'").select("event_id")
    right = e.filter("event_type = 'purchase'").select("event_id", "value")
    return J.nearest_unique(left.withColumn("id", F.col("event_id")), right, "id", "event_id").select("event_id", F.col("match.event_id").alias("nearest"), r6(F.col("match.value")).alias("lat"))


@query("SELECT user_id, count(*) AS n_frames, count_if(value >= 40)::BIGINT AS n_good, CASE WHEN (count_if(value >= 40) < 5 AND count_if(value >= 40) / count(*) < 0.02) OR count_if(value >= 40) / greatest((max(event_id) - min(event_id) + 1) / 30.0::DOUBLE, 1e-9) < 0.08 THEN 0.3 ELSE 0.5 END::DOUBLE AS quality_threshold FROM events GROUP BY user_id")
def relaxation(t):
    e = t("events")
    seconds = (F.max("event_id") - F.min("event_id") + 1) / 30.0
    ratio = A.quality_ratio(e, ["user_id"], F.col("value"), 40, seconds)
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return A.relaxed(ratio, least_density=0.08).join(n, "user_id").select("user_id", "n_frames", "n_good", "quality_threshold")


# --- zones and findings ----------------------------------------------------

_ZONE = "(CASE WHEN y < 160 THEN 0 WHEN y < 320 THEN 1 ELSE 2 END * 3 + CASE WHEN x < 213 THEN 0 WHEN x < 426 THEN 1 ELSE 2 END + 1)"
_POINTS = f"SELECT *, {_ZONE} AS zone FROM (SELECT *, l_partkey * 7 % 640 AS x, l_suppkey * 11 % 480 AS y FROM lineitem)"


def _points(t):
    p = t("lineitem").withColumn("x", F.pmod(F.col("l_partkey") * 7, F.lit(640))).withColumn("y", F.pmod(F.col("l_suppkey") * 11, F.lit(480)))
    return J.with_zone(p, "x", "y", 640, 480)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, zone, x >= 250 AND y >= 100 AND y < 450 AS inside FROM ({_POINTS})")
def zone_assign(t):
    inside = S.in_working_area("x", "y", F.lit(480))
    return _points(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "zone", inside.alias("inside"))


@query(f"SELECT l_orderkey, zone, round(max(l_discount * 10), 6) AS max_confidence FROM ({_POINTS}) GROUP BY 1, 2")
def zone_max(t):
    p = _points(t).withColumn("confidence", F.col("l_discount") * 10)
    return A.zone_maxima(p, ["l_orderkey"], "zone", "confidence").withColumn("max_confidence", r6(F.col("max_confidence")))


@query(
    f"""WITH z AS (SELECT l_orderkey, zone, max(l_discount * 10) AS m FROM ({_POINTS}) GROUP BY 1, 2)
SELECT l_orderkey, round(max(m), 4) AS anomaly_score, string_agg('Z' || zone || '=' || (round(m, 4) * 10000)::BIGINT, ',' ORDER BY zone) AS zone_scores, string_agg(zone::VARCHAR, ',' ORDER BY zone) AS flagged_zones FROM z GROUP BY 1"""
)
def scene_dynamics(t):
    d = A.dynamics(_points(t).withColumn("confidence", F.col("l_discount") * 10), ["l_orderkey"], "zone", "confidence")
    entries = F.transform(F.map_entries("zone_scores"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("long").cast("string")))
    return d.select("l_orderkey", "anomaly_score", F.array_join(F.array_sort(entries), ",").alias("zone_scores"), F.array_join(F.transform("flagged_zones", lambda z: z.cast("string")), ",").alias("flagged_zones"))


@query(
    f"""WITH a AS (SELECT l_orderkey, list(DISTINCT zone) AS zs FROM ({_POINTS}) WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT zone) AS zs FROM ({_POINTS}) WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT a.l_orderkey, len(list_intersect(a.zs, b.zs)) AS shared FROM a JOIN b USING (l_orderkey)"""
)
def zone_overlap(t):
    p = _points(t).select("l_orderkey", "l_returnflag", "zone")
    g = p.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("zone"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("zone"))).alias("b"))
    return g.filter("size(a) > 0 and size(b) > 0").select("l_orderkey", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


_BINS = "SELECT *, (least(31, floor(l_quantity * 32 / 51)))::BIGINT AS a, (least(31, floor(l_discount * 320 / 1.1)))::BIGINT AS b FROM lineitem"


def _pixels(t):
    return t("lineitem").withColumn("a", F.least(F.lit(31), F.floor(F.col("l_quantity") * 32 / 51)).cast("long")).withColumn("b", F.least(F.lit(31), F.floor(F.col("l_discount") * 320 / 1.1)).cast("long"))


@query(
    f"""WITH p AS ({_BINS}), h AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT *, -ln(n / (SELECT count(*) FROM p) + 1e-10) AS rarity FROM h),
x AS (SELECT p.*, rarity FROM p JOIN r USING (a, b)), q AS (SELECT quantile_cont(rarity, 0.97) AS q FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, a, b, round(rarity, 6) AS rarity FROM x, q WHERE rarity > q"""
)
def rarity_outliers(t):
    p = _pixels(t)
    bins = A.rarity(A.histogram(p, [], F.col("a"), F.col("b")), [])
    scored = p.join(F.broadcast(bins.select(F.col("a_bin").alias("a"), F.col("b_bin").alias("b"), "rarity")), ["a", "b"])  # 32 x 32 rows at most
    return A.above_percentile(scored, [], "rarity").select("l_orderkey", "l_linenumber", "l_partkey", "a", "b", r6(F.col("rarity")).alias("rarity"))


@query(
    f"""WITH p AS ({_BINS}), h AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), d AS (SELECT unnest([-1, 0, 1]) AS d),
g AS (SELECT x.range AS a, y.range AS b FROM range(32) x, range(32) y),
m AS (SELECT g.a, g.b, (2 - abs(i.d)) * (2 - abs(j.d)) / 16.0::DOUBLE AS w,
  CASE WHEN g.a + i.d < 0 THEN -(g.a + i.d) WHEN g.a + i.d > 31 THEN 62 - (g.a + i.d) ELSE g.a + i.d END AS sa,
  CASE WHEN g.b + j.d < 0 THEN -(g.b + j.d) WHEN g.b + j.d > 31 THEN 62 - (g.b + j.d) ELSE g.b + j.d END AS sb FROM g, d i, d j)
SELECT m.a AS a_bin, m.b AS b_bin, round(sum(n * w), 6) AS smooth FROM m JOIN h ON h.a = sa AND h.b = sb GROUP BY 1, 2"""
)
def rarity_smoothed(t):
    bins = A.histogram(_pixels(t), [], F.col("a"), F.col("b"))
    return A.smoothed(bins, [], 32).withColumn("smooth", r6(F.col("smooth")))


@query(
    """WITH c AS (SELECT vec_id, floor(128 + embedding[1]::DOUBLE * 200) - 128 AS a, floor(128 + embedding[2]::DOUBLE * 200) - 128 AS b FROM embeddings)
SELECT vec_id, CASE WHEN a < -5 AND b < 15 THEN 'blue' WHEN a > 20 AND b > 10 THEN 'orange' WHEN a > 5 AND b > 25 THEN 'yellow' WHEN a > 20 AND b < 10 THEN 'red' WHEN a < -10 AND b > 10 THEN 'green' WHEN a > 15 AND b < -5 THEN 'magenta' ELSE 'unknown' END AS color FROM c"""
)
def color_name(t):
    lab = lambda i: F.floor(128 + F.get("embedding", F.lit(i)).cast("double") * 200)
    return t("embeddings").select("vec_id", S.color_name(lab(0), lab(1)).alias("color"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0, l_quantity / 80 * 0.3 + least(l_discount * 50 / 5, 1.0) * 0.4 + l_tax * 0.3), 6) AS confidence FROM lineitem")
def color_confidence(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(S.color_confidence("l_quantity", F.col("l_discount") * 50, "l_tax")).alias("confidence"))


_BOXES = "SELECT DISTINCT l_orderkey AS g, l_partkey * 10 + l_linenumber AS i, l_partkey % 200 AS x, l_suppkey % 150 AS y, 20 + l_quantity::BIGINT AS w, 30 + l_linenumber::BIGINT AS h FROM lineitem"


def _box_rows(t):
    return t("lineitem").select(
        F.col("l_orderkey").alias("g"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("i"),
        F.struct((F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 150).alias("y"), (20 + F.col("l_quantity").cast("long")).alias("w"), (30 + F.col("l_linenumber").cast("long")).alias("h")).alias("box"),
    )


def _boxes(t):
    return _box_rows(t).distinct()


@query(
    f"""WITH b AS ({_BOXES}), p AS (SELECT a.g, a.i AS a, c.i AS b, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS o, a.w * a.h + c.w * c.h AS s FROM b a JOIN b c ON a.g = c.g AND a.i < c.i)
SELECT g, a, b, round(o / greatest(s - o, 1), 6) AS iou FROM p WHERE o / greatest(s - o, 1) > 0.3"""
)
def iou_pairs(t):
    return J.iou_pairs(_boxes(t), "g", "i", "box").withColumn("iou", r6(F.col("iou")))


@query()
def iou_dedup(t):
    """CLU-03 over the boxes of each order; SQL has no such fold, a test compares it with plain Python."""
    # sets: equal boxes go where the order's boxes meet, in one shuffle
    boxes = _box_rows(t).groupBy("g").agg(F.array_sort(F.collect_set(F.struct("i", "box"))).alias("boxes"))
    finding = lambda b: F.struct(b["i"].alias("i"), b["box"].alias("bbox"), (b["box"]["w"] * b["box"]["h"]).alias("area"), (F.pmod(b["i"] * 31, F.lit(97)) / 97).alias("confidence"))
    scenes = boxes.select("g", F.transform("boxes", finding).alias("findings"))
    merged = scenes.select("g", O.merged_colors("findings", scenes).alias("findings"))
    return merged.select("g", F.size("findings").cast("long").alias("n"), F.aggregate("findings", F.lit(0).cast("long"), lambda s, f: s + f["area"]).alias("area"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END, 6) AS angle, round(sqrt(dx * dx + dy * dy), 6) AS length, round(CASE WHEN p < 1 THEN 0 ELSE 4 * pi() * l_quantity / (p * p) END, 6) AS circ FROM (
 SELECT *, degrees(atan2(dy, dx)) AS d FROM (SELECT *, l_quantity * 4 AS p, (l_partkey % 100 - 50)::DOUBLE AS dx, (l_suppkey % 90 - 45)::DOUBLE AS dy FROM lineitem))"""
)
def line_geometry(t):
    rows = t("lineitem").withColumn("dx", (F.col("l_partkey") % 100 - 50).cast("double")).withColumn("dy", (F.col("l_suppkey") % 90 - 45).cast("double"))
    zero = F.lit(0.0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", r6(S.line_angle(zero, zero, "dx", "dy")).alias("angle"), r6(S.line_length(zero, zero, "dx", "dy")).alias("length"), r6(S.circularity("l_quantity", F.col("l_quantity") * 4)).alias("circ"))


_LINES = "SELECT DISTINCT l_orderkey AS g, l_partkey * 10 + l_linenumber AS i, (l_partkey % 180)::DOUBLE AS angle, (40 + l_quantity)::DOUBLE AS length, (l_suppkey % 40)::DOUBLE AS cx, (l_linenumber * 3)::DOUBLE AS cy FROM lineitem"


@query(
    f"""WITH l AS ({_LINES}), p AS (SELECT a.g, a.i AS a, b.i AS b, a.length AS la, b.length AS lb, least(abs(a.angle - b.angle), 180 - abs(a.angle - b.angle)) AS off,
 abs((b.cy - a.cy) * cos(radians(a.angle)) - (b.cx - a.cx) * sin(radians(a.angle))) AS apart, (b.cx - a.cx) * cos(radians(a.angle)) + (b.cy - a.cy) * sin(radians(a.angle)) AS along FROM l a JOIN l b ON a.g = b.g AND a.i < b.i)
SELECT g, a, b FROM p WHERE off <= 10 AND apart < greatest(8, least(la, lb) * 0.15) AND least(la / 2, along + lb / 2) - greatest(-la / 2, along - lb / 2) > 0"""
)
def line_pairs(t):
    li = t("lineitem")
    line = F.struct((F.col("l_partkey") % 180).cast("double").alias("angle"), (40 + F.col("l_quantity")).alias("length"), (F.col("l_suppkey") % 40).cast("double").alias("cx"), (F.col("l_linenumber") * 3).cast("double").alias("cy"))
    rows = li.select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("i"), line.alias("line")).distinct()
    a, b = rows.select("g", F.col("i").alias("a"), F.col("line").alias("la")), rows.select("g", F.col("i").alias("b"), F.col("line").alias("lb"))
    return a.join(b, "g").filter((F.col("a") < F.col("b")) & S.lines_alike("la", "lb")).select("g", "a", "b")


_POLY = """WITH v AS (SELECT vec_id, list_transform(range(4 + vec_id % 3), lambda k: {'x': floor(embedding[2 * k + 1]::DOUBLE * 1000), 'y': floor(embedding[2 * k + 2]::DOUBLE * 1000)}) AS p FROM embeddings),
c AS (SELECT vec_id, len(p) AS n, list_transform(range(1, len(p) + 1), lambda i: {'ax': p[i].x - p[(i + len(p) - 2) % len(p) + 1].x, 'ay': p[i].y - p[(i + len(p) - 2) % len(p) + 1].y, 'bx': p[i % len(p) + 1].x - p[i].x, 'by': p[i % len(p) + 1].y - p[i].y}) AS e FROM v),
d AS (SELECT vec_id, n, list_transform(e, lambda s: sqrt(s.bx * s.bx + s.by * s.by)) AS sides, list_transform(e, lambda s: degrees(acos(greatest(-1, least(1, (s.ax * s.bx + s.ay * s.by) / (sqrt(s.ax * s.ax + s.ay * s.ay) * sqrt(s.bx * s.bx + s.by * s.by) + 1e-10)))))) AS turns FROM c)"""


@query(
    _POLY
    + """ SELECT vec_id, round(1 / (1 + 2 * list_stddev_pop(sides) / list_avg(sides) + 2 * list_stddev_pop(turns) / (list_avg(turns) + 1e-10)), 6) AS regularity,
 len(list_filter(turns, lambda x: abs(x - 90) < 12)) AS right_angles, round(list_min(sides) / list_max(sides), 6) AS side_ratio FROM d"""
)
def polygon_features(t):
    at = lambda k: F.floor(F.get("embedding", k.cast("int")).cast("double") * 1000)
    points = F.transform(F.sequence(F.lit(0), (3 + F.col("vec_id") % 3).cast("int")), lambda k: F.struct(at(2 * k).alias("x"), at(2 * k + 1).alias("y")))
    p = t("embeddings").select("vec_id", points.alias("p"))
    return p.select("vec_id", r6(S.regularity("p")).alias("regularity"), S.right_angles("p").cast("long").alias("right_angles"), r6(S.side_ratio("p")).alias("side_ratio"))


@query(
    """SELECT label, count(*) AS area, min(vec_id % 40) AS x, min(vec_id % 30) AS y, max(vec_id % 40) - min(vec_id % 40) + 1 AS w, max(vec_id % 30) - min(vec_id % 30) + 1 AS h, round(avg(vec_id % 40), 6) AS cx, round(avg(embedding[1]::DOUBLE), 6) AS mean_a FROM embeddings GROUP BY 1"""
)
def component_stats(t):
    p = t("embeddings").select("label", (F.col("vec_id") % 40).alias("x"), (F.col("vec_id") % 30).alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("a"))
    return A.component_stats(p, ["label"], ["a"]).select("label", "area", "bbox.x", "bbox.y", "bbox.w", "bbox.h", r6(F.col("cx")).alias("cx"), r6(F.col("mean_a")).alias("mean_a"))


# --- picks -----------------------------------------------------------------


@query(
    """WITH b AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100), p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM b)
SELECT o_orderkey, round(o_totalprice, 6) AS score FROM p WHERE i IN (SELECT floor(j.range * (SELECT max(n) - 1 FROM p) / 49)::BIGINT FROM range(50) j)"""
)
def spread_topk(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return P.spread_topk(o, "o_totalprice", "o_orderkey", 50).select("o_orderkey", r6(F.col("o_totalprice")).alias("score"))


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY o_custkey) // 3) AS s FROM orders)
SELECT o_custkey, o_orderkey FROM p WHERE i % s = 0 AND i // s < 3"""
)
def step_topk(t):
    return P.step_topk(t("orders").select("o_custkey", "o_orderkey"), "o_orderkey", 3, ["o_custkey"])


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R')::BIGINT AS c, max(l_discount) AS d FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, n * 2 + c * 5 + d * 3 AS score FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(score, 6) AS score FROM s ORDER BY s.score DESC, o_orderkey LIMIT 20"""
)
def budget_topk(t):
    l_ = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"), F.max("l_discount").alias("d"))
    s = t("orders").join(l_, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", (F.col("n") * 2 + F.col("c") * 5 + F.col("d") * 3).alias("score"))
    return P.budget_topk(s, "score", "o_orderkey", 20).withColumn("score", r6(F.col("score")))


@query(
    """WITH f AS (SELECT l_orderkey, list({'z': 'Z' || (l_linenumber + 1), 'c': CASE l_returnflag WHEN 'R' THEN 'Dark Blue' WHEN 'A' THEN 'green' ELSE '' END, 'q': l_discount}) AS fs, list(DISTINCT (1 + l_suppkey % 9)::INT) AS cz FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(list_sum(list_transform(fs, lambda x: 2 + CASE WHEN x.c = 'Dark Blue' THEN 5 ELSE 0 END + 3 * x.q)) + 4 * len(list_intersect(list_distinct(list_transform(fs, lambda x: x.z)), list_transform(cz, lambda z: 'Z' || z))), 6) AS priority FROM f"""
)
def priority_score(t):
    color = F.when(F.col("l_returnflag") == "R", "Dark Blue").when(F.col("l_returnflag") == "A", "green").otherwise("")
    finding = F.struct(F.concat(F.lit("Z"), (F.col("l_linenumber") + 1).cast("string")).alias("zone"), color.alias("color"), F.col("l_discount").alias("confidence"))
    f = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(finding).alias("f"), F.collect_set((1 + F.col("l_suppkey") % 9).cast("int")).alias("z"))
    return f.select("l_orderkey", r6(S.priority("f", "z")).alias("priority"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS scene_id FROM orders")
def renumber(t):
    return P.renumber(t("orders").select("o_custkey", "o_orderkey"), "o_orderkey", "scene_id", ["o_custkey"])


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT o_custkey, o_orderkey, p // 4 AS grid_row, p % 4 AS grid_col, p % 4 * 480 AS x, p // 4 * 270 AS y FROM p")
def grid_layout(t):
    return P.grid_place(t("orders").select("o_custkey", "o_orderkey"), "o_orderkey", 4, ["o_custkey"])


@query("WITH p AS (SELECT o_custkey AS video_id, o_orderkey AS scene, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT video_id, scene, p * 5 + c.range AS film_frame FROM p, range(5) c")
def preview_manifest(t):
    return P.manifest(t("orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("scene")), 0.5)


# --- joins, status, verdicts -----------------------------------------------


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unprocessed(t):
    return J.unprocessed(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_selected(t):
    wanted = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.selected(t("customer").select("c_custkey", "c_mktsegment"), wanted, ["c_custkey"])


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'clear' ELSE 'POSITIVES' END, 'NOT ANALYZED') AS status FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id".replace("CASE WHEN quality = 1 THEN 'clear' ELSE 'POSITIVES' END", "CASE WHEN quality = 1 THEN 'clear' WHEN quality = 0 THEN 'POSITIVES' END"))
def left_status(t):
    status = F.when(F.col("quality") == 1, "clear").when(F.col("quality") == 0, "POSITIVES")
    reports = t("labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).select("doc_id", status.alias("status"))
    return J.with_status(t("documents").select("doc_id"), reports, "doc_id", "status")


@query("SELECT s_suppkey, arg_min(l_shipmode, r) AS place FROM supplier LEFT JOIN (SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'hq' WHEN l_returnflag = 'N' THEN 'lq' ELSE 'root' END AS l_shipmode, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS r FROM lineitem WHERE l_quantity > 45) ON l_suppkey = s_suppkey GROUP BY 1")
def variant_priority(t):
    place = F.when(F.col("l_returnflag") == "A", "hq").when(F.col("l_returnflag") == "N", "lq").otherwise("root")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    c = t("lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"), place.alias("place"), rank.alias("rank"))
    return J.by_priority(t("supplier").select("s_suppkey"), c, "s_suppkey", "rank", "place").select("s_suppkey", "place")


@query("SELECT d.doc_id, coalesce(l.n_chars, d.n_chars) AS n_chars FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::BIGINT AS n_chars FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def upsert_dynamics(t):
    news = t("labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("n_chars"))
    return J.upsert(t("documents").select("doc_id", "n_chars"), news, ["doc_id"], ["n_chars"])


@query(
    """SELECT l_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS found, round(coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_discount END), 0), 6) AS confidence, round(sum(l_tax), 6) AS llm_time, count(*) AS n_variants FROM lineitem GROUP BY 1"""
)
def verdict_merge(t):
    v = t("lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("found"), F.col("l_discount").alias("confidence"), F.col("l_tax").alias("llm_time"), F.col("l_linestatus").alias("terrain"), "l_linenumber")
    m = A.merge_verdicts(v, ["l_orderkey"], "l_linenumber")
    return m.select("l_orderkey", "found", r6(F.col("confidence")).alias("confidence"), r6(F.col("llm_time")).alias("llm_time"), "n_variants")


@query("SELECT d.doc_id, CASE WHEN coalesce(l.toxic, 0) = 1 OR coalesce(l.quality, 0) * 0.5 > 0.4 THEN 0 ELSE 1 END AS source_rank FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def positives_negatives(t):
    v = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return P.positives_then_negatives(v, S.is_positive(F.col("toxic") == 1, F.col("quality") * 0.5)).select("doc_id", "source_rank")


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(p_name), 'orange') AND NOT contains(lower(p_type), 'steel')")
def non_target_findings(t):
    return t("part").filter(~F.lower("p_name").contains("orange") & ~F.lower("p_type").contains("steel")).select("p_partkey", "p_name")


@query(
    """SELECT r_name, n_name, count(DISTINCT c_custkey) AS scenes, count(o_orderkey) AS findings, count_if(o_orderstatus = 'F')::BIGINT AS positives, grouping(r_name)::INT AS is_total
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)"""
)
def report_rollup(t):
    o = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("p"))
    c = t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return A.rollup_totals(rows, ["r_name", "n_name"], scenes=F.count("c_custkey"), findings=zero("n"), positives=zero("p"))


@query("SELECT source AS video, count(*) AS scenes, count_if(coalesce(toxic, 0) = 1)::BIGINT AS positives, CASE WHEN count_if(coalesce(toxic, 0) = 1) > 0 THEN 'POSITIVES' ELSE 'clear' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def batch_summary(t):
    v = t("documents").select("doc_id", F.col("source").alias("video")).join(t("labels"), "doc_id", "left")
    hit = F.count_if(F.coalesce("toxic", F.lit(0)) == 1)
    return v.groupBy("video").agg(F.count(F.lit(1)).alias("scenes"), hit.alias("positives"), F.when(hit > 0, "POSITIVES").otherwise("clear").alias("status"))


# --- text and names --------------------------------------------------------


@query("""SELECT event_id, regexp_extract('note ' || props || ' end', '(?s)(\\{.*\\})', 1) AS span, (regexp_extract(props, '"k": *(-?[0-9]+)', 1))::BIGINT AS k FROM events""")
def json_span(t):
    p = S.parsed(F.concat(F.lit("note "), "props", F.lit(" end")), "k long")
    return t("events").select("event_id", S.json_span(F.concat(F.lit("note "), "props", F.lit(" end"))).alias("span"), p["result"]["k"].alias("k"))


@query("SELECT page_id, CASE WHEN contains(html, '{') AND regexp_matches(html, '(?s)\\{.*\\}') THEN NULL ELSE html[1:3000] END AS raw FROM pages")
def raw_verdict(t):
    return t("pages").select("page_id", F.when(S.json_span("html").isNull(), S.shortened("html", 3000)).alias("raw"))


@query("SELECT o_orderkey, o_custkey AS scene, o_orderkey % 90000 AS frame, printf('scene_%02d_f%05d', o_custkey, o_orderkey % 90000) AS base FROM orders")
def name_parse(t):
    path = F.concat(F.lit("a.AZ/hq/"), S.variant_name("o_custkey", F.col("o_orderkey") % 90000, "orig"))
    return t("orders").select("o_orderkey", S.scene_of(path).alias("scene"), S.frame_of(path).alias("frame"), S.canonical_base(path).alias("base"))


@query("SELECT p_partkey, CASE WHEN regexp_extract(p_brand, '([0-9]+)', 1) <> '' AND regexp_extract(p_brand, '([0-9]+)', 1)::INT % 20 BETWEEN 1 AND 9 THEN regexp_extract(p_brand, '([0-9]+)', 1)::INT % 20 END AS zone FROM part")
def zone_parse(t):
    text = F.concat(F.lit("Z"), (F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("int") % 20).cast("string"), F.lit("-Z4"))
    return t("part").select("p_partkey", S.zone_number(text).alias("zone"))


@query(
    """SELECT event_id, printf('%02d:%02d:%02d.%02d', s // 3600, s // 60 % 60, s % 60, floor((event_id / 25 - floor(event_id / 25)) * 100)::BIGINT) AS timecode, printf('%02d:%02d.%02d', s // 60, s % 60, (event_id % 25) * 4) AS time_str FROM (SELECT event_id, event_id // 25 AS s FROM events)"""
)
def time_strings(t):
    fps = F.lit(25)
    return t("events").select("event_id", S.timecode("event_id", fps).alias("timecode"), S.minute_string("event_id", fps).alias("time_str"))


@query("SELECT event_id, strftime(TIMESTAMP '2024-03-01 23:59:30' + to_seconds(event_id // 30), '%Y-%m-%d %H:%M:%S') AS abs_time FROM events")
def abs_time(t):
    return t("events").select("event_id", S.absolute_time(F.lit("2024-03-01 23:59:30"), F.col("event_id") / 30).alias("abs_time"))


@query("SELECT c_custkey, d, m, floor(((v - d) * 60 - m) * 60 * 10000)::BIGINT AS s, CASE WHEN c_acctbal >= 0 THEN 'N' ELSE 'S' END AS ref FROM (SELECT *, floor((v - d) * 60)::BIGINT AS m FROM (SELECT *, floor(v)::BIGINT AS d FROM (SELECT c_custkey, c_acctbal, abs(c_acctbal / 128) AS v FROM customer)))")
def dms(t):
    v = F.col("c_acctbal") / 128
    return t("customer").select("c_custkey", S.dms(v).alias("x"), S.hemisphere("c_acctbal", "N", "S").alias("ref")).select("c_custkey", "x.*", "ref")


@query("SELECT p_partkey, concat_ws(' | ', CASE WHEN p_size > 10 THEN 'alt ' || p_size END, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END) AS text FROM part")
def exif_text(t):
    return t("part").select("p_partkey", S.description(F.when(F.col("p_size") > 10, F.concat(F.lit("alt "), F.col("p_size").cast("string"))), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("text"))


@query("SELECT doc_id, concat_ws(chr(10), 'Mission: ' || source, CASE WHEN lang <> 'en' THEN 'Language: ' || lang END) AS block FROM documents")
def context_block(t):
    return t("documents").select("doc_id", S.labelled_lines(("Mission", "source"), ("Language", F.when(F.col("lang") != "en", F.col("lang")).otherwise(""))).alias("block"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'file' END, CASE WHEN l.quality = 1 THEN 'preset' END, CASE WHEN d.lang = 'de' THEN 'report' END, 'default') AS context FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def context_priority(t):
    v = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return v.select("doc_id", F.coalesce(F.when(F.col("toxic") == 1, "file"), F.when(F.col("quality") == 1, "preset"), F.when(F.col("lang") == "de", "report"), F.lit("default")).alias("context"))


# --- beyond the reference: what SQL gives besides ---------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(t):
    return t("lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.sum("l_quantity")).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def sessions(t):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(by)
    e = t("events").withColumn("new", F.when(gap <= F.expr("interval 6 hours"), 0).otherwise(1)).withColumn("s", F.sum("new").over(by))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("s")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def customers_without_orders(t):
    return t("customer").select("c_custkey").subtract(t("orders").select(F.col("o_custkey").alias("c_custkey")))

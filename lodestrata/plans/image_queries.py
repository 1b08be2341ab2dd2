"""Driver queries for image kernels, telemetry text and reports, over small pictures and texts made from the tables.

A picture is 8 x 8: a pixel's blue, green and red come from three places of an
embedding, so SQL can say what the kernel does to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalars as S
from ..sources.text import parse_telemetry
from . import report as R
from .queries import query, r6

_PIXELS = """px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, (floor(abs(embedding[i + 1]::DOUBLE) * 997)::BIGINT % 256) AS b, (floor(abs(embedding[(i + 21) % 64 + 1]::DOUBLE) * 997)::BIGINT % 256) AS g, (floor(abs(embedding[(i + 42) % 64 + 1]::DOUBLE) * 997)::BIGINT % 256) AS r
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""


def _pictures(t, run: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """vec_id and the rows that ``run`` gives for each picture."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, e in zip(batch["vec_id"], batch["embedding"], strict=True):
                plane = np.floor(np.abs(np.asarray(e, np.float64)) * 997).astype(np.int64) % 256
                bgr = np.stack([np.roll(plane, -k) for k in (0, 21, 42)], axis=1).astype(np.uint8).reshape(8, 8, 3)
                rows += [(ident, *r) for r in run(bgr)]
            yield pd.DataFrame(rows, columns=["vec_id", *names])

    return t("embeddings").select("vec_id", "embedding").mapInPandas(each, f"vec_id long, {schema}")


_GRAY = f"{_PIXELS}, gray AS (SELECT vec_id, y, x, (114 * b + 587 * g + 299 * r + 500) // 1000 AS v FROM px)"


@query(f"WITH {_GRAY} SELECT vec_id, y::BIGINT AS y, sum(v)::BIGINT AS total, max(v)::BIGINT AS most FROM gray GROUP BY 1, 2")
def gray_rows(t):
    """PIX-01: sum and maximum of each row of the grey plane."""
    return _pictures(t, lambda bgr: [(y, int(row.sum()), int(row.max())) for y, row in enumerate(K.gray(bgr).astype(np.int64))], "y long, total long, most long")


@query(
    f"""WITH {_GRAY}, d AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)),
lap AS (SELECT a.vec_id, a.y, a.x, sum(n.v) - 4 * any_value(a.v) AS l, any_value(a.v) AS v FROM gray a, d JOIN gray n ON n.vec_id = a.vec_id
  AND n.y = CASE a.y + dy WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.y + dy END AND n.x = CASE a.x + dx WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.x + dx END GROUP BY 1, 2, 3)
SELECT vec_id, (64 * sum(l * l) - sum(l) * sum(l))::BIGINT AS sharpness, sum(v)::BIGINT AS mean, (64 * sum(v * v) - sum(v) * sum(v))::BIGINT AS variance FROM lap GROUP BY 1"""
)
def frame_measures(t):
    """PIX-02, AGG-14: variance of the Laplacian, mean and variance of the grey plane, times 4096 and 64, which makes them whole."""

    def run(bgr: np.ndarray) -> list[tuple]:
        m = K.measures(bgr)
        return [(round(m["sharpness"] * 4096), round(m["mean"] * 64), round(m["std"] ** 2 * 4096))]

    return _pictures(t, run, "sharpness long, mean long, variance long")


@query(
    f"""WITH {_PIXELS}, m AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
h AS (SELECT vec_id, v, CASE WHEN d = 0 THEN 0 ELSE (CASE WHEN v = r THEN (g - b) / d WHEN v = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END) * 30 END AS h, CASE WHEN v = 0 THEN 0 ELSE round_even(d / v * 255, 0) END AS s FROM m)
SELECT vec_id, ((round_even(CASE WHEN h < 0 THEN h + 180 ELSE h END, 0)::BIGINT % 180) * 8 // 180) * 64 + (s::BIGINT // 32) * 8 + v // 32 AS bin, count(*) AS n FROM h GROUP BY 1, 2"""
)
def colour_histogram(t):
    """PIX-05, AGG-13: the filled bins of the 8 x 8 x 8 histogram of hue, saturation and value."""
    return _pictures(t, lambda bgr: [(k, round(n * 64)) for k, n in enumerate(K.color_histogram(bgr).tolist()) if n], "bin long, n long")


_LINEAR = "CASE WHEN {0} / 255 > 0.04045 THEN pow(({0} / 255 + 0.055) / 1.055, 2.4) ELSE {0} / 255 / 12.92 END"


@query(
    f"""WITH {_PIXELS}, lin AS (SELECT vec_id, {_LINEAR.format('r')} AS r, {_LINEAR.format('g')} AS g, {_LINEAR.format('b')} AS b FROM px),
xyz AS (SELECT vec_id, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM lin),
f AS (SELECT vec_id, y, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116 END AS fx, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116 END AS fy, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116 END AS fz FROM xyz)
SELECT vec_id, round(avg(CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END * 2.55), 4) AS light, round(avg(500 * (fx - fy) + 128), 4) AS a, round(avg(200 * (fy - fz) + 128), 4) AS b FROM f GROUP BY 1"""
)
def lab_means(t):
    """PIX-10: mean of each plane of LAB."""
    return _pictures(t, lambda bgr: [tuple(K.lab(bgr).reshape(-1, 3).mean(axis=0).tolist())], "light double, a double, b double").select("vec_id", *(F.round(c, 4).alias(c) for c in ("light", "a", "b")))


@query("SELECT user_id, event_id AS frame_num, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS datetime, max(value) AS lat, max(CASE WHEN event_type = 'click' THEN NULL ELSE -value END) AS rel_alt FROM events GROUP BY 1, 2")
def srt_parse(t):
    """SRC-04: subtitle texts of each user's events, read back."""
    line = F.concat(F.lit("1\n00:00:01 --> 00:00:02\nFrameCnt: "), F.col("event_id").cast("string"), F.date_format("ts", "' x' yyyy-MM-dd HH:mm:ss"), F.lit("\n[latitude: "), F.col("value").cast("string"), F.lit("] "), F.when(F.col("event_type") == "click", "rel_alt: 1.2.3").otherwise(F.concat(F.lit("rel_alt: -"), F.col("value").cast("string"))))
    texts = t("events").groupBy("user_id").agg(F.concat_ws("\n\n", F.lit("no frame here\nlatitude: 5"), F.sort_array(F.collect_list(line))).alias("value"))
    return parse_telemetry(texts, "user_id").select("user_id", "frame_num", "datetime", "lat", "rel_alt")


def _reports(t) -> DataFrame:
    found = lambda flag, value, n: F.struct((F.col(flag) == value).alias("objects_found"), (F.col("l_discount") * 10).alias("confidence"), F.array_repeat(F.struct(F.lit("Z3").alias("zone"), F.col("l_linestatus").alias("color")), n).alias("findings"))
    scene = F.struct("l_partkey", found("l_returnflag", "R", F.col("l_linenumber")).alias("llm_fast"), found("l_linestatus", "F", F.lit(1)).alias("llm_deep"))
    return t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("video")).agg(F.collect_list(scene).alias("scenes"))


@query(
    """SELECT l_orderkey::VARCHAR AS video, count(*) AS scenes, count_if(l_returnflag = 'R' OR l_discount * 10 > 0.4)::BIGINT AS positives, count_if(l_linestatus = 'F')::BIGINT AS confirmed, sum(l_linenumber + 1)::BIGINT AS findings_total,
CASE WHEN count_if(l_returnflag = 'R' OR l_discount * 10 > 0.4) > 0 THEN 'POSITIVES' ELSE 'clear' END AS status FROM lineitem GROUP BY ROLLUP (l_orderkey)"""
)
def report_summary(t):
    """AGG-07, AGG-08: totals of each report, with a grand total."""
    return R.summary(_reports(t)).select("video", *(F.col(c).cast("long").alias(c) for c in ("scenes", "positives", "confirmed", "findings_total")), "status")


@query("SELECT vec_id, round(degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) + 1e-10))))), 4) AS angle FROM (SELECT vec_id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS by_ FROM embeddings)")
def vector_angle(t):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t("embeddings").select("vec_id", F.round(S.vector_angle(at(0), at(1), at(2), at(3)), 4).alias("angle"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0, l_discount * 10 * 0.7 + least(1.0, l_quantity * 20 / 500) * 0.3), 6) AS confidence FROM lineitem")
def shape_confidence(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(S.shape_confidence(F.col("l_discount") * 10, F.col("l_quantity") * 20)).alias("confidence"))


@query("SELECT o_orderkey, printf('%02d:%02d:%02d.%02d', c // 360000, c // 6000 % 60, c // 100 % 60, c % 100) AS duration, round(o_orderkey / 8, 1) AS size_mb FROM (SELECT o_orderkey, o_orderkey * 37 AS c FROM orders)")
def durations(t):
    return t("orders").select("o_orderkey", S.duration_string(F.col("o_orderkey") * 37 / 100).alias("duration"), S.megabytes(F.col("o_orderkey") * 125000).alias("size_mb"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 1000 >= 0.4 * 500")
def scene_floor(t):
    """FIL-02: scenes of a score of 0.4 or more."""
    return t("orders").filter(S.worth_asking(F.col("o_totalprice") / 1000 / 500)).select("o_orderkey")

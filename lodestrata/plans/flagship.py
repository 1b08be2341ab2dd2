"""The flagship query: score frames, keep the good ones, group them to scenes, take scenes spread over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import select as P
from ..operators import stateful as O
from .queries import _FRAMES, _QUALITY, _frames


def spread_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stream: frames scoring 0.5 or more, greedy scenes, and 5 scenes spread over time."""
    score = S.quality("sharp", "shift", "mean", "std")
    good = _frames(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")).withColumn("score", score).filter("score >= 0.5")
    scenes = O.group_scenes(good, "user_id", "event_id", "score", "value", lambda a, b: abs(a - b) <= 5, 1500)
    picked = P.spread_topk(scenes, "best_score", "best_frame", 5, ["user_id"])
    return picked.select("user_id", "best_frame", F.round("best_score", 6).alias("best_score"), "n_frames", "first_frame", "last_frame")


SQL = f"""WITH RECURSIVE g AS (SELECT *, {_QUALITY} AS score FROM ({_FRAMES})),
f AS (SELECT user_id, event_id, value, score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM g WHERE score >= 0.5),
s AS (
  SELECT user_id, 0::BIGINT AS rn, []::STRUCT(f BIGINT, l BIGINT, n BIGINT, b BIGINT, sc DOUBLE, sig DOUBLE)[] AS st FROM (SELECT DISTINCT user_id FROM f)
  UNION ALL
  SELECT user_id, rn, CASE WHEN p > 0 THEN list_transform(st, lambda x, i: CASE WHEN i = p THEN
      {{'f': x.f, 'l': event_id, 'n': x.n + 1, 'b': CASE WHEN score > x.sc THEN event_id ELSE x.b END, 'sc': greatest(score, x.sc), 'sig': CASE WHEN score > x.sc THEN value ELSE x.sig END}} ELSE x END)
    ELSE list_append(st, {{'f': event_id, 'l': event_id, 'n': 1::BIGINT, 'b': event_id, 'sc': score, 'sig': value}}) END
  FROM (SELECT f.*, s.st, coalesce(list_position(list_transform(s.st, lambda x: f.event_id - x.l <= 1500 AND abs(f.value - x.sig) <= 5), true), 0) AS p
        FROM s JOIN f ON f.user_id = s.user_id AND f.rn = s.rn + 1)
), e AS (SELECT user_id, unnest(arg_max(st, rn)) AS x FROM s GROUP BY user_id),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x.sc DESC, x.b) AS r FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x.b) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM b WHERE r <= 10)
SELECT user_id, x.b AS best_frame, round(x.sc, 6) AS best_score, x.n AS n_frames, x.f AS first_frame, x.l AS last_frame FROM t
WHERE n <= 5 OR i IN (SELECT floor(j.range * (t.n - 1) / 4)::BIGINT FROM range(5) j)"""

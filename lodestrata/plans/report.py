"""Reports: building them from scene tables, summarising them, and updating them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J

_YES = "coalesce({0}.objects_found, false) or coalesce({0}.confidence, 0) > 0.4"


def scenes_of(reports: DataFrame) -> DataFrame:
    """One row a scene: video, report_path (if there is one) and the scene's fields."""
    keep = [c for c in ("video", "report_path", "recording_time") if c in reports.columns]
    return reports.select(*keep, F.explode("scenes").alias("scene")).select(*keep, "scene.*")


def totals(reports: DataFrame) -> DataFrame:
    """scenes, positives, confirmed and findings (fast and deep) of each report."""
    positive = F.filter("scenes", lambda s: F.coalesce(s["llm_fast"]["objects_found"], F.lit(False)) | (F.coalesce(s["llm_fast"]["confidence"], F.lit(0.0)) > 0.4))
    confirmed = F.filter("scenes", lambda s: F.coalesce(s["llm_deep"]["objects_found"], F.lit(False)))
    n = lambda s, k: F.coalesce(F.size(s[k]["findings"]), F.lit(0))
    findings = F.aggregate("scenes", F.lit(0), lambda t, s: t + F.greatest(n(s, "llm_fast"), F.lit(0)) + F.greatest(n(s, "llm_deep"), F.lit(0)))
    rows = reports.withColumn("scenes", F.coalesce("scenes", F.expr("array()")))
    return rows.select("video", F.size("scenes").alias("scenes"), F.size(positive).alias("positives"), F.size(confirmed).alias("confirmed"), findings.alias("findings_total"))


def summary(reports: DataFrame) -> DataFrame:
    """As ``totals`` with POSITIVES or clear, and a grand total whose video is null."""
    t = totals(reports)
    rolled = t.rollup("video").agg(*(F.sum(c).alias(c) for c in ("scenes", "positives", "confirmed", "findings_total")))
    return rolled.withColumn("status", F.when(F.col("positives") > 0, "POSITIVES").otherwise("clear"))


def batch_status(videos: DataFrame, reports: DataFrame) -> DataFrame:
    """Every video with its report's status, or NOT ANALYZED."""
    s = summary(reports).filter("video is not null").select(F.col("video").alias("video_id"), "status")
    return J.with_status(videos, s, "video_id", "status")


def findings_lines(reports: DataFrame, kind: str = "llm_fast", without_color: str | None = None, width: int = 120) -> DataFrame:
    """Findings as shortened text lines, most confident first; those of one colour can be left out."""
    f = scenes_of(reports).filter(F.expr(_YES.format(kind))).select("video", "scene_id", "best_frame", F.explode(f"{kind}.findings").alias("f"))
    if without_color:
        f = f.filter(~F.lower(F.coalesce("f.color", F.lit(""))).contains(without_color))
    text = F.concat_ws(" ", "f.zone", "f.color", "f.type", "f.description")
    return f.select("video", "scene_id", S.shortened(text, width).alias("line"), F.col("f.confidence").alias("confidence")).orderBy("video", F.desc("confidence"), "scene_id")


def zone_confidences(scenes: DataFrame) -> DataFrame:
    """video, scene_id, zone and its largest confidence over fast and deep findings; a finding without one has its verdict's."""
    parts = [scenes.filter(f"coalesce({k}.objects_found, false)").select("video", "scene_id", F.explode(f"{k}.findings").alias("f"), F.coalesce(f"{k}.confidence", F.lit(0.0)).alias("c")) for k in ("llm_fast", "llm_deep")]
    rows = parts[0].unionByName(parts[1]).select("video", "scene_id", S.zone_number("f.zone").alias("zone"), F.coalesce("f.confidence", "c").alias("confidence"))
    return rows.filter("zone is not null").groupBy("video", "scene_id", "zone").agg(F.max("confidence").alias("confidence"))


def update_dynamics(scenes: DataFrame, news: DataFrame) -> DataFrame:
    """Scenes with ``dynamics`` replaced where ``news`` (base, dynamics) has one for the scene's image base."""
    keyed = scenes.withColumn("base", S.scene_name("scene_id", "best_frame"))
    return J.upsert(keyed, news, ["base"], ["dynamics"]).drop("base")


def build(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """One report a video from its scenes (struct columns as declared) in order of time."""
    fields = [c for c in scenes.columns if c not in ("video", "report_path", "recording_time")]
    order = lambda a, b: F.when(a["best_frame"] < b["best_frame"], -1).when(a["best_frame"] > b["best_frame"], 1).otherwise(a["scene_id"] - b["scene_id"])
    packed = scenes.groupBy("video").agg(F.array_sort(F.collect_list(F.struct(*fields)), order).alias("scenes"))
    return videos.join(packed, "video", "left").withColumn("scenes_found", F.coalesce(F.size("scenes"), F.lit(0)))


def write(reports: DataFrame, path: str) -> None:
    """One JSON document a line, in folders by video; a folder of another video is left as it is."""
    reports.withColumn("video_id", F.col("video")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").json(path)


def append_checkpoint(results: DataFrame, path: str, stage: str) -> None:
    """Append verdicts with their stage; ``pending`` tells what is still to do after a stop."""
    results.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("stage").parquet(path)


def pending(scenes: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    return scenes.join(done.filter(F.col("stage") == stage).select("video", "scene_id").distinct(), ["video", "scene_id"], "left_anti")


def anomaly_film(scenes: DataFrame, seconds: float = 1.0, fps: int = 10) -> DataFrame:
    """Frame list that shows each scene's original and its anomaly image after each other."""
    some = scenes.filter(F.size("dynamics.color_findings") > 0)
    window_copies = int(seconds * fps)
    base = S.scene_name("scene_id", "best_frame")
    pair = F.posexplode(F.array(F.concat(base, F.lit("_orig.jpg")), F.concat(base, F.lit("_color_anomalies.jpg"))))
    rows = some.select("video", "scene_id", "best_frame", pair.alias("part", "image"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(window_copies - 1)))).orderBy("video", "best_frame", "part", "copy")


def findings_film(scenes: DataFrame, images: DataFrame) -> DataFrame:
    """Scenes with findings, their images and overlay lines."""
    some = scenes.filter(" or ".join(f"coalesce({k}.objects_found, false)" for k in ("llm_fast", "llm_deep")))
    lines = F.transform(F.concat(*(F.coalesce(f"{k}.findings", F.expr("array()")) for k in ("llm_fast", "llm_deep"))), lambda f: S.shortened(F.concat_ws(" ", f["zone"], f["color"], f["type"]), 80))
    return some.select("video", "scene_id", S.scene_name("scene_id", "best_frame").alias("base"), lines.alias("lines")).join(images, "base", "left")

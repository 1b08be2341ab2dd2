"""Commands: ``python -m lodestrata <command> ...``; paths may be anything that Spark reads.

video, batch   pictures of one or many videos (folders of numbered frames) to scenes and verdicts
image          enhancement, anomalies and shapes of single pictures
colors, geometry   findings of scene pictures
llm            verdicts for the scenes of stored reports
report         summaries of stored reports
previews, llm-preview   frame lists of preview films
info           videos, sizes and companions below a folder
context        a mission context from a description
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import select as P
from .plans import pipeline, report, verdicts
from .sources import files, frames, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in paths:
            p.add_argument(x)
        p.add_argument("-o", "--output", help="write Parquet there instead of showing rows")
        return p

    for name in ("video", "batch"):
        p = command(name, "frames")
        p.add_argument("--telemetry", help="folder of .SRT files")
        p.add_argument("--fps", type=float, default=30.0)
        p.add_argument("--stride", default="dynamic")
        p.add_argument("--quality", type=float, default=0.5)
        p.add_argument("--scene-sim", type=float, default=0.82 if name == "video" else 0.65)
        p.add_argument("--dedup-thresh", type=float, default=0.85 if name == "video" else 0.90)
        p.add_argument("--llm-scenes-cap", default="50")
        p.add_argument("--llm-deep-max-scenes", type=int, default=20)
        p.add_argument("--llm-pipeline", choices=("fast", "chancepeek", "max"), default="fast")
        p.add_argument("--llm-run", action="store_true")
        p.add_argument("--llm-no-two-stage", action="store_true")
        p.add_argument("--llm-parallel", type=int, default=0)
        p.add_argument("--color-anomalies", action="store_true")
        p.add_argument("--helicopter", action="store_true")
        p.add_argument("--enforce-thresholds", action="store_true")
        p.add_argument("--from", dest="begin", type=float)
        p.add_argument("--to", dest="end", type=float)
        p.add_argument("--context-file")
        p.add_argument("--context-preset", choices=("sar", "sar-heli"))
    p = command("image", "images")
    p.add_argument("--variant", default="v3", choices=("orig", "v1", "v2", "v3", "v4"))
    command("colors", "images")
    command("geometry", "images")
    p = command("llm", "reports")
    p.add_argument("--llm-scenes-cap", type=int, default=100)
    p.add_argument("--llm-pipeline", choices=("fast", "max"), default="fast")
    command("report", "reports")
    command("previews", "reports")
    command("llm-preview", "reports")
    command("info", "folder")
    p = command("context", "description")
    return top


def settings_of(a: argparse.Namespace) -> pipeline.Settings:
    cap = None if a.llm_scenes_cap == "all" else int(a.llm_scenes_cap)
    return pipeline.Settings(
        stride=None if a.stride == "dynamic" else int(a.stride), quality=a.quality, scene_similarity=a.scene_sim, dedup=a.dedup_thresh, scenes_cap=cap, deep_scenes=a.llm_deep_max_scenes, mode=a.llm_pipeline,
        helicopter=a.helicopter, relax=not a.enforce_thresholds, begin=a.begin, end=a.end, two_stage=not a.llm_no_two_stage, parallel=a.llm_parallel,
    )


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command in ("video", "batch"):
        seen = pipeline.identified(files.images(spark, a.frames), a.fps)
        if a.command == "video":
            seen = seen.filter(F.col("video_id") == F.lit(a.frames.rstrip("/").rsplit("/", 1)[-1]))
        telemetry = text.read_telemetry(spark, a.telemetry) if a.telemetry else text.parse_telemetry(spark.createDataFrame([], "video_id string, value string"))
        context = text.read_contexts(spark, a.context_file) if a.context_file else text.preset(spark, a.context_preset) if a.context_preset else None
        return pipeline.analyse(spark, seen, telemetry, settings_of(a), context, judge=a.llm_run, colors=a.color_anomalies)
    if a.command == "image":
        return frames.enhanced(files.images(spark, a.images), a.variant)
    if a.command == "colors":
        return frames.color_findings(files.images(spark, a.images)).drop("mode")
    if a.command == "geometry":
        return frames.shape_findings(files.images(spark, a.images)).drop("mode")
    if a.command == "info":
        every = files.listing(spark, a.folder)
        return files.with_companions(files.videos(every), every)
    if a.command == "context":
        said = spark.createDataFrame([(text.text_or_file(a.description),)], "description string")
        return verdicts.generate_context(said, verdicts.stub, "stub")
    reports = text.read_reports(spark, a.reports)
    if a.command == "report":
        return report.summary(reports)
    scenes = report.scenes_of(reports)
    if a.command == "previews":
        return P.manifest(scenes.select(F.col("video").alias("video_id"), "scene_id", "best_frame"), 0.5, order=("best_frame", "scene_id"))
    if a.command == "llm-preview":
        return report.findings_film(scenes, spark.createDataFrame([], "base string, images map<string,string>"))
    chosen = P.step_topk(scenes, "best_frame", a.llm_scenes_cap, ["video"]).withColumn("prompt", F.concat_ws(" ", F.lit(verdicts.CONCLUDE), "video", "scene_id"))
    asked = verdicts.ask(verdicts.tasks(chosen.select("video", "scene_id", "prompt"), a.llm_pipeline == "max"), verdicts.stub, "stub")
    return verdicts.merge(verdicts.verdicts(asked, "stub"), ["video", "scene_id"])


def main() -> None:
    a = parser().parse_args()
    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    out = run(spark, a)
    if a.output:
        out.write.mode("overwrite").parquet(a.output)
    else:
        out.show(100, truncate=80)


if __name__ == "__main__":
    main()

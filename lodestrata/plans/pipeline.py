"""A video's analysis as a plan: pictures to judged scenes, over any number of videos at once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import select as P
from ..operators import stateful as O
from ..sources.frames import color_findings
from ..sources.text import preset
from . import tables as W
from . import verdicts as V


@dataclass(frozen=True)
class Settings:
    """Defaults of the command for a single video; ``light`` and ``standard`` are the named presets."""

    stride: int | None = None  # None: motion-adaptive
    quality: float = 0.5
    scene_similarity: float = 0.82
    dedup: float = 0.85  # 0: off
    scenes_cap: int | None = 50
    deep_scenes: int = 20
    mode: str = "fast"  # or chancepeek, max
    helicopter: bool = False
    relax: bool = True
    begin: float | None = None
    end: float | None = None
    two_stage: bool = True
    fast_model: str = "fast"
    deep_model: str = "deep"
    reasoning_model: str = "reason"
    parallel: int = 0

    @property
    def limits(self) -> tuple:
        return S.HELICOPTER if self.helicopter else S.DRONE

    @property
    def threshold(self) -> float:
        return min(self.quality, 0.4) if self.helicopter else self.quality

    @property
    def similarity(self) -> float:
        return min(self.scene_similarity, 0.55) if self.helicopter else self.scene_similarity

    @property
    def cap(self) -> int | None:
        return max(self.scenes_cap, 100) if self.helicopter and self.scenes_cap is not None else self.scenes_cap


BATCH = Settings(scene_similarity=0.65, dedup=0.90)


FEATURES = "video_id string, frame_idx long, shift double, sharpness double, mean double, std double, signature array<float>, histogram array<double>, fps double"


def identified(images: DataFrame, fps: float = 30.0) -> DataFrame:
    """Rows of the image source with video_id (the folder), frame_idx (the name's last number) and fps."""
    video = F.regexp_extract("origin", r"([^/]*)/[^/]*$", 1)
    frame = F.regexp_extract("origin", r"(\d+)\.[^./]*$", 1).try_cast("long")
    return images.withColumn("video_id", video).withColumn("frame_idx", frame).withColumn("fps", F.lit(float(fps))).filter("frame_idx is not null")


def scan(frames: DataFrame, settings: Settings) -> DataFrame:
    """Features of the frames that the sampler takes, in one pass over each video's pictures.

    ``frames``: video_id, frame_idx, fps, height, width, nChannels, data. Motion
    is the phase shift against the last taken frame; the state is that frame.
    """

    def step(state: dict, r: dict) -> list[tuple]:
        bgr = K.decode(bytes(r["data"]), r["height"], r["width"], r["nChannels"])
        g = K.gray(bgr)
        last = state["gray"]
        moved = None
        if last is not None and last.shape == g.shape:
            dx, dy = K.shift(last, g)
            moved = float((dx * dx + dy * dy) ** 0.5)
        take = state["sampler"].take(moved) if settings.stride is None else r["frame_idx"] % settings.stride == 0
        if not take:
            return []
        state["gray"] = g
        m = K.measures(bgr)
        return [(r["frame_idx"], moved, m["sharpness"], m["mean"], m["std"], m["signature"], m["histogram"], r["fps"])]

    some = P.time_range(frames, "frame_idx", F.col("fps"), settings.begin, settings.end)
    columns = some.select("video_id", "frame_idx", "fps", "height", "width", "nChannels", "data")
    return O.fold(columns, "video_id", ["frame_idx"], lambda: {"gray": None, "sampler": O.Sampler()}, step, lambda _: [], FEATURES)


def sampled(frames: DataFrame, settings: Settings) -> DataFrame:
    """frames (video_id, frame_idx, fps, shift, sharpness, mean, std, signature, histogram) that the sampler takes."""
    some = P.time_range(frames, "frame_idx", F.col("fps"), settings.begin, settings.end)
    if settings.stride:
        return P.stride(some, "frame_idx", settings.stride)
    return some.join(O.adaptive_sample(some, "video_id", "frame_idx", "shift").drop("stride"), ["video_id", "frame_idx"])


def scored(frames: DataFrame, settings: Settings) -> DataFrame:
    args = ("sharpness", "shift", "mean", "std", settings.limits)
    return frames.withColumn("score", S.quality(*args)).withColumn("reasons", S.quality_reasons(*args))


def passed(frames: DataFrame, settings: Settings) -> DataFrame:
    """Frames above their video's threshold, which is lowered where too few pass; with that video's similarity."""
    if not settings.relax:
        return frames.filter(F.col("score") >= settings.threshold).withColumn("similarity", F.lit(settings.similarity))
    seconds = (F.max("frame_idx") - F.min("frame_idx") + 1) / F.max("fps")
    ratio = A.relaxed(A.quality_ratio(frames, ["video_id"], F.col("score"), settings.threshold, seconds), settings.threshold, settings.similarity)
    joined = frames.join(ratio.select("video_id", "quality_threshold", "similarity_threshold"), "video_id")
    return joined.filter("score >= quality_threshold").withColumnRenamed("similarity_threshold", "similarity").drop("quality_threshold")


def scenes(frames: DataFrame, settings: Settings) -> DataFrame:
    """Scenes of each video in order of their best frame, near-duplicates merged."""
    packed = frames.withColumn("sig", F.concat(F.array(F.col("similarity").cast("float")), "signature"))
    alike = lambda a, b: O.correlation(a[1:], b[1:]) >= a[0]
    found = O.group_scenes(packed, "video_id", "frame_idx", "score", "sig", alike)
    if settings.dedup:
        hist = frames.select("video_id", F.col("frame_idx").alias("best_frame"), "histogram", "reasons")
        rich = found.join(hist, ["video_id", "best_frame"], "left")
        clusters = O.dedup_scenes(rich, "video_id", "scene", "histogram", settings.dedup)
        found = O.merged_scenes(found, clusters, "video_id", "scene")
    else:
        found = found.withColumn("merged_from", F.array("scene"))
    return P.renumber(found, "best_frame", "scene_id", ["video_id"]).drop("cluster", "scene")


def located(found: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Scenes with the telemetry of the nearest frame within 30."""
    keyed = found.withColumn("frame_num", F.col("best_frame")).withColumn("key", F.concat_ws(":", "video_id", "scene_id"))
    near = J.nearest_unique(keyed, telemetry, "key", "frame_num", ["video_id"], 30, "ordinal" if "ordinal" in telemetry.columns else None)
    return near.withColumnRenamed("match", "gps").drop("key", "frame_num")


def judged(found: DataFrame, settings: Settings, client: V.Client = V.stub, pictures: DataFrame | None = None, answers: str | None = None) -> DataFrame:
    """Scenes with a fast verdict, and a deep one where the budget reaches. Needs ``prompt`` and ``color_zones``.

    ``found`` must be a written table. ``pictures`` (video_id, scene_id and the
    image source's columns) gives the model its images. Answers are kept below
    ``answers`` (a new folder if none is given) and each is asked for once; with
    the folder of a run that was stopped, only what is missing.
    """
    by = ["video_id", "scene_id"]
    answers = answers or f"{W.shared_folder(found.sparkSession)}/answers-{uuid.uuid4().hex}"

    def answered(scenes: DataFrame, stage: str, full: bool, asker) -> DataFrame:
        rows = V.tasks(scenes.select(*by, "prompt"), full)
        shown = rows if pictures is None else V.with_images(rows, pictures, by)
        return V.asked_once(shown, by, answers, stage, lambda some: asker(some, image=None if pictures is None else "image", parallel=settings.parallel))

    good = found.filter(S.worth_asking("best_score"))
    chosen = P.spread_topk(good, "best_score", "best_frame", settings.cap, ["video_id"])
    if settings.two_stage:
        fast_asker = lambda rows, **named: V.two_stages(rows, client, settings.fast_model, settings.reasoning_model, **named)
    else:
        fast_asker = lambda rows, **named: V.ask(rows, client, settings.fast_model, **named)
    fast = V.merge(V.verdicts(answered(chosen, "fast", settings.mode == "max", fast_asker), settings.fast_model), by)
    pool = found.join(fast, by, "left")
    targets = V.deep_candidates(pool, settings.deep_scenes, ["video_id"], "best_frame", "fast" if settings.mode == "fast" else "chancepeek")
    deep = V.verdicts(answered(targets, "deep", False, lambda rows, **named: V.ask(rows, client, settings.deep_model, **named)), settings.deep_model)
    merged = V.merge(deep, ["video_id", "scene_id"]).select("video_id", "scene_id", F.struct("found", "confidence", "findings", "terrain", "variant_results", "error").alias("llm_deep"))
    return pool.join(merged, ["video_id", "scene_id"], "left")


def analyse(spark, frames: DataFrame, telemetry: DataFrame, settings: Settings, context: DataFrame | None = None, client: V.Client = V.stub, judge: bool = True, colors: bool = True, answers: str | None = None) -> DataFrame:
    """Pictures to scenes with telemetry, colour anomalies and verdicts: the whole command for any number of videos.

    ``frames`` as for ``scan``. Pictures are read once for features, which are
    written, and once more for the best frames' anomalies and the model's images;
    no picture is kept in a table. Without a context the preset for the flight
    counts. ``answers`` as for ``judged``.
    """
    features = W.written(scan(frames, settings), "features")
    good = W.written(passed(scored(features, settings), settings), "good-frames")
    rates = features.groupBy("video_id").agg(F.max("fps").alias("fps"))
    found = W.written(located(scenes(good, settings), telemetry).join(rates, "video_id"), "scenes")
    best = frames.join(found.select("video_id", "scene_id", F.col("best_frame").alias("frame_idx")), ["video_id", "frame_idx"])
    if colors:
        seen = color_findings(best.select("video_id", "frame_idx", "height", "width", "nChannels", "data"))
        found = found.join(seen.select("video_id", F.col("frame_idx").alias("best_frame"), "color_findings"), ["video_id", "best_frame"], "left")
    else:
        found = found.withColumn("color_findings", F.expr("array()"))
    found = found.withColumn("color_zones", F.coalesce(F.array_distinct(F.transform("color_findings", lambda f: f["zone"] if colors else f)).cast("array<int>"), F.array().cast("array<int>")))
    found = found.withColumn("time_str", S.minute_string("best_frame", F.col("fps"))).withColumn("exif", S.exif("gps"))
    if not judge:
        return found
    context = context if context is not None else preset(spark, "sar-heli" if settings.helicopter else "sar")
    ready = V.prompts(found.withColumn("context", F.struct(*(F.lit(v).alias(k) for k, v in context.first().asDict().items()))), "context").drop("context")
    return judged(W.written(ready, "scenes-to-judge"), settings, client, best, answers)

"""Listings of videos, companions, scene images, and image reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: File endings that count as video.
VIDEO_ENDINGS = ("mp4", "mov", "avi", "mkv", "m4v", "webm")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modified of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def stem(path="path"):
    return F.regexp_replace(S.base_name(path), r"(?<=.)\.[^.]*$", "")


def ending(path="path"):
    return F.lower(F.regexp_extract(S.base_name(path), r"\.([^.]*)$", 1))


def folder(path="path"):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def videos(files: DataFrame) -> DataFrame:
    """Files with a video's ending, their id and size."""
    return files.filter(ending().isin(*VIDEO_ENDINGS)).select("path", stem().alias("video_id"), "length", S.megabytes("length").alias("size_mb"))


def with_companions(found: DataFrame, files: DataFrame) -> DataFrame:
    """Videos with the paths of the ``.srt`` and ``.xml`` files of the same folder and stem."""
    other = files.filter(ending().isin("srt", "xml")).select(folder().alias("f"), stem().alias("s"), "path")
    grouped = other.groupBy("f", "s").agg(F.sort_array(F.collect_set("path")).alias("companions"))
    keyed = found.withColumn("f", folder()).withColumn("s", F.col("video_id"))
    return keyed.join(grouped, ["f", "s"], "left").drop("f", "s").withColumn("companions", F.coalesce("companions", F.array().cast("array<string>")))


def report_folders(files: DataFrame) -> DataFrame:
    """Folders that hold a ``report.json``."""
    return files.filter(S.base_name("path") == "report.json").select(folder().alias("folder")).distinct()


def scene_images(files: DataFrame) -> DataFrame:
    """Scene images with place (hq, lq or root), scene, frame and variant; other files are left out."""
    parts = lambda k: F.regexp_extract(S.base_name("path"), r"^(scene_(\d+)_f(\d+))_(?:grid_)?(orig|v[1-4])\.jpg$", k)
    near = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    place = F.when(near.isin("hq", "lq"), near).otherwise("root")
    found = files.select("path", place.alias("place"), parts(1).alias("base"), parts(2).try_cast("int").alias("scene"), parts(3).try_cast("long").alias("frame"), parts(4).alias("variant"))
    return found.filter("base != ''")


def scene_files(scenes: DataFrame, images: DataFrame, key: str = "base") -> DataFrame:
    """Each scene's images as a map variant -> path; of several places hq goes before lq before root."""
    rank = F.when(F.col("place") == "hq", 0).when(F.col("place") == "lq", 1).otherwise(2)
    best = images.groupBy(key, "variant").agg(F.min(F.struct(rank.alias("r"), "path")).alias("b"))
    maps = best.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("variant", "b.path")))).alias("images"))
    return scenes.join(maps, key, "left")


def originals(images: DataFrame) -> DataFrame:
    """Original images of hq and lq in chronological order."""
    return images.filter("variant = 'orig' and place in ('hq', 'lq')").orderBy("scene", "frame", "path")


def images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, nChannels, data (rows of BGR bytes); files that are no image are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")

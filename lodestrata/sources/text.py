"""Telemetry text, JSON reports and mission contexts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

_NUMBERS = (("lat", "latitude"), ("lon", "longitude"), ("rel_alt", "rel_alt"), ("abs_alt", "abs_alt"), ("yaw", "gb_yaw"), ("pitch", "gb_pitch"), ("roll", "gb_roll"), ("focal_len", "focal_len"), ("dzoom_ratio", "dzoom_ratio"), ("distance", "distance"), ("speed", "speed"))


def parse_telemetry(files: DataFrame, key: str = "video_id", text: str = "value") -> DataFrame:
    """One row a (key, frame_num) of subtitle texts; blocks without a frame number or any field are left out.

    A number that can't be read is null and spoils nothing else. Of a frame's
    several blocks the last one stays; ``ordinal`` is the block's place.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    blocks = files.select(key, F.posexplode(F.split(trimmed, r"\n\s*\n")).alias("ordinal", "block"))
    number = lambda name: F.regexp_extract("block", rf"{name}:\s*(-?[\d.]+)", 1).try_cast("double")
    stamp = r"(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})"
    part = lambda k: F.nullif(F.regexp_extract("block", stamp, k), F.lit(""))
    rows = blocks.select(key, "ordinal", F.regexp_extract("block", r"FrameCnt:\s*(\d+)", 1).try_cast("long").alias("frame_num"), part(1).alias("date"), part(2).alias("time"), F.concat_ws(" ", part(1), part(2)).alias("datetime"), *(number(n).alias(c) for c, n in _NUMBERS))
    rows = rows.withColumn("datetime", F.nullif("datetime", F.lit("")))
    fields = [c for c in rows.columns if c not in (key, "ordinal", "frame_num")]
    some = rows.filter("frame_num is not null").filter(F.coalesce(*(F.col(c).cast("string") for c in fields)).isNotNull())
    last = some.groupBy(key, "frame_num").agg(F.max_by(F.struct("ordinal", *fields), "ordinal").alias("r"))
    return last.select(key, "frame_num", "r.*")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """All ``.SRT``/``.srt`` files below ``path``; the video's id is the file's stem."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][rR][tT]").text(path, wholetext=True)
    return parse_telemetry(files.withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^./]*$", 1)))


def recording_time(telemetry_datetime, xml_text, file_name):
    """From telemetry, else the companion XML's creation date, else 14 digits in the file name, else null."""
    xml = F.regexp_extract(F.coalesce(xml_text, F.lit("")), r'CreationDate\s+value="(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})', 1)
    clock = F.regexp_extract(F.coalesce(xml_text, F.lit("")), r'CreationDate\s+value="(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})', 2)
    digits = F.regexp_extract(file_name, r"(\d{14})", 1)
    named = F.when(digits != "", F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6"))
    return F.coalesce(telemetry_datetime, F.when(xml != "", F.concat_ws(" ", xml, clock)), named)


def first_recording_times(telemetry: DataFrame, key: str = "video_id", frames: int = 5) -> DataFrame:
    """The date and time of the first of each video's first frames that has one."""
    # a task keeps its first frames of a video before they meet
    place = F.row_number().over(Window.partitionBy(key).orderBy("frame_num", "datetime"))
    firsts = telemetry.select(key, "frame_num", "datetime", place.alias("k")).filter(F.col("k") <= frames)
    return firsts.groupBy(key).agg(F.min_by("datetime", F.when(F.col("datetime").isNotNull(), F.col("k"))).alias("recorded"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All ``report.json`` below ``path`` (globs too) by the declared schema, with ``report_path``; unreadable ones are left out."""
    found = spark.read.schema(schemas.REPORT + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").json(path)
    return found.withColumn("report_path", F.input_file_name()).filter("_corrupt is null").drop("_corrupt")


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Mission contexts; all fields may be missing, and the name is the file's stem then."""
    raw = spark.read.schema(schemas.CONTEXT).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^./]*$", 1)
    fields = [c.split()[0] for c in schemas.CONTEXT.split(", ")]
    return raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in fields if c != "name"), F.coalesce("name", stem).alias("name"))


#: Built-in contexts, in our own words.
_SEARCH = {
    "context": "Aerial footage of open country where a person may be missing.",
    "natural_list": "stone, scree, snow, grass, shrubs, shadow",
    "priority_signals": "colours and straight edges that the ground does not have",
    "target_objects": "clothing, rucksack, rope, tent, person",
    "platform_notes": "",
    "color_shift_notes": "",
}
_ON_BOARD = "Filmed through a cabin window: expect reflections, vibration and parts of the aircraft."


def preset(spark: SparkSession, name: str) -> DataFrame:
    """A built-in context as one row: ``sar``, or ``sar-heli`` with notes on the aircraft."""
    if name not in ("sar", "sar-heli"):
        raise ValueError(f"no context is called {name}")
    fields = _SEARCH | {"platform_notes": _ON_BOARD if name == "sar-heli" else "", "name": name}
    return spark.createDataFrame([tuple(fields.values())], schemas.CONTEXT)


def resolve_context(rows: DataFrame, *candidates: str):
    """The first candidate context column (a struct) with any field that isn't empty."""
    some = lambda c: F.coalesce(*(F.nullif(F.col(f"{c}.{f}"), F.lit("")) for f in _SEARCH))
    return rows.withColumn("resolved", F.coalesce(*(F.when(some(c).isNotNull(), F.col(c)) for c in candidates)))


def text_or_file(argument: str) -> str:
    """The file's text if the argument names one, else itself."""
    try:
        return Path(argument).read_text(encoding="utf-8") if Path(argument).is_file() else argument
    except OSError:
        return argument

"""Scalar functions over columns. All are built-in expressions; none is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings of a scene's image variants, in order.
VARIANTS = ("orig", "v1", "v2", "v3", "v4")
#: Colour words that raise a scene's priority.
TARGET_COLORS = ("orange", "bright orange", "reddish-orange", "blue", "dark blue", "blue-grey", "black", "dark grey", "dark gray", "dark brown")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- names -----------------------------------------------------------------


def base_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def scene_of(path, default: int = 0) -> Column:
    """Scene number of ``scene_<n>_f<m>...``; ``default`` for other names (999999 sorts them last)."""
    found = F.regexp_extract(base_name(path), r"^scene_(\d+)_f(\d+)", 1)
    return F.coalesce(found.try_cast("long"), F.lit(default).cast("long"))


def frame_of(path) -> Column:
    found = F.regexp_extract(base_name(path), r"^scene_(\d+)_f(\d+)", 2)
    return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))


def scene_name(scene, frame) -> Column:
    return F.format_string("scene_%02d_f%05d", col(scene), col(frame))


def variant_name(scene, frame, variant: str) -> Column:
    return F.concat(scene_name(scene, frame), F.lit("_orig.jpg" if variant == "orig" else f"_grid_{variant}.jpg"))


def canonical_base(path) -> Column:
    """File name without its extension and a trailing ``_orig``."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", ""), r"_orig$", "")


def zone_number(text) -> Column:
    """The first run of digits, if it is 1 to 9."""
    n = F.regexp_extract(F.coalesce(col(text).cast("string"), F.lit("")), r"(\d+)", 1).try_cast("int")
    return F.when(n.between(1, 9), n)


def is_helicopter(path) -> Column:
    return F.upper(col(path)).contains("HELI")


# --- time ------------------------------------------------------------------


def timecode(frame, fps) -> Column:
    """``HH:MM:SS.cc`` of a frame; hundredths are what double arithmetic gives, truncated: frame 29 at 25 a second is ``.15``."""
    sec = col(frame) / col(fps)
    whole = F.floor(sec)
    cs = F.floor((sec - whole) * 100)
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)), cs)


def minute_string(frame, fps) -> Column:
    """``MM:SS.ss``; minutes go on beyond 59. Hundredths are rounded first, halves away from zero."""
    hundredths = F.round(col(frame) * 100 / col(fps)).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(hundredths / 6000), F.pmod(F.floor(hundredths / 100), F.lit(60)), F.pmod(hundredths, F.lit(100)))


def duration_string(seconds) -> Column:
    """``HH:MM:SS.ss`` of a duration."""
    hundredths = F.round(col(seconds) * 100).cast("long")
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(hundredths / 360000), F.pmod(F.floor(hundredths / 6000), F.lit(60)), F.pmod(F.floor(hundredths / 100), F.lit(60)), F.pmod(hundredths, F.lit(100)))


def megabytes(size) -> Column:
    return F.round(col(size) / 1e6, 1)


def absolute_time(recorded, seconds, is_utc=False) -> Column:
    """Recording time plus seconds, ``n/a`` where it can't be read; ``UTC`` only where the zone is known."""
    at = F.expr("cast(null as timestamp_ntz)") if recorded is None else F.try_to_timestamp(col(recorded), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    moved = at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(col(seconds)).cast("decimal(18,6)"))
    text = F.date_format(moved, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(text, F.when(F.lit(is_utc), " UTC").otherwise("")), F.lit("n/a"))


# --- places ----------------------------------------------------------------


def dms(value) -> Column:
    """Degrees, minutes and ten-thousandths of seconds of a coordinate's absolute value."""
    v = F.abs(col(value))
    d = F.floor(v)
    m = F.floor((v - d) * 60)
    return F.struct(d.cast("long").alias("d"), m.cast("long").alias("m"), F.floor(((v - d) * 60 - m) * 60 * 10000).cast("long").alias("s"))


def exif(gps, description_text=None) -> Column:
    """Metadata of an image from its telemetry: position as degrees, minutes and seconds, height, lens and time; null without a position."""
    g = col(gps)
    fields = F.struct(
        dms(g["lat"]).alias("latitude"), hemisphere(g["lat"], "N", "S").alias("latitude_ref"), dms(g["lon"]).alias("longitude"), hemisphere(g["lon"], "E", "W").alias("longitude_ref"),
        F.round(F.abs(g["abs_alt"]) * 100).cast("long").alias("altitude_cm"), F.when(g["abs_alt"] < 0, 1).otherwise(0).alias("altitude_ref"), g["datetime"].alias("taken"),
        F.round(g["focal_len"] * 100).cast("long").alias("focal_length_hundredths"), F.round(g["dzoom_ratio"] * 100).cast("long").alias("zoom_hundredths"),
        (F.lit(None).cast("string") if description_text is None else col(description_text)).alias("description"),
    )
    return F.when(g["lat"].isNotNull() & g["lon"].isNotNull(), fields)


def telemetry_lines(gps) -> Column:
    """Labels of a frame's telemetry, one value a line; missing ones are left out."""
    g = col(gps)
    number = lambda name, c, digits, unit="": F.when(g[c].isNotNull(), F.concat(F.lit(name + " "), F.format_number(g[c], digits), F.lit(unit)))
    place = F.when(g["lat"].isNotNull() & g["lon"].isNotNull(), F.concat(F.lit("GPS "), F.format_number(g["lat"], 6), F.lit(", "), F.format_number(g["lon"], 6)))
    return F.concat_ws("\n", place, number("Alt", "abs_alt", 1, " m"), number("Above start", "rel_alt", 1, " m"), number("Yaw", "yaw", 1), number("Pitch", "pitch", 1), number("Roll", "roll", 1), number("Focal length", "focal_len", 1, " mm"), number("Zoom", "dzoom_ratio", 1, "x"), number("Distance", "distance", 1, " m"), number("Speed", "speed", 1, " m/s"))


def hemisphere(value, positive: str, negative: str) -> Column:
    return F.when(col(value) >= 0, positive).when(col(value) < 0, negative)


def zone_of(x, y, width, height, default: int = 5) -> Column:
    """Zone 1 to 9 of a point in a 3 x 3 grid; the last row and column take the remainder. ``default`` outside."""

    def third(v, size):
        return F.when(v < F.floor(size / 3), 0).when(v < F.floor(size * 2 / 3), 1).otherwise(2)

    x, y, w, h = col(x), col(y), col(width), col(height)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return F.when(inside, third(y, h) * 3 + third(x, w) + 1).otherwise(default)


def in_working_area(x, y, height, top: int = 100, bottom: int = 30, left: int = 250) -> Column:
    """Outside the overlay margins; there is no right margin."""
    return (col(x) >= left) & (col(y) >= top) & (col(y) < col(height) - bottom)


def iou(a, b) -> Column:
    """Intersection over union of two boxes (struct x, y, w, h); the union counts as 1 at least."""
    a, b = col(a), col(b)
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return inter / F.greatest(a["w"] * a["h"] + b["w"] * b["h"] - inter, F.lit(1))


def line_angle(x1, y1, x2, y2) -> Column:
    return F.pmod(F.degrees(F.atan2(col(y2) - col(y1), col(x2) - col(x1))), F.lit(180.0))


def line_length(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x2) - col(x1), col(y2) - col(y1))


def vector_angle(ax, ay, bx, by) -> Column:
    """Degrees between two vectors."""
    dot = col(ax) * col(bx) + col(ay) * col(by)
    size = F.hypot(ax, ay) * F.hypot(bx, by) + 1e-10
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size))))


def circularity(area, perimeter) -> Column:
    return F.when(col(perimeter) < 1, 0.0).otherwise(4 * math.pi * col(area) / (col(perimeter) * col(perimeter)))


def lines_alike(a, b, angle: float = 10.0) -> Column:
    """Near-parallel, close and overlapping along their direction: structs angle, length, cx, cy."""
    a, b = col(a), col(b)
    off = F.abs(a["angle"] - b["angle"])
    rad = F.radians(a["angle"])
    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    apart = F.abs(dy * F.cos(rad) - dx * F.sin(rad))
    along = dx * F.cos(rad) + dy * F.sin(rad)
    overlap = F.least(a["length"] / 2, along + b["length"] / 2) - F.greatest(-a["length"] / 2, along - b["length"] / 2)
    return (F.least(off, 180 - off) <= angle) & (apart < F.greatest(F.lit(8.0), F.least(a["length"], b["length"]) * 0.15)) & (overlap > 0)


# --- polygons (array of struct x, y) ---------------------------------------


def _turns(points) -> Column:
    """Length of the side after each vertex and the turn at it."""
    p = col(points)
    n = F.size(p)
    at = lambda i: F.get(p, F.pmod(i + n, n))

    def corner(_, i):
        a, b, c = at(i - 1), at(i), at(i + 1)
        return F.struct(
            F.hypot(c["x"] - b["x"], c["y"] - b["y"]).alias("side"),
            vector_angle((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double"), (c["x"] - b["x"]).cast("double"), (c["y"] - b["y"]).cast("double")).alias("turn"),
        )

    return F.transform(p, corner)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _spread(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def regularity(points) -> Column:
    """1 / (1 + 2 cv(sides) + 2 cv(turns)), 0 for fewer than three points or a mean side below 1."""
    t = _turns(points)
    sides, turns = F.transform(t, lambda x: x["side"]), F.transform(t, lambda x: x["turn"])
    value = 1 / (1 + 2 * _spread(sides) / _mean(sides) + 2 * _spread(turns) / (_mean(turns) + 1e-10))
    return F.when(F.size(col(points)) < 3, 0.0).when(_mean(sides) < 1, 0.0).otherwise(F.least(F.lit(1.0), value))


def right_angles(points, tolerance: float = 12.0) -> Column:
    return F.when(F.size(col(points)) < 3, 0).otherwise(F.size(F.filter(_turns(points), lambda x: F.abs(x["turn"] - 90) < tolerance)))


def side_ratio(points) -> Column:
    sides = F.transform(_turns(points), lambda x: x["side"])
    return F.array_min(sides) / F.greatest(F.array_max(sides), F.lit(1e-10))


def shape(area, perimeter, points, rect_score) -> Column:
    """struct(shape, score): circle, line, triangle, square or rectangle, regular polygon, or nulls, in that order."""
    a, per, p, rect = col(area), col(perimeter), col(points), col(rect_score)
    n, circ, reg, right = F.size(p), circularity(area, perimeter), regularity(points), right_angles(points)
    first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    made = lambda name, score: F.struct((F.lit(name) if isinstance(name, str) else name).alias("shape"), score.cast("double").alias("score"))
    none = F.struct(F.lit(None).cast("string").alias("shape"), F.lit(0.0).alias("score"))
    return (
        F.when((a < 80) | (per < 1), none)
        .when((circ > 0.88) & (n >= 6), made("circle", F.least(F.lit(1.0), circ)))
        .when(n == 2, made("line", F.least(F.lit(1.0), F.hypot(second["x"] - first["x"], second["y"] - first["y"]) / 100)))
        .when(n == 3, made("triangle", reg * 0.7 + right / 3 * 0.3))
        .when((n == 4) & (rect > 0.85), made(F.when(side_ratio(points) > 0.85, "square").otherwise("rectangle"), rect * 0.5 + right / 4 * 0.3 + reg * 0.2))
        .when((n >= 5) & (reg > 0.75), made(F.concat(F.lit("polygon-"), n.cast("string")), reg))
        .otherwise(none)
    )


# --- arrays ----------------------------------------------------------------


def correlation(a, b) -> Column:
    """Normalised cross-correlation of two signatures; 0 when either is constant."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    ma, mb = _mean(a), _mean(b)
    ca, cb = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    na, nb = (F.sqrt(total(F.transform(v, lambda x: x * x))) for v in (ca, cb))
    return F.when((na < 1e-6) | (nb < 1e-6), 0.0).otherwise(total(F.zip_with(ca, cb, lambda x, y: x * y)) / (na * nb))


def histogram_intersection(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def l1_normalised(a) -> Column:
    total = F.aggregate(F.transform(col(a), lambda x: F.abs(x).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.transform(col(a), lambda x: F.abs(x).cast("double") / F.greatest(total, F.lit(1e-12)))


# --- scores ----------------------------------------------------------------

#: Quality thresholds (blur severe, soft, ok; shift fast, moderate; dark, bright, contrast).
DRONE = (50, 100, 200, 30, 15, 20, 240, 20)
HELICOPTER = (30, 60, 120, 60, 35, 10, 245, 12)


def quality(sharpness, shift, mean, std, limits: tuple = DRONE) -> Column:
    """Product of penalties for blur, motion (null for a first frame), exposure and contrast."""
    severe, soft, ok, fast, moderate, dark, bright, contrast = limits
    lap, mag, mb, sd = col(sharpness), col(shift), col(mean), col(std)
    blur = F.when(lap < severe, 0.3).when(lap < soft, 0.6).when(lap < ok, 0.85).otherwise(1.0)
    move = F.when(mag > fast, 0.5).when(mag > moderate, 0.75).otherwise(1.0)
    light = F.when(mb < dark, 0.2).when(mb > bright, 0.4).when(mb > 220, 0.8).otherwise(1.0)
    return blur * move * light * F.when(sd < contrast, 0.5).otherwise(1.0)


def quality_reasons(sharpness, shift, mean, std, limits: tuple = DRONE) -> Column:
    severe, soft, ok, fast, moderate, dark, bright, contrast = limits
    lap, mag, mb, sd = col(sharpness), col(shift), col(mean), col(std)
    tag = lambda name, v, unit="": F.concat(F.lit(f"{name}("), F.format_string("%d", F.bround(v).cast("long")), F.lit(f"{unit})"))
    return F.array_compact(
        F.array(
            F.when(lap < severe, tag("blurry", lap)).when(lap < soft, tag("soft", lap)).when(lap < ok, tag("ok", lap)),
            F.when(mag > fast, tag("fast_move", mag, "px")).when(mag > moderate, tag("move", mag, "px")),
            F.when(mb < dark, "dark").when(mb > bright, "overexposed").when(mb > 220, "bright"),
            F.when(sd < contrast, tag("low_contrast", sd)),
        )
    )


def color_name(a, b) -> Column:
    """Name of a colour from LAB a and b (centred at 128); the first rule that holds decides."""
    a, b = col(a) - 128, col(b) - 128
    return (
        F.when((a < -5) & (b < 15), "blue")
        .when((a > 20) & (b > 10), "orange")
        .when((a > 5) & (b > 25), "yellow")
        .when((a > 20) & (b < 10), "red")
        .when((a < -10) & (b > 10), "green")
        .when((a > 15) & (b < -5), "magenta")
        .otherwise("unknown")
    )


def color_confidence(colorfulness, rarity, compactness) -> Column:
    return F.least(F.lit(1.0), col(colorfulness) / 80 * 0.3 + F.least(col(rarity) / 5, F.lit(1.0)) * 0.4 + col(compactness) * 0.3)


def shape_confidence(score, area) -> Column:
    return F.least(F.lit(1.0), col(score) * 0.7 + F.least(F.lit(1.0), col(area) / 500) * 0.3)


def is_positive(found, confidence) -> Column:
    """A verdict counts if something was found or its confidence is above 0.4; a missing one doesn't."""
    return F.coalesce(col(found), F.lit(False)) | (F.coalesce(col(confidence), F.lit(0.0)) > 0.4)


def worth_asking(score) -> Column:
    """Whether a scene's best score is enough for a model to look at it."""
    return col(score) >= 0.4


def has_target_color(color) -> Column:
    low = F.lower(F.coalesce(col(color), F.lit("")))
    out = F.lit(False)
    for word in TARGET_COLORS:
        out |= low.contains(word)
    return out


def priority(findings, color_zones) -> Column:
    """2 a finding, 5 a target colour, 3 x confidence, 4 a zone that colour anomalies share.

    ``findings`` is array<struct<zone:string,color:string,confidence:double,...>>,
    ``color_zones`` array<int>.
    """
    f = F.coalesce(col(findings), F.expr("array()"))
    each = F.aggregate(f, F.lit(0.0), lambda s, x: s + 2 + F.when(has_target_color(x["color"]), 5.0).otherwise(0.0) + F.coalesce(x["confidence"], F.lit(0.0)) * 3)
    zones = F.array_distinct(F.filter(F.transform(f, lambda x: x["zone"]), lambda z: z != ""))
    shared = F.array_intersect(zones, F.transform(F.coalesce(col(color_zones), F.expr("array()")), lambda z: F.concat(F.lit("Z"), z.cast("string"))))
    return each + F.size(shared) * 4.0


# --- text ------------------------------------------------------------------


def json_span(text) -> Column:
    """From the first ``{`` to the last ``}``, else null."""
    found = F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parsed(text, schema: str) -> Column:
    """struct(result, raw): the JSON span by ``schema``, or the first 3000 characters where there is none."""
    result = F.from_json(json_span(text), schema)
    return F.struct(result.alias("result"), F.when(result.isNull(), F.substring(col(text), 1, 3000)).alias("raw"))


def labelled_lines(*pairs) -> Column:
    """``label: value`` for each value that is neither null nor empty, one a line."""
    return F.concat_ws("\n", *(F.when(F.coalesce(col(v), F.lit("")) != "", F.concat(F.lit(f"{k}: "), col(v))) for k, v in pairs))


def description(*parts) -> Column:
    """Parts that are not null, joined by `` | ``."""
    return F.concat_ws(" | ", *parts)


def shortened(text, n: int) -> Column:
    return F.substring(col(text), 1, n)


def text_or_empty(value) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(""))

"""Joins: nearest key within a tolerance, zones, anti/semi/status, upsert and priority lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def nearest_unique(left: DataFrame, right: DataFrame, key: str, on: str, by: Sequence[str] = (), tolerance: int = 30, ordinal: str | None = None) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` whose ``on`` is nearest, ``tolerance`` inclusive; ``key`` tells the rows of ``left`` apart.

    The exact key wins; of equally near ones that with the smaller ``ordinal``
    (``on`` if none is given). Keys are cut into bands of ``tolerance + 1``; a
    match lies in a row's own band or a neighbour, so this is an equi-join on
    (by, band) with the right side tripled, and the pick is an aggregate with a
    map-side combine, never a sort of a whole stream. Columns of ``right`` come
    as the struct ``match``, null without one.
    """
    by, width = list(by), tolerance + 1
    r = right.select(*by, F.struct(*right.columns).alias("__row"), F.col(on).alias("__key"), F.col(ordinal or on).alias("__tie"))
    r = r.withColumn("__band", F.explode(F.array(*(F.floor(F.col("__key") / width) + k for k in (-1, 0, 1)))))
    l_ = left.withColumn("__band", F.floor(F.col(on) / width)).withColumnRenamed(on, "__at")
    joined = l_.join(r, [*by, "__band"], "left")
    off = F.abs(F.col("__at") - F.col("__key"))
    best = F.min_by(F.when(off <= tolerance, F.col("__row")), F.when(off <= tolerance, F.struct(off, "__tie")))
    rest = [c for c in left.columns if c not in (key, on)]
    out = joined.groupBy(key).agg(F.any_value("__at").alias(on), *(F.any_value(c).alias(c) for c in rest), best.alias("match"))
    return out.select(*left.columns, "match")


def with_zone(points: DataFrame, x: str, y: str, width: int, height: int, name: str = "zone") -> DataFrame:
    """The point-in-rectangle join with the 3 x 3 grid, in closed form."""
    return points.withColumn(name, S.zone_of(x, y, F.lit(width), F.lit(height)))


def iou_pairs(boxes: DataFrame, group: str, ident: str, box: str, threshold: float = 0.3, cell: int = 64) -> DataFrame:
    """Pairs (a < b) of a group whose boxes overlap by more than ``threshold``.

    Boxes meet in the grid cells that they touch, an equi-join on (group, cell);
    the pair is kept in the cell of its overlap's corner only, so it comes once.
    """
    b = F.col(box)
    lo = lambda axis: F.floor(b[axis] / cell)
    hi = lambda axis, size: F.floor((b[axis] + b[size]) / cell)
    cells = boxes.select(group, ident, box, F.explode(F.sequence(lo("x"), hi("x", "w"))).alias("cx"), lo("y").alias("y0"), hi("y", "h").alias("y1"))
    cells = cells.select(group, ident, box, "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    a, c = cells.alias("a"), cells.alias("b")
    corner = lambda axis: F.floor(F.greatest(F.col(f"a.{box}")[axis], F.col(f"b.{box}")[axis]) / cell)
    pairs = a.join(c, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")))
    pairs = pairs.filter((F.col("a.cx") == corner("x")) & (F.col("a.cy") == corner("y")))
    return pairs.select(F.col(f"a.{group}").alias(group), F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"), S.iou(f"a.{box}", f"b.{box}").alias("iou")).filter(F.col("iou") > threshold)


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def selected(items: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    return items.join(wanted.select(*key).distinct(), list(key), "left_semi")


def with_status(items: DataFrame, reports: DataFrame, key: str, column: str, missing: str = "NOT ANALYZED") -> DataFrame:
    """Left join with a status for items that have no report."""
    return items.join(reports.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def upsert(base: DataFrame, news: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``base`` with ``columns`` replaced where ``news`` has a value; unmatched news are left out."""
    other = news.select(*key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    out = base.join(other, list(key), "left")
    return out.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def by_priority(items: DataFrame, candidates: DataFrame, key: str, rank: str, value: str, partition: Sequence[str] = ()) -> DataFrame:
    """Left join with the candidate of smallest ``rank`` for each key (and ``partition``); ties go to the smaller value."""
    best = candidates.groupBy(key, *partition).agg(F.min(F.struct(rank, value)).alias("__best"))
    return items.join(best, key, "left").withColumn(value, F.col(f"__best.{value}")).withColumn(rank, F.col(f"__best.{rank}")).drop("__best")


def regroup(tasks: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Results of a batch back to their (video, scene, variant)."""
    return tasks.join(results, list(key), "inner")


def keep_last(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, as a later write replaces an earlier one."""
    window = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(window)).filter("__r = 1").drop("__r")

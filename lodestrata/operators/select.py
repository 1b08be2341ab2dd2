"""Ranked, spread and budgeted picks, and renumbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: Sequence[str], *order) -> Window:
    # an unpartitioned pick ranks a single video's scenes
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)


def spread_topk(rows: DataFrame, score: str, time: str, k: int | None, by: Sequence[str] = (), ident: str | None = None) -> DataFrame:
    """``k`` rows spread over time among the ``2k`` best.

    Of the best ``2k`` by score (ties: earlier ``ident``) in order of time, those
    at ``floor(i (n - 1) / (k - 1))`` for i from 0 to k - 1. All rows if there
    are at most ``k`` or ``k`` is None; the best one if ``k`` is 1; none if 0.
    Without ``by`` the ``2k`` best are found by a distributed top-k, not a sort.
    """
    if k is None:
        return rows
    if k <= 0:
        return rows.limit(0)
    tie = ident or time
    if k == 1:
        return top(rows, [F.desc(score), F.asc(tie)], 1, by)
    if by:
        best = rows.withColumn("__rank", F.row_number().over(_over(by, F.desc(score), F.asc(tie)))).filter(F.col("__rank") <= 2 * k).drop("__rank")
    else:
        best = rows.orderBy(F.desc(score), F.asc(tie)).limit(2 * k)
    placed = best.withColumn("__i", F.row_number().over(_over(by, F.asc(time), F.asc(tie))) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(0)]))))
    step = F.col("__n") - 1
    # i is picked if some j has floor(j (n - 1) / (k - 1)) = i
    j = F.ceil(F.col("__i") * (k - 1) / step)
    hit = F.when(F.col("__n") <= k, True).otherwise((j <= k - 1) & (F.floor(j * step / (k - 1)) == F.col("__i")))
    return placed.filter(hit).drop("__i", "__n")


def step_topk(rows: DataFrame, time: str, k: int, by: Sequence[str] = (), step: int | None = None) -> DataFrame:
    """Every ``step``-th row in order of time, the first ``k`` of them; ``step`` is ``max(1, n div k)`` if not given."""
    if k <= 0:
        return rows.limit(0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(0)])))
    placed = rows.withColumn("__i", F.row_number().over(_over(by, F.asc(time))) - 1).withColumn("__s", F.lit(step).cast("long") if step else F.greatest(F.lit(1), F.floor(n / k)))
    return placed.filter((F.pmod("__i", "__s") == 0) & (F.floor(F.col("__i") / F.col("__s")) < k)).drop("__i", "__s")


def top(rows: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("__r", F.row_number().over(_over(by, *order))).filter(F.col("__r") <= k).drop("__r")


def budget_topk(rows: DataFrame, score: str, time: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows of highest score, ties to the earlier; the order of the result is time's."""
    return top(rows, [F.desc(score), F.asc(time)], k, by).orderBy(*by, time)


def renumber(rows: DataFrame, time: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 0 in order of time."""
    return rows.withColumn(name, (F.row_number().over(_over(by, F.asc(time))) - 1).cast("long"))


def grid_place(rows: DataFrame, order: str, columns: int, by: Sequence[str] = (), width: int = 480, height: int = 270) -> DataFrame:
    """Row, column and pixel corner of each item of a contact sheet."""
    placed = renumber(rows, order, "__p", by)
    r, c = F.floor(F.col("__p") / columns).cast("long"), F.pmod("__p", F.lit(columns)).cast("long")
    return placed.withColumn("grid_row", r).withColumn("grid_col", c).withColumn("x", c * width).withColumn("y", r * height).drop("__p")


def stride(rows: DataFrame, index: str, n: int) -> DataFrame:
    """Every ``n``-th frame by absolute index."""
    return rows.filter(F.pmod(F.col(index), F.lit(n)) == 0)


def time_range(rows: DataFrame, index: str, fps: Column, begin: float | None, end: float | None) -> DataFrame:
    """Frames of the half-open range ``[int(begin fps), int(end fps))``."""
    if begin is not None:
        rows = rows.filter(F.col(index) >= F.floor(fps * begin))
    if end is not None:
        rows = rows.filter(F.col(index) < F.floor(fps * end))
    return rows


def manifest(scenes: DataFrame, seconds: float, fps: int = 10, order: Sequence[str] = ("scene",)) -> DataFrame:
    """Frame list of a preview film: each image ``int(fps seconds)`` times, in order."""
    window = Window.partitionBy("video_id").orderBy(*order)
    copies = int(fps * seconds)
    numbered = scenes.withColumn("__p", F.row_number().over(window) - 1)
    return numbered.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("film_frame", F.col("__p") * copies + F.col("__c")).drop("__p", "__c")


def positives_then_negatives(rows: DataFrame, positive: Column) -> DataFrame:
    """All rows with ``source_rank`` 0 for positive and 1 for other ones: a union with positives first."""
    return rows.withColumn("source_rank", F.when(positive, 0).otherwise(1))

"""Roll-ups: best frames, zones, rarity, verdicts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_frame(frames: DataFrame, by: Sequence[str], score: str, frame: str) -> DataFrame:
    """Best score of each group, the first frame that has it, the count and the range of frames."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(frame)).alias("f")))
    return frames.groupBy(*by).agg(best.alias("__best"), F.count(F.lit(1)).alias("n_frames"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame")).select(
        *by, F.col("__best.s").alias("best_score"), (-F.col("__best.f")).alias("best_frame"), "n_frames", "first_frame", "last_frame"
    )


def zone_maxima(findings: DataFrame, by: Sequence[str], zone: str, confidence: str) -> DataFrame:
    """Largest confidence of each group and zone 1 to 9."""
    return findings.filter(F.col(zone).between(1, 9)).groupBy(*by, zone).agg(F.max(confidence).alias("max_confidence"))


def dynamics(findings: DataFrame, by: Sequence[str], zone: str, confidence: str) -> DataFrame:
    """Anomaly score, per-zone maxima as a map ``Z<n>``, and the flagged zones in order."""
    zones = findings.groupBy(*by, zone).agg(F.max(confidence).alias("__m"))
    return zones.groupBy(*by).agg(
        F.round(F.max("__m"), 4).alias("anomaly_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("Z"), F.col(zone).cast("string")), F.round("__m", 4))))).alias("zone_scores"),
        F.sort_array(F.collect_set(zone)).alias("flagged_zones"),
    )


def histogram(rows: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    return rows.groupBy(*by, a.alias("a_bin"), b.alias("b_bin")).agg(F.count(F.lit(1)).alias("n"))


def smoothed(bins: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """3 x 3 smoothing with weights [1 2 1] / 4 each way and mirrored edges (-1 is 1, ``size`` is ``size - 2``).

    Every bin adds to its neighbours, so this is one explode and one aggregate over bins.
    """
    mirror = lambda c: F.when(c < 0, -c).when(c > size - 1, 2 * (size - 1) - c).otherwise(c)
    parts = []
    # a target t reads mirror(t + d) for d in -1, 0, 1: the sources of t are found from the target's side
    for da in (-1, 0, 1):
        for db in (-1, 0, 1):
            parts.append(F.struct(F.lit(da).alias("da"), F.lit(db).alias("db"), F.lit((2 - abs(da)) * (2 - abs(db)) / 16).alias("w")))
    spread = bins.withColumn("__p", F.explode(F.array(*parts)))
    # (target, offset) pairs for which mirror(target + offset) is this bin: the plain one and those past an edge
    plain = spread.select(*by, (F.col("a_bin") - F.col("__p.da")).alias("ta"), (F.col("b_bin") - F.col("__p.db")).alias("tb"), "__p", "a_bin", "b_bin", "n")
    targets = plain.withColumn("t", F.explode(F.array(*(F.struct(x.alias("a"), y.alias("b")) for x in _edge("a_bin", "da", size) for y in _edge("b_bin", "db", size)))))
    ok = F.col("t.a").between(0, size - 1) & F.col("t.b").between(0, size - 1)
    right = (mirror(F.col("t.a") + F.col("__p.da")) == F.col("a_bin")) & (mirror(F.col("t.b") + F.col("__p.db")) == F.col("b_bin"))
    return targets.filter(ok & right).dropDuplicates([*by, "a_bin", "b_bin", "__p", "t"]).groupBy(*by, F.col("t.a").alias("a_bin"), F.col("t.b").alias("b_bin")).agg(F.sum(F.col("n") * F.col("__p.w")).alias("smooth"))


def _edge(name: str, off: str, size: int) -> list[Column]:
    """Targets that may read this bin at offset ``off``: directly, or mirrored at either edge."""
    b, d = F.col(name), F.col(f"__p.{off}")
    return [b - d, -b - d, 2 * (size - 1) - b - d]


def rarity(bins: DataFrame, by: Sequence[str], weight: str = "n") -> DataFrame:
    """``-ln(share + 1e-10)`` of each bin within its group."""
    if not by:
        return bins.withColumn("rarity", -F.ln(F.col(weight) / bins.agg(F.sum(weight)).scalar() + 1e-10))
    totals = bins.groupBy(*by).agg(F.sum(weight).alias("__t"))
    return bins.join(totals, list(by)).withColumn("rarity", -F.ln(F.col(weight) / F.col("__t") + 1e-10)).drop("__t")


def above_percentile(rows: DataFrame, by: Sequence[str], value: str, q: float = 0.97) -> DataFrame:
    """Rows strictly above the exact, linearly interpolated percentile of their group."""
    cut = F.percentile(value, F.lit(q)).alias("__q")
    if by:
        return rows.join(rows.groupBy(*by).agg(cut), list(by)).filter(F.col(value) > F.col("__q")).drop("__q")
    return rows.filter(F.col(value) > rows.agg(cut).scalar())


def component_stats(pixels: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Area, box, centroid and means of labelled pixels (x, y)."""
    return pixels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("area"),
        F.struct(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")).alias("bbox"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        *(F.avg(v).alias(f"mean_{v}") for v in values),
    )


def merge_verdicts(results: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One verdict a scene from its variants: any found, largest confidence where found, summed time, last terrain."""
    return results.groupBy(*by).agg(*verdict_columns(order))


def verdict_columns(order: str) -> list[Column]:
    return [
        F.coalesce(F.bool_or("found"), F.lit(False)).alias("found"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        F.sum(F.coalesce("llm_time", F.lit(0.0))).alias("llm_time"),
        F.max_by("terrain", F.when(F.col("terrain").isNotNull(), F.col(order))).alias("terrain"),
        F.count(F.lit(1)).alias("n_variants"),
    ]


def merged_findings(results: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Findings of all variants that found something, each tagged with its source, in variant order."""
    return results.groupBy(*by).agg(findings_column(order))


def findings_column(order: str) -> Column:
    tagged = F.transform("findings", lambda f: f.withField("source_variant", F.col("variant")))
    ordered = F.sort_array(F.collect_list(F.when(F.col("found"), F.struct(order, tagged.alias("f")))))
    return F.flatten(F.transform(ordered, lambda x: x["f"])).alias("findings")


def rollup_totals(rows: DataFrame, by: Sequence[str], **measures: Column) -> DataFrame:
    """Sums a group with a grand total, marked by ``is_total``."""
    return rows.rollup(*by).agg(*(c.alias(k) for k, c in measures.items()), F.grouping(by[0]).cast("int").alias("is_total"))


def quality_ratio(frames: DataFrame, by: Sequence[str], score: Column, threshold: float, seconds: Column) -> DataFrame:
    """Passing frames, their share, and passing frames a second of the range looked at."""
    return frames.groupBy(*by).agg(
        F.count_if(score >= threshold).alias("n_good"), (F.count_if(score >= threshold) / F.count(F.lit(1))).alias("ratio"), (F.count_if(score >= threshold) / F.greatest(seconds, F.lit(1e-9))).alias("density")
    )


def relaxed(ratio: DataFrame, quality: float = 0.5, similarity: float = 0.82, fewest: int = 5, least_ratio: float = 0.02, least_density: float = 0.5) -> DataFrame:
    """Thresholds of each video: lowered where too few frames pass, never raised."""
    poor = ((F.col("n_good") < fewest) & (F.col("ratio") < least_ratio)) | (F.col("density") < least_density)
    return ratio.withColumn("quality_threshold", F.when(poor, min(quality, 0.3)).otherwise(quality)).withColumn("similarity_threshold", F.when(poor, min(similarity, 0.55)).otherwise(similarity))


def variation(values: Column) -> Column:
    """Coefficient of variation, by the population's deviation."""
    return F.stddev_pop(values) / F.avg(values)

"""Rendezvous (highest random weight) hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_name, stage


def score(key: Column, shard: int, weight: float) -> Column:
    """``weight / -ln(u)`` with ``u`` in (0, 1): 52 bits of the MD5 of key and shard number, one half of it for each of two shards."""
    if not weight > 0:
        raise ValueError("a shard's weight must be above 0")
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard // 2}")).cast("binary")), 1 + 16 * (shard % 2), 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(float(weight)) / -F.ln(u)


def _best(key: Column, weights: Sequence[float]) -> Column:
    return F.greatest(*(F.struct(score(key, k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights)))


def rendezvous(docs: DataFrame, weights: Sequence[float], key: str, grown_weight: float | None = None) -> DataFrame:
    """``docs`` with ``shard``, and ``grown_shard`` as it is once one more shard of ``grown_weight`` joins.

    Key and shard list alone decide: a new shard takes the keys on which it
    scores highest and no key moves between old shards. A null key counts as
    one key of its own. Equal scores go to the larger shard number. Columns of
    ``docs`` called ``shard`` or ``grown_shard`` are replaced.
    """
    weights = list(weights)
    if not weights:
        raise ValueError("no shards")
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    best = F.struct(score(k, 0, weights[0]).alias("score"), F.lit(0).alias("shard")) if len(weights) == 1 else _best(k, weights)
    name = free_name(docs, "best")
    out = docs.withColumn(name, best)
    extra = F.col(f"{name}.shard")
    if grown_weight is not None:
        extra = F.when(score(k, len(weights), grown_weight) >= F.col(f"{name}.score"), F.lit(len(weights))).otherwise(extra)
    return out.withColumn("shard", F.col(f"{name}.shard")).withColumn("grown_shard", extra).drop(name)


def with_slots(rows: DataFrame, number: str, order: Sequence[str], bucket_rows: int = 1 << 18, most: int = 4096) -> DataFrame:
    """``rows`` (a written table with ``shard``) with ``slot``: gapless from 0 in each shard, by ``number`` and then ``order``.

    ``number``, a long, is cut at quantiles into about as many ranges as there
    are ``bucket_rows``. Rows are numbered in each range of each shard and the
    counts of the ranges before (shards x ``most`` numbers at most) are added,
    so no task sorts a whole shard and the ranges leave no trace in the slots.
    """
    n = min(most, -(-rows.count() // bucket_rows))
    cuts = rows.agg(F.percentile_approx(number, [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    splits = [float("-inf"), *sorted({0.0, *(float(c) for c in cuts or [])}), float("inf")]  # one cut at least
    place, of, ahead, row = (free_name(rows, x) for x in ("place", "of", "ahead", "row"))
    marked = rows.withColumn(of, F.coalesce(F.col(number).cast("double"), F.lit(float("-inf"))))
    marked = Bucketizer(splits=splits, inputCol=of, outputCol=place).transform(marked).withColumn(place, F.when(F.col(number).isNull(), -1).otherwise(F.col(place)).cast("int")).drop(of)
    sizes = marked.groupBy("shard", place).agg(F.count(F.lit(1)).alias(ahead))
    before = Window.partitionBy("shard").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", place, F.coalesce(F.sum(ahead).over(before), F.lit(0)).alias(ahead))
    own = Window.partitionBy("shard", place).orderBy(number, *order)
    # shards x ranges rows: a bound that the parameters set
    numbered = marked.withColumn(row, F.row_number().over(own)).join(F.broadcast(sizes), ["shard", place])
    return numbered.withColumn("slot", (F.col(ahead) + F.col(row) - 1).cast("long")).drop(place, ahead, row)


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", **named
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. ``slot`` goes by id
    (null first), checksum and size. Rows that repeat an id go to one shard and
    get slots of their own; an empty table gives no rows; other columns are not
    read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law")
    )
    return with_slots(stage(rendezvous(rows, weights, "doc_id", grown_weight), "shards"), "doc_id", ["text_crc32", "size"], **named)

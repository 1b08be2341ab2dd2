"""Exact deduplication by a log-structured merge index of digests.

* A memtable is one map task's share of the rows. It is flushed by
  ``sortWithinPartitions`` as a run: a Parquet file sorted by digest, with
  min/max statistics and a Bloom filter on the digest.
* Compaction merges runs to one entry a digest, with the smallest identifier
  and the number of rows. The aggregate combines on the map side, so a digest
  that a third of all rows share reaches the reducer as one row a task.
* A hit (a digest with several rows) is believed only after its bytes are
  compared. A fixed-size bitmap filter built from the hits lets only their rows
  carry text; these are grouped by (digest, bytes), again with a map-side
  combine. Digests that stand for different texts are split by the bytes.

Everything is DataFrame code; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, new_path, stage

#: A run of white space that is anything but one space.
_RUN = r"[\t-\r][ \t-\r]*| [ \t-\r]+"


def normalised(text: Column) -> Column:
    """``[\\x20\\x09-\\x0D]+`` to one space; null as empty. Single spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUN, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _filter_bits(hits: int) -> int:
    """Bits of the bitmap: 16 a hit as a power of two, from 2^20 (128 KB) to 2^31 (256 MB)."""
    return 1 << max(20, min(31, (max(hits, 1) * 16 - 1).bit_length()))


class DigestIndex:
    """Digest -> smallest identifier and number of rows, as sorted runs below one folder."""

    def __init__(self, spark, digest=sha256):
        self.spark, self.digest, self.path, self.runs = spark, digest, new_path(spark, "digest-index"), 0

    def _options(self) -> dict[str, str]:
        return {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}

    def flush(self, rows: DataFrame) -> DataFrame:
        """Write (id, digest) as sorted runs, one for each task, without a shuffle."""
        out = f"{self.path}/level0/run={self.runs}"
        rows.select("id", "digest").sortWithinPartitions("digest", "id").write.options(**self._options()).parquet(out)
        self.runs += 1
        return self.spark.read.parquet(out)

    def level0(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/level0/run={k}" for k in range(self.runs)))

    def compact(self) -> DataFrame:
        """Merge all runs: one row a digest with ``keep_id`` and ``n``, sorted by digest."""
        merged = self.level0().groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        out = f"{self.path}/level1-{self.runs}"
        merged.sortWithinPartitions("digest").write.options(**self._options()).parquet(out)
        return self.spark.read.parquet(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Null text equals empty text. The smallest id of a group stays; nulls count
    as larger than any id, and a group of null ids keeps null. Rows that repeat
    an id and a text are all ``kept`` when that id stays, since nothing tells
    them apart. An empty table gives no rows; other columns are not read.
    ``digest`` may be any deterministic hash of the normalised text: rows whose
    digests collide are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    index = DigestIndex(spark, digest)
    log = index.flush(rows)
    merged = index.compact()

    hits = merged.filter("n > 1")
    n_hits = hits.count()
    if not n_hits:
        return _result(log.join(merged, "digest"))
    bits = _filter_bits(n_hits)
    place = lambda d: F.pmod(F.xxhash64(d), F.lit(bits)) + 1
    bitmap = hits.groupBy(F.bitmap_bucket_number(place("digest")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("digest"))).alias("bitmap")
    )
    # bits / 8 bytes at most, which _filter_bits bounds
    where = rows.withColumn("bucket", F.bitmap_bucket_number(place("digest"))).withColumn(
        "bit", F.bitmap_bit_position(place("digest")).cast("int")
    )
    byte = F.conv(F.hex(F.expr("substring(bitmap, bit div 8 + 1, 1)")), 16, 10).cast("long")
    maybe = where.join(F.broadcast(bitmap), "bucket").filter(F.getbit(byte, F.col("bit") % 8) == 1)
    by_bytes = maybe.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    mixed = stage(by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "digest-mixed")
    if mixed.isEmpty():
        drop(mixed)
        return _result(log.join(merged, "digest"))
    sole = merged.join(mixed, "digest", "left_anti")
    split = rows.join(mixed.select("digest"), "digest", "left_semi")
    split = split.join(split.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), ["digest", "norm"])
    return _result(log.join(sole, "digest").select("id", "keep_id", "n", "digest").unionByName(split.select("id", "keep_id", "n", "digest")))


def _result(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )

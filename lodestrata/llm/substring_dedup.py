"""Removal of repeated passages by difference-cover anchors.

A passage of ``window`` words that two documents share may begin at any word of
either. Anchors are short windows hashed only at word positions whose remainder
modulo ``period`` lies in a difference cover: for any two alignments there is a
shift below ``period`` that brings both on the cover. So with anchors of
``window - period + 1`` words every shared window holds an aligned anchor that
both documents have hashed.

1. Every document is summarised once: its words' digest and its anchors. An
   aggregate with a map-side combine finds the anchors that two different
   documents have; a bitmap of fixed size holds them, or, if they are too many
   for it, a join gives each document its own.
2. Documents are read again, once. From each shared anchor the match is
   extended to all windows around it, and only these candidate windows get a
   96-bit hash. The smallest document of each window is again an aggregate; no
   pairs of documents are ever formed, however many share a window.
3. A window that also begins in a smaller document covers its words.

Documents with the same words are one class: copies of its smallest lose
whatever windows cover, without a look at their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from . import blocks as B
from .store import drop, free_name, own_columns, stage

#: Perfect difference sets by period: every remainder but 0 is the difference of exactly one pair.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_NO_ID = (1 << 63) - 1
_RANGES = "array<struct<begin:long,end:long>>"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of two fifths of the window; (1, (0,)) for short windows."""
    fits = [p for p in COVERS if window - p + 1 >= max(2, 2 * window // 5)]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


def _words(batch: pa.RecordBatch):
    """For each block: rows, texts' words joined by one space (bytes), hashes of the words, text of each, first of each text."""
    for rows, buf, at in B.blocks(batch, "text"):
        s, e = B.spans(buf, B.SOLID)
        owner, first = B.owners(s, at)
        yield rows, buf, at, B.hashes(buf, s, e), owner, first


def _joined(buf: np.ndarray, at: np.ndarray) -> list[list[bytes]]:
    return [buf[a:b].tobytes().split() for a, b in zip(at.tolist(), [*(at[1:] - 1).tolist(), len(buf) - 1], strict=True)]


def _anchor_places(size: np.ndarray, first: np.ndarray, window: int, period: int, cover: tuple[int, ...], n: int) -> np.ndarray:
    """Numbers of the words in a block of ``n`` at which anchors begin, in order."""
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - first[owner]
    on = np.zeros(period, bool)
    on[list(cover)] = True
    return np.flatnonzero(on[place % period] & (place + window - period + 1 <= size[owner]) & (size[owner] >= window))


def find_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", most_bits: int = bitmap.MOST) -> DataFrame:
    """One row for each row of ``docs``: id, text_key, n_words, n_removed, covered, kept_sha256.

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, unchanged; null
    text has none. ``covered`` holds the merged word ranges of windows of
    ``window`` words that also begin in a row with a smaller id; ``kept_sha256``
    is of the other words, joined by one space. A null id counts as larger than
    any other. Rows that repeat an id remove nothing from each other. An empty
    table gives no rows; other columns are not read. If the shared anchors are
    more than a bitmap of 2^most_bits bits holds, they are joined to their
    documents instead; either way the texts are read three times.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    period, cover = cover_for(window)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"), F.col(text_col).cast("string").alias("text")
    )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at, h, _, first in _words(batch):
                size = np.diff(first)
                places = _anchor_places(size, first, window, period, cover, len(h))
                g = B.grams(h, window - period + 1)[places].view(np.int64)
                ends = np.searchsorted(places, first)
                digests = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in _joined(buf, at)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(g))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("text_key"), pa.array(size), pa.array(digests, pa.binary()), pa.array(shas), lists], names=["id", "text_key", "n_words", "digest", "sha", "anchors"]
                )

    known = stage(source.mapInArrow(summarise, "id long, text_key long, n_words long, digest binary, sha string, anchors array<long>"), "repeat-summaries")
    # texts of one class have equal anchors, so an anchor is shared only if two classes have it
    held = known.filter("size(anchors) > 0").select(F.xxhash64("digest").alias("class"), F.explode("anchors").alias("hash"))
    shared = stage(held.groupBy("hash").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("hash"), "repeat-anchors")
    n_shared = shared.count()
    many = n_shared * 16 > 1 << most_bits
    marks = None if many else spark.sparkContext.broadcast(bitmap.gather(shared, bitmap.bits_for(n_shared, most_bits)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _, h, _, first in _words(batch):
                size = np.diff(first)
                places = _anchor_places(size, first, window, period, cover, len(h))
                g = B.grams(h, window - period + 1)[places]
                if marks is not None:
                    hit = bitmap.has(marks.value, g)
                else:
                    own, ends = rows.column("own"), np.searchsorted(places, first)
                    hit = np.concatenate([np.isin(g[a:b].view(np.int64), own[k].values.to_numpy()) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))])
                starts, owner = _around(places[hit], first, size, window, period)
                if len(starts):
                    one, two = (B.grams(h, window, base)[starts] for base in _BASES)
                    ids, keys = (rows.column(c).to_numpy()[owner] for c in ("id", "text_key"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids), pa.array(keys), pa.array((starts - first[owner]).astype(np.int32))],
                        names=["h1", "h2", "id", "text_key", "place"],
                    )

    schema = "h1 long, h2 int, id long, text_key long, place int"
    among = source
    if many:
        anchors = known.filter("size(anchors) > 0").select("id", "text_key", F.explode("anchors").alias("hash"))
        own = anchors.join(shared, "hash", "left_semi").groupBy("id", "text_key").agg(F.collect_set("hash").alias("own"))
        among = source.join(stage(own, "repeat-own"), ["id", "text_key"])
    found = stage(among.mapInArrow(candidates, schema), "repeat-windows") if n_shared else spark.createDataFrame([], schema)
    drop(shared)
    least = stage(found.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("h1", "h2", "low"), "repeat-firsts")
    later = found.join(least, ["h1", "h2"]).filter("id > low")
    places = stage(later.groupBy("id", "text_key").agg(F.collect_set("place").alias("places")), "repeat-places")
    drop(found, least)

    # the words that stay, of the texts that lose some
    n_cut = places.count()
    some = bitmap.sieve(source, "id", places.select("id").distinct(), n_cut).dropDuplicates(["id", "text_key"]).join(places, ["id", "text_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, begins in zip(batch.column("text").cast(pa.binary()), batch.column("places"), strict=True):
                words = (text.as_py() or b"").split()
                ranges = merged(begins.values.to_numpy(), window)
                gone = np.zeros(len(words), bool)
                for r in ranges:
                    gone[r["begin"] : r["end"]] = True
                out[0].append(int(gone.sum()))
                out[1].append(ranges)
                out[2].append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], pa.string())], names=["id", "text_key", "cut", "ranges", "rest"])

    lost = some.mapInArrow(cut, f"id long, text_key long, cut long, ranges {_RANGES}, rest string")
    # written, so that the join has an exchange on either side, which Spark splits where a digest has many rows
    classes = stage(known.groupBy("digest").agg(F.min("id").alias("keep")), "repeat-digests")
    state = known.select("id", "text_key", "n_words", "digest", "sha").join(classes, "digest").join(lost, ["id", "text_key"], "left")
    copy = (F.col("id") != F.col("keep")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))
    return state.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"),
        "text_key",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("ranges", F.array().cast(_RANGES))).alias("covered"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )


def _around(places: np.ndarray, first: np.ndarray, size: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that begin at most ``period - 1`` words before one of ``places`` and lie in its text, and their texts."""
    owner = np.searchsorted(first, places, side="right") - 1
    begin = np.maximum(places - period + 1, first[owner])
    end = np.minimum(places + 1, first[owner] + size[owner] - window + 1)
    good = end > begin
    reach = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(reach, begin[good], 1)
    np.add.at(reach, end[good], -1)
    starts = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
    return starts, np.searchsorted(first, starts, side="right") - 1


def merged(places: np.ndarray, window: int) -> list[dict]:
    """The union of ``[p, p + window)`` as ranges in order."""
    p = np.sort(places).astype(np.int64)
    if not len(p):
        return []
    head = np.r_[0, np.flatnonzero(np.diff(p) > window) + 1]
    tail = np.r_[head[1:], len(p)] - 1
    return [{"begin": b, "end": e} for b, e in zip(p[head].tolist(), (p[tail] + window).tolist(), strict=True)]


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """``docs`` with the covered words taken out of ``text_col``; texts that lose none are unchanged."""
    spans = find_repeats(docs, window, id_col, text_col, **named).filter("n_removed > 0")
    key, own, gone = (free_name(docs, x) for x in ("key", "id", "gone"))
    spans = spans.select(F.coalesce("id", F.lit(_NO_ID)).alias(own), F.col("text_key").alias(key), F.col("covered").alias(gone)).dropDuplicates([own, key])
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = F.array_join(F.filter(words, lambda w, i: ~F.exists(gone, lambda r: (i >= r["begin"]) & (i < r["end"]))), " ")
    return keyed.join(spans, [own, key], "left").withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest)).select(*own_columns(docs))

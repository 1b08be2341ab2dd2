"""Near duplicates by BagMinHash over the multiset of word shingles.

A document is a multiset of ``shingle``-word shingles. For each distinct
shingle the weight axis is cut at 1, 2, 4, 8 ..., and each interval has a
Poisson process of its own, seeded by shingle and interval alone, whose points
have a time, a place in the interval and a signature component. A document
takes the points of whole intervals below its weight and, of the last interval,
those placed below the weight. The first point of each component makes the
signature, so two components agree with the probability of the weighted Jaccard
similarity. Points are made only up to a time by which all components of a
document have one; a document that falls short is done again with twice the
time, which changes no point.

Signatures are cut into bands; rows of equal band values are linked by
``components.link``, which checks the multiset overlap exactly and never forms
all pairs of a bucket. Documents with the same words are one row of all this.
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
from .components import link
from .store import drop, free_name, stage

_U = np.uint64
_STEP, _LEVEL, _SPREAD = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)
_NO_ID = (1 << 63) - 1
_TICKS = 1 << 16
#: Points that are made at once.
_POINTS = 1 << 18


def shingles(batch: pa.RecordBatch, size: int):
    """For each block: rows, words' hashes, first word of each text, hash and text of each shingle.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A text of fewer words, but not none, is one shingle.
    """
    for rows, buf, at in B.blocks(batch, "text"):
        low = B.LOWER[buf]
        s, e = B.spans(low, B.ALNUM)
        h, (owner, first) = B.hashes(low, s, e), B.owners(s, at)
        n = np.diff(first)
        g = B.grams(h, size)
        inside = np.flatnonzero(np.arange(len(h)) + size <= first[owner + 1]) if len(h) else np.empty(0, np.int64)
        few = np.flatnonzero((n > 0) & (n < size))
        short = np.array([B.grams(h[first[k] : first[k + 1]], int(n[k]))[0] for k in few], _U)
        yield rows, h, first, np.concatenate([g[inside], short]), np.concatenate([owner[inside], few])


def weights(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, multiplicity) of each distinct shingle of each text, ordered by text."""
    order = np.lexsort((gram, owner))
    g, o = gram[order], owner[order]
    head = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])]) if len(g) else np.empty(0, np.int64)
    return g[head], o[head], np.diff(np.r_[head, len(g)])


def expanded(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th copy of each shingle has a hash of its own."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return B.mix(np.repeat(gram, count) + nth.astype(_U) * _SPREAD)


def signatures(gram: np.ndarray, owner: np.ndarray, count: np.ndarray, texts: int, parts: int) -> np.ndarray:
    """texts x parts: time of the first point in the high half, the point's identity in the low half; all ones without shingles."""
    out = np.full((texts, parts), ~_U(0), _U)
    total = np.bincount(owner, count, texts)
    until = parts * (np.log(parts) + 4) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(texts, bool)
        mine[todo] = True
        pick = np.flatnonzero(mine[owner])
        flat = np.full(texts * parts, ~_U(0), _U)
        for many in (False, True):
            own, chunk = pick[(until[owner[pick]] > 6) == many], 32 if many else 2
            for a in range(0, len(own), _POINTS // chunk):
                some = own[a : a + _POINTS // chunk]
                _points(flat, gram[some], owner[some], count[some], until, parts, chunk)
        out[todo] = flat.reshape(texts, parts)[todo]
        todo = todo[(out[todo] == ~_U(0)).any(axis=1)]
        until[todo] *= 2
    return out


def _points(flat: np.ndarray, gram: np.ndarray, owner: np.ndarray, count: np.ndarray, until: np.ndarray, parts: int, chunk: int) -> None:
    """Enter the points before ``until`` of every interval of every shingle into ``flat``."""
    level = 0
    while len(gram):
        begin, rate = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        key = B.mix(gram + _U(level * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF))
        now, j, left = np.zeros(len(gram)), 0, np.arange(len(gram))
        share = np.minimum((count - begin) / rate, 1.0)  # of the interval that lies below the weight
        while len(left):
            h = B.mix(key[left, None] + np.arange(j, j + chunk).astype(_U) * _STEP)
            gap = -np.log1p(-((h >> _U(11)).astype(np.float64) * 2.0**-53)) / rate
            at = now[left, None] + np.cumsum(gap, axis=1)
            other = B.mix(h ^ _SPREAD)
            good = (at <= until[owner[left], None]) & ((other & _U(0xFFFFFF)).astype(np.float64) * 2.0**-24 < share[left, None])
            r, c = np.nonzero(good)
            part = ((other[r, c] >> _U(32)) * _U(parts)) >> _U(32)
            ticks = np.minimum(at[r, c] * _TICKS, 0xFFFFFFFE).astype(_U)
            np.minimum.at(flat, owner[left[r]] * parts + part.astype(np.int64), (ticks << _U(32)) | (h[r, c] >> _U(32)))
            now[left] = at[:, -1]
            left = left[at[:, -1] <= until[owner[left]]]
            j += chunk
        more = np.flatnonzero(count > begin + rate)
        gram, owner, count, level = gram[more], owner[more], count[more], level + 1


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """texts x bands of 64-bit values; ``rows`` components make one."""
    ident = (signature & _U(0xFFFFFFFF)).reshape(len(signature), -1, rows)
    h = np.zeros(ident.shape[:2], _U) + np.arange(ident.shape[1]).astype(_U) * _LEVEL
    for k in range(rows):
        h = B.mix((h ^ ident[:, :, k]) * _STEP + _U(1))
    return h


_CELLS = 512


def sketch(items: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of 512 cells, 255 at most."""
    return np.minimum(np.bincount((items >> _U(55)).astype(np.int64), minlength=_CELLS), 255).astype(np.uint8).tobytes()


def may_reach(threshold: float):
    """Whether cell counts let the overlap be large enough, one pair a row: the smaller counts add up to no less than it.

    What a full cell leaves out is added as if it all met.
    """

    def may(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
        out = np.minimum(nx, ny) >= threshold * np.maximum(nx, ny)
        at = np.flatnonzero(out)
        x, nx, y, ny = x[at], nx[at], y[at], ny[at]
        most = np.minimum(x, y).sum(axis=1, dtype=np.int64) + np.minimum(nx - x.sum(axis=1, dtype=np.int64), ny - y.sum(axis=1, dtype=np.int64))
        out[at] = most >= threshold * (nx + ny - most) - 1e-9
        return out

    return may


def near_groups(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, n_bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(groups, links).

    ``groups``: id, text_key (xxhash64 of the text), n_shingles, copy_of (the
    smallest id with the same words), class_id (the smallest id of the connected
    group), for each row of ``docs``. ``links``: a, b (both ``copy_of`` ids) and
    similarity of the pairs found whose multisets of shingles have a weighted
    Jaccard similarity of ``threshold`` or more; the groups are theirs. Texts
    without words are groups of one each. Rows that repeat an id are judged by
    their own texts; a null id counts as larger than any other. An empty table
    gives no rows; other columns are not read.
    """
    parts = n_bands * rows
    text = F.col(text_col).cast("string")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, first, gram, owner in shingles(batch, shingle):
                n = part.num_rows
                g, o, c = weights(gram, owner)
                b = bands(signatures(g, o, c, n, parts), rows)
                size = np.bincount(owner, minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32)), pa.array(b.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), pa.array(size.astype(np.int64)), pa.array(_digests(h, first), pa.binary()), lists], names=["id", "text_key", "size", "digest", "bands"])
        B.release()

    # a node is a text's words: its digest, and 64 bits of that as the number that links and groups go by
    known = stage(source.mapInArrow(sign, "id long, text_key long, size long, digest binary, bands array<long>"), "near-signatures")
    # written, so that the join has an exchange on either side, which Spark splits where a digest has many rows
    classes = stage(known.groupBy("digest").agg(F.min("id").alias("keep")).withColumn("node", F.xxhash64("digest")), "near-digests")
    state = stage(known.select("id", "text_key", "size", "digest").join(classes, "digest").select("id", "text_key", "size", "node", F.when(F.col("size") > 0, F.col("keep")).otherwise(F.col("id")).alias("keep")), "near-classes")
    first_of = classes.select("digest", F.col("keep").alias("id"), "node")
    buckets = known.filter("size > 0").join(first_of, ["digest", "id"]).dropDuplicates(["node"]).select(F.explode("bands").alias("bucket"), F.col("node").alias("id"), "size")
    several = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    shared = stage(buckets.join(several, "bucket"), "near-buckets")
    drop(known)

    involved = stage(shared.select(F.col("id").alias("node")).distinct().join(classes.select("node", "keep"), "node"), "near-involved")
    some = bitmap.sieve(source, "id", involved.select(F.col("keep").alias("id")).distinct(), involved.count())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, first, gram, owner in shingles(batch, shingle):
                g, o, c = weights(gram, owner)
                ends = np.searchsorted(o, np.arange(part.num_rows + 1))
                out = [expanded(g[a:b], c[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_digests(h, first), pa.binary()), pa.array([x.tobytes() for x in out], pa.binary()), pa.array([sketch(x) for x in out], pa.binary())], names=["digest", "set", "sketch"])
        B.release()

    made = some.mapInArrow(sets, "digest binary, set binary, sketch binary").withColumn("id", F.xxhash64("digest")).drop("digest")
    sets_of = stage(made.join(involved.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "near-sets")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                j = both / (len(x) + len(y) - both)
                if j >= threshold:
                    keep.append(k)
                    found.append(j)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
        B.release()

    def check(pairs: DataFrame) -> DataFrame:
        left, right = sets_of.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets_of.select(F.col("id").alias("b"), F.col("set").alias("sb"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(overlap, "a long, b long, similarity double")

    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    links, groups = link(shared, check, near, lambda ids: sets_of.select("id", "sketch"), may_reach(threshold))
    drop(shared, sets_of)
    own = groups.select(F.col("id").alias("node"), "comp").join(involved, "node")
    heads = stage(own.join(own.groupBy("comp").agg(F.min("keep").alias("class")), "comp").select("node", "keep", "class"), "near-groups")
    drop(involved)
    out = state.join(heads.select("node", "class"), "node", "left").select(_id("id"), "text_key", F.col("size").alias("n_shingles"), _id("keep").alias("copy_of"), _id(F.when(F.col("size") > 0, F.coalesce("class", "keep")).otherwise(F.col("keep"))).alias("class_id"))
    first, second = (heads.select(F.col("node").alias(x), F.col("keep").alias(f"k{x}")) for x in "ab")
    named = links.join(first, "a").join(second, "b").select(_id(F.least("ka", "kb")).alias("a"), _id(F.greatest("ka", "kb")).alias("b"), "similarity")
    return out, named


def _digests(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _id(column):
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(c != _NO_ID, c)
    return out.alias(column) if isinstance(column, str) else out


def near_dedup(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group."""
    groups, _ = near_groups(docs, threshold, id_col=id_col, text_col=text_col, **named)
    gone = stage(groups.filter(~F.col("id").eqNullSafe(F.col("class_id"))).select(F.coalesce("id", F.lit(_NO_ID)).alias("own"), F.col("text_key").alias("key")).distinct(), "near-gone")
    own, key = free_name(docs, "own"), free_name(docs, "key")
    keyed = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = keyed.toDF(*names, "own", "key")
    # texts that a bitmap knows to stay are not sent through the join
    apart = lambda outside: bitmap.sieve(keyed, "key", gone.select("key"), gone.count(), outside)
    return apart(True).unionByName(apart(False).join(gone, ["own", "key"], "left_anti")).select(*names).toDF(*docs.columns)

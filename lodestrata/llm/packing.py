"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Lengths lie between 1 and the capacity, so the whole instance is a histogram
with at most ``capacity`` numbers however many documents there are. The
reduction and the best fit work on lengths with counts: a step fixes one kind
of sequence as many times as counts allow. The result is a list of kinds of
sequences whose size depends on the capacity, not on the corpus. Pieces then
find their places by their number among the pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import stage


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate every alternative for the largest length; ``counts`` keeps the rest.

    For the largest length ``j``, a set of others is fixed beside it where an
    exchange argument shows that some optimal packing has it so:

    * nothing else fits: ``j`` alone;
    * one length fills the sequence exactly;
    * at most one more piece fits: the largest that does;
    * two more fit and no three: the largest single one if it is at least as
      long as the best pair, or the pair if it fills the sequence exactly and
      no single longer than its larger member fits.

    Stops at the first length for which none of these holds and goes on with
    the next smaller one, until a pass fixes nothing.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    moved = True
    while moved:
        moved = False
        for j in sorted(counts, reverse=True):
            while counts.get(j, 0):
                best = _dominating(counts, capacity, j)
                if best is None:
                    break
                times = min(counts[x] // best.count(x) for x in set(best))
                if best == (j,):
                    times = counts[j]
                # a step holds while the lengths it rests on are still there, so it is taken as often as its own last
                for x in best:
                    counts[x] -= times
                    if not counts[x]:
                        del counts[x]
                fixed.append((best, times))
                moved = True
    return fixed


def _dominating(counts: dict[int, int], capacity: int, j: int) -> tuple[int, ...] | None:
    room = capacity - j
    have = sorted(k for k, n in counts.items() if n - (k == j) > 0 and k <= room)
    if not have:
        return (j,)
    top, low = have[-1], have[0]
    if top == room:
        return (j, top)
    second = low if counts[low] - (low == j) > 1 else (have[1] if len(have) > 1 else None)
    if second is None or low + second > room:
        return (j, top)
    third = _third(counts, have, low, second, j)
    if third is not None and low + second + third <= room:
        return None
    pair = _best_pair(counts, have, room, j)
    if pair is None or sum(pair) <= top:
        return (j, top)
    if sum(pair) == room and max(pair) == top:
        return (j, *pair)
    return None


def _third(counts: dict[int, int], have: list[int], low: int, second: int, j: int) -> int | None:
    left = {low: 0}
    for x in (low, second):
        left[x] = left.get(x, 0) + 1
    return next((x for x in have if counts[x] - (x == j) - left.get(x, 0) > 0), None)


def _best_pair(counts: dict[int, int], have: list[int], room: int, j: int) -> tuple[int, int] | None:
    best, i, k = None, 0, len(have) - 1
    while i <= k:
        a, b = have[i], have[k]
        if a + b > room:
            k -= 1
        else:
            if (a != b or counts[a] - (a == j) > 1) and (best is None or a + b > sum(best) or a + b == sum(best) and b > best[0]):
                best = (b, a)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit with lengths in decreasing order; equal open sequences are filled together."""
    open_: dict[int, list[list]] = {}  # room -> kinds of sequences with that room, and how many
    rooms: list[int] = []

    def add(room: int, kind: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([kind, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fits = capacity // length
                if full := left // fits:
                    add(capacity - fits * length, (length,) * fits, full)
                if left % fits:
                    add(capacity - left % fits * length, (length,) * (left % fits), 1)
                left = 0
            else:
                room = rooms[k]
                kind, n = open_[room][-1]
                times = min(n, left)
                if times == n:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[k]
                else:
                    open_[room][-1][1] -= times
                add(room - length, (*kind, length), times)
                left -= times
    return [(tuple(kind), n) for room in rooms for kind, n in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences (lengths, and how many of them) that hold exactly ``counts``."""
    counts = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a length is not between 1 and the capacity")
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: texts longer than ``capacity`` ids are cut, the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, first in tokens.encoded(batch, "text", tokenizer):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        for out, v in zip(rows, (doc_id, k, x, y - x, zlib.crc32(own[x:y])), strict=True):
                            out.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(cut: DataFrame, capacity: int, bucket_rows: int = 1 << 14, most: int = 1 << 18) -> DataFrame:
    """``cut`` (with ``length``) with ``sequence_id`` and ``offset``. ``cut`` must be a written table.

    Pieces of a length are numbered in hash buckets of about ``bucket_rows``, and
    of more where that would make over ``most`` buckets; so a length that a third
    of all pieces have is no one task's. The driver holds a number for each
    bucket, ``capacity`` and ``most`` of them at most, and the plan.
    """
    wide = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(bucket_rows, -(-sum(wide.values()) // most))
    parts = F.get(F.array(*(F.lit(-(-wide.get(k, 0) // share) or 1) for k in range(capacity + 1))), F.col("length").cast("int"))
    mixed = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), parts).cast("int")
    rows = cut.withColumn("__bucket", mixed)
    sizes = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    counted = sizes.collect()
    counts: dict[int, int] = {}
    before = []
    for r in sorted(counted, key=lambda r: (r.length, r["__bucket"])):
        before.append((r.length, r["__bucket"], counts.get(r.length, 0)))
        counts[r.length] = counts.get(r.length, 0) + r["__n"]
    places: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (number of the first, first sequence, offset, copies in a sequence)
    used, sequence = dict.fromkeys(counts, 0), 0
    for kind, n in plan(counts, capacity):
        at = 0
        for length in kind:
            places.setdefault(length, []).append((used[length], sequence, at))
            used[length] += n
            at += length
        sequence += n
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in places.items()}
    spark = cut.sparkSession
    shared = spark.sparkContext.broadcast(table)
    schema = "length long, __bucket int, __before long"
    offsets = spark.createDataFrame(before, schema)
    own = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = rows.withColumn("__row", F.row_number().over(own)).join(F.broadcast(offsets), ["length", "__bucket"])
    numbered = numbered.select(*cut.columns, (F.col("__before") + F.col("__row") - 1).cast("long").alias("__number"))

    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "__number"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, start, at = shared.value[int(length[own[0]])]
                k = np.searchsorted(first, number[own], side="right") - 1
                seq[own], off[own] = start[k] + number[own] - first[k], at[k]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, `offset` long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, **named) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: the end id alone. Null ids are kept; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    """
    return assign(stage(pieces(docs, tokenizer, end_id, capacity, **named), "pieces"), capacity)

"""Connected groups of linked rows, and the linking of rows that share buckets.

Both near-duplicate operators put rows into buckets and link rows of a bucket
that pass an exact check. A bucket may hold a third of all rows, so pairs of a
bucket are never all formed. ``link`` works in two rounds:

1. in every bucket, rows of small sub-buckets (by a hash of the id, the same in
   every bucket) are compared with each other, and every row with the bucket's
   smallest id. Sub-buckets hold ``small`` rows on average; a bucket of that
   size is its only sub-bucket, so all its pairs are compared.
2. in larger buckets whose rows are not one group after that, rows outside the
   bucket's largest group meet the rows of other groups in tiles of bounded
   size. A tile compares sketches by an upper bound that no true link fails, as
   arrays, and only pairs that pass become rows and are checked exactly.

After that any two rows of a bucket are in one group, have been checked, or
cannot be alike, so no link between groups is lost.

Pairs and tiles grow faster than the input, as chance meetings do. Both are made
in turns of a bounded number of rows, so the disk that their shuffles take does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .store import drop, in_turns, rounds, stage

#: Rows that every turn may send through a shuffle, however small the input.
AT_ONCE = 1 << 21


def components(edges: DataFrame, name: str = "groups") -> DataFrame:
    """(id, comp): the smallest id of each edge end's connected group; ``edges`` has longs a and b.

    Alternates large and small stars, whose messages stay linear in the edges;
    each round is a written table, and a hot node's rows meet only in map-side
    combined minima. The edges of a finished group form a star on its smallest id.
    """
    pairs = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = _mark(pairs)
    while True:
        # every neighbour larger than u is linked to the smallest of u's neighbourhood
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every neighbour smaller than u, and u, is linked to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = stage(small.filter("u != v").distinct(), name)
        drop(pairs)
        pairs, (before, mark) = after, (mark, _mark(after))
        if before == mark:
            break
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Number and two sums of hashes of the rows: equal for equal sets. A star forest is what a round leaves as it is."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)"))
    return tuple(pairs.agg(F.count(F.lit(1)), h(1), h(2)).first())


def link(buckets: DataFrame, check: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column], sketches: Callable[[DataFrame], DataFrame], may: Callable, small: int = 8, tile: int = 384, pairs: DataFrame | None = None, verify: Callable[[DataFrame], DataFrame] | None = None, sift: Callable[[DataFrame], DataFrame] | None = None, at_once: int = 0) -> tuple[DataFrame, DataFrame]:
    """(links, groups) of the rows of ``buckets`` (bucket long, id long, size long; a written table).

    ``near(nx, ny)`` holds for the sizes of any true link. ``check`` takes
    distinct candidate pairs (a < b, with sizes na and nb) and returns the true
    ones as (a, b, ...). ``sketches`` takes a table of distinct ids (id) and returns
    (id, sketch binary of one length) of these at least;
    ``may(x, nx, y, ny)`` says for each row of ``x`` and the same of ``y`` (sketches
    as matrices of bytes, and sizes) whether the pair can be a link. ``pairs`` (a < b, na, nb)
    are candidates besides those of the buckets. ``verify`` takes the place of ``check`` for
    pairs that ``may`` has let through. ``sift`` leaves out candidates of the buckets that can't be
    links, before ``check``. About ``at_once`` candidates or rows of tiles are
    shuffled in a turn (0: as many as the rows of ``buckets``), ``AT_ONCE`` at least.
    """
    at_once = max(AT_ONCE, at_once or buckets.count())
    stats = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "size")).alias("head")).filter("n > 1")
    parts = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / small))).cast("long"))
    members = stage(buckets.join(stats, "bucket").withColumn("sub", F.pmod(F.xxhash64("id"), parts)), "link-members")
    found = (_distinct(_near_by(some, near, small)) for some in in_turns(members, members.count() * (small // 2 + 1), at_once, "bucket"))
    near_by = rounds(map(sift, found) if sift else found, "link-near")
    links = stage(check(_distinct(near_by.unionByName(pairs) if pairs is not None else near_by)), "links")
    drop(near_by)
    groups = stage(components(links), "link-groups")
    rest = stage(_open(members.filter(f"n > {small}").select("bucket", "id", "size"), groups), "link-open")
    drop(members)
    if rest.isEmpty():
        drop(rest)
        return links, groups
    ids = stage(rest.groupBy("main", "id").agg(F.first("size").cast("long").alias("size"), F.first("comp").alias("comp"), F.collect_list("bucket").alias("buckets")), "link-ids")
    drop(rest)
    fine = sketches(ids.select("id").distinct())
    tiled = rounds(_tiles(ids, fine, may, tile, at_once), "link-tiled")
    drop(ids, fine)
    more = stage((verify or check)(_distinct(tiled)), "links")
    drop(tiled)
    if not more.isEmpty():
        stars = groups.filter("id != comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
        before, groups = groups, stage(components(stars.unionByName(more.select("a", "b"))), "link-groups")
        drop(before)
    return links.unionByName(more).distinct(), groups


def _tiles(ids: DataFrame, sketches: DataFrame, may: Callable, tile: int, at_once: int) -> Iterator[DataFrame]:
    """Pairs of rows of different groups of a bucket, one outside its largest group, that may be links; in turns of some tiles each.

    Rows that are alike share many buckets, whose largest group is mostly the
    same. Tiles are cut by that group and the rows' ids, so a pair meets in one
    tile in all of these buckets and is given once, and a tile gets a row once on
    each side, with all of its buckets (``ids``: main, id, size, comp, buckets).
    """
    sizes = ids.groupBy("main").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("comp") != F.col("main")).alias("outer"))
    sizes = sizes.select("main", "all", "outer", F.ceil(F.col("all") / tile).alias("wide"), F.ceil(F.col("outer") / tile).alias("high"))
    n_rows = sizes.agg(F.sum(F.expr("all * high + outer * wide"))).first()[0]
    sizes = sizes.select("main", "wide", "high")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    outer = F.transform(F.filter(upto("wide"), lambda j: F.col("comp") != F.col("main")), lambda j: F.struct(number("high").alias("i"), j.alias("j"), F.lit(1).alias("inner")))
    inner = F.transform(upto("high"), lambda i: F.struct(i.alias("i"), number("wide").alias("j"), F.lit(0).alias("inner")))
    at = ["main", "i", "j"]
    places = lambda t: np.stack([t.column(c).to_numpy() for c in at], axis=1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # a tile's rows are few: tile ids a side, each with its buckets
            held.append(batch)
            t = pa.Table.from_batches(held).combine_chunks()
            same = (places(t) == places(t)[-1:]).all(axis=1)
            whole = int(np.argmax(same)) if len(same) else 0
            if whole:
                yield from _compared(t.slice(0, whole), places(t)[:whole], may)
            held = t.slice(whole).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from _compared(t, places(t), may)
        del held
        B.release()

    rows = ids.join(sizes, "main").join(sketches, "id").withColumn("place", F.explode(F.concat(outer, inner))).select("main", "place.*", "id", "size", "comp", "buckets", "sketch")
    for some in in_turns(rows, n_rows, at_once, *at):
        yield some.repartition(*at).sortWithinPartitions(*at).mapInArrow(compare, "a long, b long, na long, nb long")


#: Pairs whose ids, and whose sketches, are compared at once.
_PAIRS, _SKETCHED = 1 << 20, 1 << 15


def _compared(t: pa.Table, tile: np.ndarray, may: Callable) -> Iterator[pa.RecordBatch]:
    """The pairs of each tile of ``t``, whose rows are ordered by tile; each pair once."""
    if not t.num_rows:
        return
    get = lambda name: t.column(name).to_numpy()
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    # a row for each bucket, by tile, bucket and side
    number = np.cumsum(np.r_[False, (tile[1:] != tile[:-1]).any(axis=1)])
    row = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column("buckets")).to_numpy())
    bucket = pc.list_flatten(t.column("buckets")).to_numpy()
    order = np.lexsort((get("inner")[row], bucket, number[row]))
    row, bucket = row[order], bucket[order]
    own, sizes = get("id"), get("size")
    ident, comp, main, out = (get(c)[row] for c in ("id", "comp", "main", "inner"))
    out, number = out == 1, number[row]
    head = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (bucket[1:] != bucket[:-1])])
    of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(row)]))
    n = np.bincount(of[~out], minlength=len(head))  # rows of the inner side, which come first
    x = np.flatnonzero(out)
    upto = np.cumsum(n[of[x]])
    found = []
    for part in np.split(x, np.searchsorted(upto, np.arange(_PAIRS, int(upto[-1]) if len(x) else 0, _PAIRS))):
        if not len(part):
            continue
        width = n[of[part]]
        r = np.repeat(part, width)
        c = np.repeat(head[of[part]] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        good = (comp[r] != comp[c]) & ((comp[c] == main[r]) | (ident[r] < ident[c]))
        # a pair has one order, so the two rows' numbers tell it
        both = np.sort(row[r[good]] * t.num_rows + row[c[good]])
        r, c = np.divmod(both[np.r_[True, both[1:] != both[:-1]][: len(both)]], t.num_rows)
        for k in range(0, len(r), _SKETCHED):
            y, z = r[k : k + _SKETCHED], c[k : k + _SKETCHED]
            some = may(sketch[y], sizes[y], sketch[z], sizes[z])
            y, z = y[some], z[some]
            swap = own[y] > own[z]
            found.append((np.where(swap, z, y), np.where(swap, y, z)))
    if found:
        a, b = (np.concatenate(v) for v in zip(*found, strict=True))
        once = np.lexsort((own[b], own[a]))
        a, b = a[once], b[once]
        new = np.r_[True, (own[a][1:] != own[a][:-1]) | (own[b][1:] != own[b][:-1])][: len(a)]
        a, b = a[new], b[new]
        for k in range(0, len(a), _SKETCHED):
            x, y = a[k : k + _SKETCHED], b[k : k + _SKETCHED]
            yield pa.record_batch({"a": pa.array(own[x]), "b": pa.array(own[y]), "na": pa.array(sizes[x]), "nb": pa.array(sizes[y])})


def _near_by(members: DataFrame, near: Callable[[Column, Column], Column], small: int) -> DataFrame:
    """The pairs of the first round."""
    to_head = members.filter(f"n > {small} and id != head.id").filter(near(F.col("head.size"), F.col("size")))
    to_head = to_head.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.size").alias("na"), F.col("size").alias("nb"))
    return to_head.unionByName(_within(members, near))


def _within(members: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs a < b of the rows of each sub-bucket that are near. Sub-buckets hold few rows: a hash splits larger buckets."""
    lists = members.groupBy("bucket", "sub").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("all")).filter("size(all) > 1")

    def later(x: Column, i: Column) -> Column:
        return F.transform(F.filter(F.slice("all", i + 2, F.size("all")), lambda y: near(x["size"], y["size"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), x["size"].alias("na"), y["size"].alias("nb")))

    return lists.select(F.explode(F.flatten(F.transform("all", later))).alias("p")).select("p.*")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"))


def _open(large: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of large buckets that lie in several groups, with each row's group and the bucket's largest one."""
    named = large.join(groups, "id", "left").select("bucket", "id", "size", F.coalesce("comp", "id").alias("comp"))
    counted = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("top")).filter("comps > 1")
    return named.join(main.select("bucket", F.col("top.comp").alias("main")), "bucket")

"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is some documents of one Arrow batch, so nothing is shuffled and a lost
task is simply run again. Only words that the benchmark has can be
part of a verbatim match, so the shard's suffix array covers the runs of such
words, as long as the shortest window at least, with a mark between runs. It is
built by prefix doubling to a depth above the window; every benchmark suffix is
then looked up by binary search, all of them in step. Consecutive hits of one
passage on one diagonal join to longest verbatim matches with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .store import free_name, map_batches, stage

LEAK = "n_words long, hits array<struct<begin:long,end:long>>, items array<string>, longest struct<item:string,item_word:long,word:long,length:long>"


@dataclass
class TestSet:
    """Windows of one block of benchmark items: their words as codes from 1 over a sorted vocabulary."""

    names: list[list[str]]  # of the items that share a text
    vocabulary: np.ndarray
    codes: np.ndarray  # windows x window, 0 beyond a short window
    length: np.ndarray  # of each window
    item: np.ndarray
    place: np.ndarray  # of the window in its item
    marks: np.ndarray  # by the top bits of a word's hash: whether the vocabulary may have it

    @classmethod
    def of(cls, items: list[tuple], window: int) -> TestSet:
        same: dict[str, list[str]] = {}  # equal items are looked for once
        for k, t in items:
            same.setdefault(t, []).append(str(k))
        batch = pa.record_batch({"text": pa.array(list(same), pa.string())})
        names, words = [sorted(x) for x in same.values()], []
        for _, buf, at in B.blocks(batch, "text"):
            low = B.LOWER[buf]
            s, e = B.spans(low, B.ALNUM)
            h, (_, first) = B.hashes(low, s, e), B.owners(s, at)
            words += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *words]))
        codes, length, item, place = [], [], [], []
        for k, w in enumerate(words):
            if len(w):
                size = min(window, len(w))
                c = np.searchsorted(vocabulary, w) + 1
                rows = np.zeros((len(w) - size + 1, window), np.int32)
                rows[:, :size] = np.lib.stride_tricks.sliding_window_view(c, size)
                codes.append(rows)
                length.append(np.full(len(rows), size))
                item.append(np.full(len(rows), k))
                place.append(np.arange(len(rows)))
        join = lambda x, like: np.concatenate(x) if x else like
        none = np.empty(0, np.int64)
        marks = np.zeros(1 << 20, bool)
        marks[vocabulary >> np.uint64(44)] = True
        return cls(names, vocabulary, join(codes, np.empty((0, window), np.int32)), join(length, none), join(item, none), join(place, none), marks)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of ``text``'s suffixes in the order of their first ``depth`` codes or more."""
    rank, k = text.astype(np.int64), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return np.argsort(rank, kind="stable")


#: Patterns that are searched for in step.
_STEP = 1 << 15


def search(text: np.ndarray, order: np.ndarray, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern, the range of ``order`` whose suffixes begin with it."""
    if len(codes) > _STEP:
        parts = [search(text, order, codes[a : a + _STEP], length[a : a + _STEP]) for a in range(0, len(codes), _STEP)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    depth = codes.shape[1]
    padded = np.concatenate([text, np.zeros(depth, np.int64)])
    step = np.arange(depth)
    free = step >= length[:, None]

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), len(order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            diff = padded[order[np.minimum(mid, len(order) - 1)][:, None] + step] - codes
            diff[free] = 0
            first = diff[np.arange(len(diff)), np.argmax(diff != 0, axis=1)]
            below = (first <= 0 if upper else first < 0) & open_
            low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low

    return bound(False), bound(True)


def _reduced(word: np.ndarray, owner: np.ndarray, tests: TestSet, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of benchmark words, each followed by 0, and each code's word number (-1 for 0)."""
    maybe = np.flatnonzero(tests.marks[word >> np.uint64(44)])
    at = np.minimum(np.searchsorted(tests.vocabulary, word[maybe]), len(tests.vocabulary) - 1)
    real = tests.vocabulary[at] == word[maybe]
    maybe, at = maybe[real], at[real]
    cut = np.flatnonzero((np.diff(maybe) != 1) | (np.diff(owner[maybe]) != 0)) + 1
    begin, end = np.r_[0, cut], np.r_[cut, len(maybe)]
    keep = end - begin >= least
    size = (end - begin)[keep]
    out, where = np.zeros(int(size.sum()) + len(size), np.int64), np.full(int(size.sum()) + len(size), -1)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(size + 1) - 1] = False
    chosen = np.repeat(keep, end - begin)
    out[inner], where[inner] = at[chosen] + 1, maybe[chosen]
    return out, where


def _scan(words: list[np.ndarray], owners: list[np.ndarray], firsts: np.ndarray, tests: TestSet) -> list[tuple]:
    """For each text of a shard: (hit ranges, item names, longest match)."""
    n = len(firsts) - 1
    empty = ([], [], None)
    if not len(tests.codes):
        return [empty] * n
    least, base, texts, places = int(tests.length.min()), 0, [], []
    for w, o in zip(words, owners, strict=True):
        t, p = _reduced(w, o, tests, least)
        texts.append(t)
        places.append(np.where(p >= 0, p + base, -1))
        base += len(w)
    text, place = np.concatenate(texts), np.concatenate(places)
    if not len(text):
        return [empty] * n
    order = suffix_array(text, tests.codes.shape[1])
    low, high = search(text, order, tests.codes, tests.length)
    found = np.flatnonzero(high > low)
    if not len(found):
        return [empty] * n
    count = (high - low)[found]
    pattern = np.repeat(found, count)
    at = order[np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    word = place[at]  # number of the first word of each occurrence in the shard
    doc = np.searchsorted(firsts, word, side="right") - 1
    size, item, start = tests.length[pattern], tests.item[pattern], tests.place[pattern]
    # longest matches: occurrences that follow each other on a diagonal of an item
    by = np.lexsort((word, word - start, item, doc))
    d, i, s, w, z = doc[by], item[by], start[by], word[by], size[by]
    new = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (w[1:] - s[1:] != w[:-1] - s[:-1]) | (w[1:] != w[:-1] + 1)]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(by)] - 1
    length = w[tail] + z[tail] - w[head]
    best: dict[int, tuple] = {}
    for k in np.lexsort((w[head], i[head], -length)):
        a = head[k]
        best.setdefault(int(d[a]), {"item": tests.names[i[a]][0], "item_word": int(s[a]), "word": int(w[a] - firsts[d[a]]), "length": int(length[k])})
    # hit ranges
    by = np.lexsort((word, doc))
    d, a, e = doc[by], word[by], (word + size)[by]
    reach = np.maximum.accumulate(e)  # words of later documents have larger numbers
    new = np.r_[True, (d[1:] != d[:-1]) | (a[1:] > reach[:-1])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(by)] - 1
    hits: dict[int, list] = {}
    for x, b, c in zip(d[head].tolist(), a[head].tolist(), reach[tail].tolist(), strict=True):
        hits.setdefault(x, []).append({"begin": b - int(firsts[x]), "end": c - int(firsts[x])})
    named: dict[int, set] = {}
    pair = np.unique(doc * len(tests.names) + item)
    for x, k in zip((pair // len(tests.names)).tolist(), (pair % len(tests.names)).tolist(), strict=True):
        named.setdefault(x, set()).update(tests.names[k])
    return [(hits[x], sorted(named[x]), best[x]) if x in hits else empty for x in range(n)]


def _merge(parts: list[tuple]) -> tuple:
    """One text's findings from several blocks of items."""
    if len(parts) == 1:
        return parts[0]
    ranges: list[dict] = []
    for r in sorted((r for p in parts for r in p[0]), key=lambda r: (r["begin"], r["end"])):
        if ranges and r["begin"] <= ranges[-1]["end"]:
            ranges[-1]["end"] = max(ranges[-1]["end"], r["end"])
        else:
            ranges.append(dict(r))
    longest = min((p[2] for p in parts if p[2]), key=lambda m: (-m["length"], m["item"], m["word"]), default=None)
    return ranges, sorted({x for p in parts for x in p[1]}), longest


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of ``block_bytes`` of text each, one item at least; equal ones follow each other."""
    block, size = [], 0
    items = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t")).filter("t is not null").orderBy("t", "k")
    for k, t in items.toLocalIterator():
        if size >= block_bytes and t != block[-1][1]:
            yield block
            block, size = [], 0
        size += len(t.encode()) if not block or t != block[-1][1] else 0
        block.append((k, t))
    if block:
        yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, blocks: int = 4, column: str = "leak"
) -> DataFrame:
    """``docs`` with a struct ``column``: n_words, hits (merged word ranges), items, longest verbatim match.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A window is ``window`` consecutive words of an item, or all of a shorter one
    that has any. Null text has no words; null items and items without words
    match nothing; equal items are all named. Ties of the longest match go to
    the first item of the block, then the first place. All columns of ``docs``
    are kept; one that is called ``column`` is replaced. Rows that repeat are
    judged alike; an empty table gives no rows; a text is one shard at most, so a
    very long one takes memory in proportion to its length.

    The benchmark goes in blocks of ``block_bytes`` of text. A worker holds at
    most ``blocks`` of them; for a larger benchmark the documents are written
    with what was found and gone through once more for each further ``blocks``.
    """
    docs, spark = docs.drop(column), docs.sparkSession
    fields = docs.schema.fields
    made = T.StructType([*fields, T.StructField(column, T.StructType.fromDDL(LEAK))])
    rest = test_blocks(benchmark, item_col, item_text_col, block_bytes)
    some = list(islice(rest, blocks)) or [[]]
    while some:
        tests = [spark.sparkContext.broadcast(TestSet.of(x, window)) for x in some]
        some = list(islice(rest, blocks))
        docs = map_batches(docs, _scanner(tests, text_col, column), made)
        if some:
            docs = stage(docs, "leaks")
            for t in tests:
                t.unpersist()
    return docs


#: Bytes of a shard's texts, about; a longer text is a shard of its own.
_SHARD = 4 * B.BLOCK_BYTES
#: Bytes of the texts whose words are found at once.
_PART = 1 << 18


def _scanner(tests: list, text_col: str, column: str):
    """A map over batches that adds ``column``, or adds to it what these tests find."""
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())]))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in B.blocks(batch, text_col, _SHARD):
                yield shard(part)
        B.release()

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, owners, counts, base = [], [], [], 0
        for _, buf, at in B.blocks(batch, text_col, _PART):
            low = B.LOWER[buf]
            s, e = B.spans(low, B.ALNUM)
            owner, first = B.owners(s, at)
            words.append(B.hashes(low, s, e))
            owners.append(owner + base)
            counts.append(np.diff(first))
            base += len(at)
        n_words = np.concatenate(counts)
        firsts = np.r_[0, np.cumsum(n_words)]
        found = [_scan(words, owners, firsts, t.value) for t in tests]
        if column in batch.schema.names:
            found.append([(x["hits"], x["items"], x["longest"]) for x in batch.column(column).to_pylist()])
            batch = batch.drop_columns([column])
        leaks = [{"n_words": n, "hits": h, "items": i, "longest": m} for n, (h, i, m) in zip(n_words.tolist(), (_merge(list(x)) for x in zip(*found, strict=True)), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, kind)], names=[*batch.schema.names, column])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **named) -> DataFrame:
    """The rows of ``docs`` without those in which any window of the benchmark occurs."""
    leak = free_name(docs, "leak")
    return find_leaks(docs, benchmark, window, column=leak, **named).filter(F.size(f"{leak}.hits") == 0).drop(leak)

"""What a Python worker holds beside the executor's heap."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestrata.llm import bitmap, blocks, language_id, near_dedup, tokens
from lodestrata.llm.queries import tokenizer_path


def test_language_blocks_are_small():
    model = language_id.Model(list("abcd"), np.zeros((1 << 16, 4)), np.zeros(4), 0.1, np.ones(1 << 16, bool), 0.0)
    batch = pa.record_batch({"text": pa.array(["some words of a text " * 50] * 2000)})
    tracemalloc.start()
    n = 0
    for rows, buf, at in blocks.blocks(batch, "text", language_id._BLOCK):
        n += len(model.predict(buf, at, rows.column("text").to_pylist())[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    blocks.release()
    assert n == 2000 and peak < 64 << 20


def test_points_of_short_texts_are_made_in_parts():
    # 20,000 texts of 18 shingles: all points of a round at once are 11.5 million numbers, several times over
    rng = np.random.default_rng(1)
    texts, size = 20_000, 18
    gram, owner = rng.integers(0, 1 << 63, texts * size).astype(np.uint64), np.repeat(np.arange(texts), size)
    count = np.ones(texts * size, np.int64)
    tracemalloc.start()
    got = near_dedup.signatures(gram, owner, count, texts, 125)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    few = 500 * size
    assert (got[:500] == near_dedup.signatures(gram[:few], owner[:few], count[:few], 500, 125)).all()
    assert peak < 160 << 20


def test_near_dedup_sends_no_text_that_stays(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('word', cast(id % 200 as string), ' '), 400 + cast(id % 200 as int)) as text")
    kept = near_dedup.near_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    keys = spark.range(0, 200, 7)
    ids = lambda outside: {r.id for r in bitmap.sieve(spark.range(500), "id", keys, 29, outside).collect()}
    assert ids(True) | ids(False) == set(range(500)) and not ids(True) & ids(False)
    assert {r.id for r in keys.collect()} <= ids(False) and len(ids(False)) < 40
    # the rows that stay come from a scan that no exchange of rows lies above
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftAnti") == 1


def test_texts_are_encoded_in_small_blocks():
    batch = pa.record_batch({"text": pa.array([f"text {k} of some words and 12 numbers, " * 60 for k in range(2000)])})
    tokens.encoder(tokenizer_path())
    tracemalloc.start()
    n = sum(rows.num_rows for rows, _, _ in tokens.encoded(batch, "text", tokenizer_path()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < 24 << 20

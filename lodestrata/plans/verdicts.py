"""The costly, pluggable verdict step: variants out, model answers in, verdicts merged.

A client is a function of (model, image, prompt) to text; the default one is a
deterministic stub, since nothing here reaches a network. Calls run in
``mapInPandas``: parallelism is the number of partitions, and order is restored
by key. Rows should be filtered and ranked before this step.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import kernels as K
from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import select as P
from . import tables as T

Client = Callable[[str, bytes | None, str], str]
FINDINGS = "array<struct<type: string, zone: string, color: string, man_made: string, confidence: double, description: string>>"
ANSWER = f"objects_found boolean, confidence double, findings {FINDINGS}, terrain string, visibility string, zones_of_interest array<string>"


def stub(model: str, image: bytes | None, prompt: str) -> str:
    """An answer that depends on its inputs alone."""
    n = zlib.crc32((image or b"") + prompt.encode() + model.encode())
    found = n % 3 == 0
    finding = {"type": "object", "zone": f"Z{n % 9 + 1}", "color": ("orange", "grey", "blue")[n % 5 % 3], "confidence": n % 100 / 100, "description": "stub"}
    return "Answer: " + json.dumps({"objects_found": found, "confidence": n % 100 / 100, "findings": [finding] if found else [], "terrain": "rock", "visibility": "good", "zones_of_interest": []})


def variants_to_ask(full: bool) -> tuple[str, ...]:
    """v3 alone, or the original and v1 to v3; v4 is never asked about."""
    return ("orig", "v1", "v2", "v3") if full else ("v3",)


def tasks(scenes: DataFrame, full: bool) -> DataFrame:
    """One row a scene and variant."""
    return scenes.withColumn("variant", F.explode(F.array(*(F.lit(v) for v in variants_to_ask(full))))).withColumn("variant_order", F.when(F.col("variant") == "orig", 0).otherwise(F.substring("variant", 2, 1).cast("int")))


def ask(rows: DataFrame, client: Client, model: str, prompt: str = "prompt", image: str | None = None, parallel: int = 0, most_errors: int = 3) -> DataFrame:
    """``rows`` with answer, llm_time and error.

    After ``most_errors`` failures in a row a partition asks no more and marks
    the rest; a success starts the count anew.
    """
    if parallel:
        rows = rows.repartition(parallel)
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                began = time.perf_counter()
                answer = error = None
                if failed >= most_errors:
                    error = "skipped after repeated errors"
                else:
                    try:
                        answer, failed = client(model, r[image] if image else None, r[prompt]), 0
                    except Exception as e:  # any failure of a remote model is a result of its own
                        error, failed = str(e) or type(e).__name__, failed + 1
                out.append((answer, round(time.perf_counter() - began, 3), error))
            yield batch.assign(**{c: [x[k] for x in out] for k, c in enumerate(("answer", "llm_time", "error"))})

    return rows.mapInPandas(run, f"{fields}, answer string, llm_time double, error string")


def with_images(rows: DataFrame, pictures: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` (with ``variant``) with ``image``: the PNG of that variant of the scene's picture.

    ``pictures`` has ``by`` and the image source's height, width, nChannels and
    data; a row without a picture has none. A picture is sent once a variant and
    enhanced where it is asked about, so no enhanced picture is kept.
    """

    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [None if r["data"] is None else K.png(K.enhanced(K.decode(bytes(r["data"]), int(r["height"]), int(r["width"]), int(r["nChannels"])), r["variant"])) for r in batch.to_dict("records")]
            yield batch[names].assign(image=made)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    joined = rows.join(pictures.select(*by, "height", "width", "nChannels", "data"), list(by), "left")
    return joined.mapInPandas(run, f"{fields}, image binary")


def asked_once(rows: DataFrame, by: Sequence[str], path: str, stage: str, asker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``asker(rows)`` without the image, each row asked about once however often the answers are read.

    Answers are appended below ``path`` before anything reads them. Rows (by
    ``by`` and variant) that have an answer there without an error are not asked
    again, so a run that was stopped goes on where it was; of several answers
    the one without an error counts, else the last in order of text.
    """
    spark, at = rows.sparkSession, f"{path}/{stage}"
    keys = [*by, "variant"]
    if T.exists(spark, at):
        done = spark.read.parquet(at).filter("error is null").select(*keys).distinct()
        rows = rows.join(done, keys, "left_anti")
    asker(rows).drop("image").write.mode("append").parquet(at)
    every = spark.read.parquet(at)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col("error").isNotNull(), F.coalesce("error", F.lit("")), "answer")).alias("a"))
    return best.select(*keys, "a.*")


def verdicts(asked: DataFrame, model: str) -> DataFrame:
    """Answers as verdict columns; text without JSON stays as ``raw``, 3000 characters of it."""
    p = S.parsed("answer", ANSWER)
    rest = [c for c in asked.columns if c != "answer"]
    r = p["result"]
    return asked.select(*rest, F.coalesce(r["objects_found"], F.lit(False)).alias("found"), r["confidence"].alias("confidence"), F.coalesce(r["findings"], F.array().cast(FINDINGS)).alias("findings"), r["terrain"].alias("terrain"), r["visibility"].alias("visibility"), p["raw"].alias("raw"), F.lit(model).alias("llm_model"))


def two_stages(rows: DataFrame, client: Client, vision_model: str, reasoning_model: str, image: str | None = None, **named) -> DataFrame:
    """Describe the image, then conclude from the description. An error of either keeps the description."""
    seen = ask(rows.withColumn("describe_prompt", F.lit(DESCRIBE)), client, vision_model, "describe_prompt", image, **named)
    seen = seen.withColumnRenamed("answer", "described").withColumnRenamed("llm_time", "describe_time").withColumnRenamed("error", "describe_error").drop("describe_prompt")
    asked = ask(seen.drop(*([image] if image else [])).withColumn("conclude_prompt", F.concat_ws("\n\n", F.coalesce("described", F.lit("")), "prompt")), client, reasoning_model, "conclude_prompt", **named)
    return asked.withColumn("llm_time", F.col("llm_time") + F.col("describe_time")).withColumn("error", F.coalesce("describe_error", "error")).drop("conclude_prompt", "describe_time", "describe_error")


#: Prompts, in our own words.
DESCRIBE = "List what the picture shows, zone by zone (Z1 to Z9, left to right, top to bottom): kind, colour, size. Answer in JSON with elements, terrain and visibility."
CONCLUDE = "Say whether anything does not belong to the landscape. Answer in JSON with objects_found, confidence, findings, terrain, visibility and zones_of_interest."


def prompts(rows: DataFrame, context: str) -> DataFrame:
    """``prompt``: the question and the context's fields that aren't empty."""
    labels = (("Mission", "context"), ("Natural here", "natural_list"), ("Look for", "priority_signals"), ("Targets", "target_objects"), ("Platform", "platform_notes"), ("Colours", "color_shift_notes"))
    block = S.labelled_lines(*((k, F.col(f"{context}.{f}")) for k, f in labels))
    return rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(CONCLUDE), F.nullif(block, F.lit(""))))


def merge(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """One verdict a scene over its variants, with tagged findings and the results by variant."""
    each = F.map_from_entries(F.sort_array(F.collect_list(F.struct("variant", F.struct("found", "confidence", "error")))))
    return results.groupBy(*by).agg(*A.verdict_columns("variant_order"), A.findings_column("variant_order"), each.alias("variant_results"), F.max("error").alias("error"))


def deep_candidates(scenes: DataFrame, budget: int, by: Sequence[str], time_column: str, mode: str = "fast") -> DataFrame:
    """Scenes for the deep model: positives (with ``mode='chancepeek'`` all), the most promising within the budget, by time."""
    positive = S.is_positive("found", "confidence")
    pool = P.positives_then_negatives(scenes, positive)
    if mode == "fast":
        pool = pool.filter("source_rank = 0")
    scored = pool.withColumn("priority", S.priority("findings", "color_zones"))
    return P.budget_topk(scored, "priority", time_column, budget, by)


def generate_context(descriptions: DataFrame, client: Client, model: str) -> DataFrame:
    """A mission context from a free description: every field a string, missing ones empty."""
    fields = [c.split()[0] for c in schemas.CONTEXT.split(", ")]
    asked = ask(descriptions.withColumn("prompt", F.concat(F.lit("Describe this mission in JSON with " + ", ".join(fields) + ": "), "description")), client, model)
    r = F.from_json(S.json_span("answer"), schemas.CONTEXT)
    return asked.select(*descriptions.columns, *(S.text_or_empty(r[f]).alias(f) for f in fields), "error")

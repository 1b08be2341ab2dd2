"""One query for each operator of this subpackage, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, sharding, substring_dedup, token_records, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

URL_RULES = [
    url_filter.Rule.parse("allow", "org/"),
    url_filter.Rule.parse("block", "example.org/es/"),
    url_filter.Rule.parse("block", "example.org/en/1"),
    url_filter.Rule.parse("allow", "com/fr/"),
    url_filter.Rule.parse("block", "com/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, model)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.find_line_copies(_table(spark, sf_dir, "documents"), 0.8)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "removed")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The id that ends each document.
END_ID = 2


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def language_model(docs: DataFrame) -> language_id.Model:
    """Trained on the rows that are not held out."""
    return language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, 1024)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = near_dedup.near_groups(_table(spark, sf_dir, "documents"), 0.8)
    return groups.select(F.col("id").alias("doc_id"), "class_id", "copy_of", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "n_shingles")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark")).drop("text")
    n_hit = F.aggregate("leak.hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return found.select(
        "doc_id", "leak.n_words", n_hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("leak.hits") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM item)
), own AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT low.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM low, (SELECT DISTINCT n FROM item))
), hit AS (
  SELECT doc_id, p, own.n, item_id FROM own JOIN wanted ON own.n = wanted.n AND own.g = wanted.g
), words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, p + unnest(range(n)) AS i FROM hit) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 40)


OP9_SQL = r"""
WITH RECURSIVE step AS (
  SELECT n, 0 AS k, n::BIGINT AS c FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY n) AS crc_of FROM step WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 16 AS size,
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM documents
), e AS (
  SELECT r, doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab
), s AS (
  SELECT r, n, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null') || '/' || (n // 2)::VARCHAR), 1 + 16 * (n % 2), 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM d, (SELECT unnest(range(41))::INT AS n)
), best AS (
  SELECT r, arg_max(n, -1.0 / ln(u)) FILTER (n < 40) AS shard, arg_max(n, -1.0 / ln(u)) AS grown_shard FROM s GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM e JOIN best USING (r)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.find_repeats(_table(spark, sf_dir, "documents"), 50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d)
), least AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM (SELECT doc_id, p, unnest(range(50)) AS k FROM win JOIN least USING (g) WHERE m < doc_id)
), word AS (
  SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_line_dedup": op3_line_dedup,
        "op4_token_records": op4_token_records,
        "op5_language_id": op5_language_id,
        "op6_packing": op6_packing,
        "op7_near_dedup": op7_near_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_sharding": op9_sharding,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op8_decontaminate": OP8_SQL, "op9_sharding": OP9_SQL, "op10_substring_dedup": OP10_SQL}

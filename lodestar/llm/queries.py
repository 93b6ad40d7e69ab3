"""The corpus queries that the driver runs, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The vocabulary file that the encoding query uses.
WORD_VOCABULARY = "word_bpe_49k.json"


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register
def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.sharding import shard_by_bytes

    return shard_by_bytes(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register
def op9_bpe_prefix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestar.llm.bpe import encode_texts

    return encode_texts(documents(spark, sf_dir), str(public_tokenizers.path(WORD_VOCABULARY))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@register
def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.repetition import repetition_quality

    return repetition_quality(documents(spark, sf_dir))


@register
def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.langid import held_out, identify, train_on

    docs = documents(spark, sf_dir)
    return identify(docs, train_on(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@register
def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.webp import read_media, store_texts

    return read_media(store_texts(documents(spark, sf_dir)), carry=("doc_id", "n_bytes")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@register
def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.suffix_dedup import dedup_substrings

    kept = F.octet_length("kept").cast("long")
    return dedup_substrings(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - kept).alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register
def op1_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.minhash import QUERY_RULES, near_duplicates

    return near_duplicates(documents(spark, sf_dir), QUERY_RULES)


@register
def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and the numbers of those."""
    from lodestar.llm.lines import repeated_lines, with_removed

    docs = documents(spark, sf_dir).select("doc_id", "text")
    removed = F.coalesce("__removed", F.array().cast("array<int>"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    counted = docs.select("doc_id", n_lines, F.xxhash64("text").alias("print"))
    return with_removed(counted, repeated_lines(docs), print_col="print").select(
        "doc_id",
        "n_lines",
        F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed_lines"),
    )


@register
def op6_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its bin and place there."""
    from lodestar.llm.packing import pack

    return pack(documents(spark, sf_dir))


@register
def op10_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.pseudo_likelihood import score_corpus

    return score_corpus(documents(spark, sf_dir))


@register
def op11_cluster_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.negatives import mine_negatives
    from lodestar.llm.vectors import LARGEST_FACTOR, fixed_point, usable

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fixed = rows.select("vec_id", label.alias("label"), fixed_point(F.col("embedding"), 256, largest=LARGEST_FACTOR).alias("x"))
    return mine_negatives(fixed, F.col("vec_id") % 100 == 0)


@register
def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.vectors import fixed_point, usable
    from lodestar.llm.whitening import whiten

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    fixed = rows.select("vec_id", fixed_point(F.col("embedding"), 64, 1_000_000).alias("x"))
    return whiten(fixed, "x", 16, ("vec_id",), fill=1_000_000)


@register
def op13_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir)).drop("spans")


# Bytes as hexadecimal digits, two a byte: windows of 50 bytes are 100 digits.
ORACLE_SQL["op4_suffix_levels"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT k, min(doc_id) AS o FROM w GROUP BY k),
r AS (SELECT w.doc_id, p, lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS q FROM w JOIN m USING (k) WHERE o < w.doc_id),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY ALL),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s),
x AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)"""

# CRC-32 by its table: the remainders of all bytes, then one step a byte.
ORACLE_SQL["op7_byte_shards"] = """
WITH RECURSIVE b AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM b WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
   list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, tab),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
p AS (SELECT *, least(15, ((2 * upto - size) * 16) // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM p"""

ORACLE_SQL["op11_cluster_hard_negatives"] = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, coalesce(list_sum(list_transform(list_zip(a.x, v.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND (a.vec_id, a.label, a.x) IS DISTINCT FROM (v.vec_id, v.label, v.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

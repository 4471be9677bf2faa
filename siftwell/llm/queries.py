"""The contract queries, one per operator, each a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, katz, license_scan, near_dup, packing, phrases, pii, quality, secret_scan, sharding, suffix_dedup, url_filter
from .common import scratch_dir, table

#: Rules of the URL query, fixed by its contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: In production the key comes from a secret store; the queries need one fixed value.
PII_KEY = "siftwell-demo-key"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality.*")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    sharding.write_shards(sharding.shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16), path)
    return spark.read.schema("doc_id long, text string, size long, grown_shard int, slot long, shard int").parquet(path).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.labelled_urls(spark), URL_RULES).select("page_id", "url_filter.*")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)
    return replaced.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), F.array_join(F.transform("pii", lambda e: e["kind"]), ",").alias("kinds"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), min_words=50)
    return spans.select("doc_id", "start", "end", "n_words", "first_id")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return katz.score(table(spark, sf_dir, "documents"), held_out, same_each_time=True, order=3)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it leaks."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontam.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)
    packed = packing.pack(pieces, capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    spans, base = F.col("secrets"), [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    base_line = F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(base)), line), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(base_line, 256).alias("base_sha256"),
        F.array_join(F.transform(spans, line), ",").alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, top=2000)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        "score",
    )


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm=80).select("doc_id", "fim.*")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), restored)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_katz": op6_katz,
    "op7_near_dup": op7_near_dup,
    "op8_decontam": op8_decontam,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_licenses": op12_licenses,
    "op13_fim": op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op13_fim": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT), CAST('0x' || substr(h, 17, 8) AS BIGINT), CAST('0x' || substr(h, 25, 8) AS BIGINT)] AS x FROM units
), cuts AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
""",
}

"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, filter_audit, html_text, manifest, minhash_dedup, packing, quality, repeated_spans, toxicity, url_filter, warc, word_bpe
from .common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.token_counts(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages are the captures; days and the lists' logs derive from ids and hosts by integer arithmetic.

    Two categories: hosts of certain name lengths are listed, unlisted and listed again as `host`; first path parts of
    some hosts are listed as `path`.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetched_on", day((F.col("page_id") * 37) % 1461))
    seen = pages.filter("url IS NOT NULL").select(url_filter.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/([^/?#]+)", 1).alias("part"), "page_id")
    hosts = seen.filter("host <> ''").groupBy("host").agg(F.min("page_id").alias("k"))
    parts = seen.filter("host <> '' AND part <> ''").groupBy(F.concat_ws("/", "host", "part").alias("entry")).agg(F.min("page_id").alias("k"))
    change = lambda rows, entry, category, n, action: rows.select(F.col(entry).alias("entry"), F.lit(category).alias("category"), day(n).alias("day"), F.lit(action).alias("action"))
    k, some = F.col("k"), hosts.filter("length(host) % 3 = 0")
    log = (
        change(some, "host", "host", (k * 11) % 400, "add")
        .unionByName(change(some, "host", "host", (k * 11) % 400 + 300, "remove"))
        .unionByName(change(some.filter("length(host) % 2 = 0"), "host", "host", (k * 11) % 400 + 700, "add"))
        .unionByName(change(parts.filter("k % 2 = 0"), "entry", "path", (k * 13) % 900, "add"))
        .unionByName(change(parts.filter("k % 4 = 0"), "entry", "path", (k * 13) % 900 + 200, "remove"))
    )
    return url_filter.filter_urls(captures, log)


URL_SQL = r"""
WITH p AS (SELECT page_id, url, date '2020-01-01' + ((page_id * 37) % 1461)::INT AS fetched_on,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
    coalesce(regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1), '') AS part,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT host, min(page_id) AS k FROM p WHERE host <> '' GROUP BY 1),
q AS (SELECT host || '/' || part AS entry, min(page_id) AS k FROM p WHERE host <> '' AND part <> '' GROUP BY 1),
iv AS (
  SELECT host AS entry, 'host' AS category, (k * 11) % 400 AS a, (k * 11) % 400 + 300 AS b FROM h WHERE length(host) % 3 = 0
  UNION ALL SELECT host, 'host', (k * 11) % 400 + 700, 1000000 FROM h WHERE length(host) % 6 = 0
  UNION ALL SELECT entry, 'path', (k * 13) % 900, CASE WHEN k % 4 = 0 THEN (k * 13) % 900 + 200 ELSE 1000000 END FROM q WHERE k % 2 = 0),
d AS (SELECT row_number() OVER () AS r, *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
keys AS (
  SELECT r, fetched_on, array_to_string(l[i:], '.') AS entry FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM d WHERE host <> '')
  UNION SELECT r, fetched_on, host || '/' || array_to_string(s[1:i], '/') FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM d WHERE host <> '')),
hit AS (SELECT r, count(*) AS n, min(category) AS category FROM keys JOIN iv USING (entry)
  WHERE fetched_on - date '2020-01-01' >= a AND fetched_on - date '2020-01-01' < b GROUP BY r)
SELECT page_id, url, fetched_on, coalesce(n, 0)::BIGINT AS n_entries, category, n IS NOT NULL AS blocked FROM d LEFT JOIN hit USING (r)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_byte_bpe,
        op3_exact_dedup,
        op4_minhash_dedup,
        op5_toxicity,
        op6_suffix_dedup,
        op7_quality_rules,
        op8_html_extraction,
        op9_url_filters,
        op10_packing,
        op11_filter_audit,
        op12_merkle_manifest,
        op13_warc,
    )
}
SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.EXACT_SQL,
    "op7_quality_rules": quality.QUALITY_SQL,
    "op9_url_filters": URL_SQL,
    "op11_filter_audit": filter_audit.AUDIT_SQL,
    "op12_merkle_manifest": manifest.MANIFEST_SQL,
    "op13_warc": warc.WARC_SQL,
}

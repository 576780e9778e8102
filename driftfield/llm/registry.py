"""The queries of the training-data operators, one for each, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm import bpe, decontaminate, html_extract, quality, secrets, sharding, simhash, toxicity, url_filter, warc
from driftfield.llm.shared import table

#: The rules that the URL query judges by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_file() -> str:
    """The tokenizer's file; its place is a parameter (``DRIFTFIELD_TOKENIZER``), by default the installed public one."""
    if own := os.environ.get("DRIFTFIELD_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids each document has, and digests of its ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = bpe.Codec(spark, tokenizer_file(), bpe.frequent_words(docs))
    made = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields
    return bpe.encode_and_decode(docs, codec, made, bpe.counts_and_digests).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, errors=4)
    return found.select("doc_id", simhash.hexed(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of base spans, and all spans, of each document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of each page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, failure bits and verdicts of two policies for each document."""
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality.judged(quality.judged(book, "v1", "kept"), "base", "base_kept")
    return base.select("doc_id", *quality.MEASURES, (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page and its length."""
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and a digest of the benchmark items that occur, for each document."""
    found = decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for each document, from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, by the law of equal counts."""
    rows = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return rows.select("doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata and a conversion record for each page."""
    return warc.derived_records(warc.responses(table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_secret_scans": op3_secret_scans,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
}

ORACLE_SQL = {
    "op7_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS k FROM (SELECT item_id, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
dw AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS k FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT rid, item_id, dw.m, i FROM dw JOIN p ON dw.m = p.m AND dw.k = p.k),
hit AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest(range(0, m)) AS o FROM occ) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(it.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)""",
    "op4_url_filters": r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT rid, page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT rid, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM split)
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(v, length(rh || rp)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY rid, page_id, host, path""",
    "op5_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM docs),
windows AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
m AS (SELECT p.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters
  FROM parts p LEFT JOIN covered c ON p.rid = c.rid),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 16 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_stutters > 30 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b""",
}

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftfield.llm import quality, registry, sharding, url_filter
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op4_url_filters", "op5_quality_rules", "op9_sharding"])
def test_plans_are_native(spark, monkeypatch, name):
    from driftfield.llm import shared

    plans = []
    see = lambda df: plans.append(df._jdf.queryExecution().toString())
    for module in (shared, url_filter, sharding):  # what is cut off or written before the last plan, too
        for way in ("cut", "written"):
            if hasattr(module, way):
                monkeypatch.setattr(module, way, lambda df, *a, own=getattr(module, way): (see(df), own(df, *a))[1])
    see(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert len(plans) == {"op4_url_filters": 3, "op5_quality_rules": 1, "op9_sharding": 3}[name]
    assert not any(re.search("Python|Pandas|Arrow", p) for p in plans)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.b.example.com/en/1", "http://notexample.com/en/1", "http://x.net/es/", "http://x.net", "http://x.net/ES/", "ftp://com/", "http://a.com?x=/en/", "http://É.com/é", "a://b://c/d", "http://example.com:80/en/", "http://x.net/es/", "http://.com/", "http://h\n.com/a\nb"]
RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "block"), ("net", "/e", "allow"), (None, "/", "block"), ("b:", None, "block"), ("com", None, None)]


def verdict(url, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h + (p or "")), len(h), h.lower() + (p or ""), v) for h, p, v in RULES if h and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, default)


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_RULES, 0])
def test_urls_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    monkeypatch.setattr(url_filter, "BROADCAST_PATHS", limit)
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, Host string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: verdict(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("digits", [0, 1])
def test_short_hashes_that_collide_are_told_apart(spark, monkeypatch, digits):
    monkeypatch.setattr(url_filter, "SHORT", digits)  # all or a sixteenth of all expressions lie under one short hash
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: verdict(u) for i, u in enumerate(URLS)}


def test_rules_are_joined_on_the_short_hash_alone(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    paths = spark.createDataFrame([("a.com", "/")], "host string, path string")
    plan = url_filter.judged_paths(paths, url_filter.prepared_rules(rules))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"HashJoin \[([^\]]*)\]", plan)
    assert len(keys) == 2 and all(k.startswith("substring(") and k.endswith(", 1, 8)") for k in keys)


def test_urls_without_rules_or_pages(spark):
    pages, rules = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, rules.where("false")).first()["verdict"] == "allow"
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(6)
    made = ["".join(rng.choice(["a ", "b ", "a\n", "é😀 ", "\t", "## "]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    return [None, "", " \n ", "one", "a b c d e a b c d e", "x " * 3000, "\xa0 \x1c", *made, made[0]]


def test_ledger_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts())], "doc_id long, text string, n_words string")
    book = quality.ledger(df)
    got = {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in book.collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts())}
    assert quality.ledger(df.where("false")).count() == 0


def test_policies_and_ablations_read_bits(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (2,), (3,), (16,), (20,)], "failed_bits long")
    assert quality.judged(book, "base").where("kept").count() == 3 and quality.judged(book, "v1").where("kept").count() == 1
    got = {r["rule"]: tuple(r)[1:] for r in quality.ablations(book, "v1").collect()}
    assert got["few_words"] == (3, 2, 3) and got["repeated_windows"] == (2, 1, 2) and got["many_symbols"] == (1, 0, 1) and got["short_or_long_words"] == (2, 1, 2)
    assert all(tuple(r)[1:] == (0, 0, 0) for r in quality.ablations(book.where("false")).collect())


@pytest.mark.parametrize("n", [0, 1, 5, 23, 24, 25, 301])
def test_shards_hold_every_row_once(spark, n):
    rows = [(i // 2, None if i % 7 == 0 else "" if i % 5 == 0 else "é" * (i % 90), i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    out = sharding.sharded(df, 24, bucket_bytes=500).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(r[:2] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= s < 24 for s in by)
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_follow_from_rows_and_seed_not_from_layout(spark, monkeypatch):
    from driftfield.llm import shared

    rows = [(i, None if i % 9 == 0 else f"text {i % 40}", i % 3 or None) for i in range(700)] + [(5, "copy", None)] * 250 + [(None, None, None), (None, None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("m", F.create_map(F.lit("k"), F.col("n")))
    order = lambda x, seed: sorted(((r["shard"], r["slot"], r["doc_id"], r["text"], r["n"]) for r in sharding.sharded(x, 7, seed=seed, bucket_bytes=4000).collect()), key=lambda r: r[:2])
    a = order(df, 42)
    assert Counter(r[2:] for r in a) == Counter(rows) and len({r[:2] for r in a}) == len(rows)
    assert order(df.repartition(5).orderBy(F.rand(3)), 42) == a and order(df, 43) != a
    monkeypatch.setattr(shared, "COPIES", 7)
    monkeypatch.setattr(shared, "BROADCAST_REPEATS", 0)
    assert order(df.coalesce(1), 42) == a


def test_the_shard_query_equals_brute_force(spark, tmp_path):
    import zlib

    rows = [(i, None if i % 11 == 0 else "é" * (i % 30)) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op9_sharding(spark, str(tmp_path)).collect()
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    by = Counter(r["shard"] for r in got)
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, k) for s, n in by.items() for k in range(n)) and set(by.values()) == {20, 21}


def test_shards_scatter_copies_and_can_be_written(spark, tmp_path):
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    copies = Counter(r["shard"] for r in sharding.sharded(df, 24, bucket_bytes=2000).where("text = 'copy'").collect())
    assert len(copies) == 24 and max(copies.values()) < 40
    sharding.write_shards(df, str(tmp_path / "out"), 8)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)

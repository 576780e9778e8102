import random
import zlib

import numpy as np

from driftfield.llm import toxicity


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 400))
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [word() for _ in range(rng.randint(20, 120))] + ([rng.choice(["vile", "nasty", "scum"]) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(d, toxicity.fit(d, y)).collect()}
    held = [(scores[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(scores) == len(docs) and np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(300, 2)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (toxicity.fit(d, spark.createDataFrame(y, "doc_id long, toxic int")) for y in (labels, turned))
    assert a.features == b.features and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_the_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(0)
    positive = [[0] if rng.random() < 0.9 else [] for _ in range(400)]
    unlabelled = [([0] if rng.random() < (0.9 if i % 5 == 0 else 0.02) else []) for i in range(2000)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 1, 0.2)
    assert 1 / (1 + np.exp(-(w[0] + b))) > 0.7 and 1 / (1 + np.exp(-b)) < 0.15


def test_odd_rows(spark):
    docs, labels = corpus(200, 3)
    rows = [(*r, "x") for r in docs] + [(None, "vile scum", "x"), (900, None, "x"), (901, "", "x"), (901, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    y = spark.createDataFrame(labels + [(None, 1), (5, None), (12345, 1)], "doc_id long, toxic int")
    out = toxicity.scored(d, toxicity.fit(d, y)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(d.where("false"), toxicity.fit(d, y)).count() == 0
    assert toxicity.fit(d, y).features == toxicity.fit(d.union(d), y).features  # a repeated id is learned from once
    for none in (y.where("false"), y.where("toxic = 0")):
        assert 0 <= toxicity.scored(d.limit(1), toxicity.fit(d, none)).first()["score"] < 0.51


def test_the_query_scores_held_out_rows_it_never_saw(spark):
    from driftfield.llm import registry

    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in registry.op8_toxicity(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in out.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(out[r["doc_id"]]["predicted"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95

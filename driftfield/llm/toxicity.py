"""Toxicity by non-negative positive-unlabelled learning with numpy.

Confirmed toxic texts are the positives, texts of whatever kind the unlabelled. The risk estimator corrects the
unlabelled part by the class prior: risk = prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), and
a step that would make the second term negative goes the other way (Kiryo et al., 2017). The classifier is linear over
the presence of words; which of them count is chosen on the cluster by how much more often they stand in positives than in
unlabelled texts. Only chosen features and bounded samples reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.shared import arrow_mapped, byte_sizes, slices, texts_of, worker_tool

#: Bounds of the sample that is fitted on: so many positives and unlabelled texts at most, by the order of a hash of their ids.
POSITIVES, UNLABELLED = 20_000, 40_000
#: Features of a model, and the positives that must have one: so many and this share of them.
FEATURES = 2_048
RARE, RARE_SHARE = 3, 0.005

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_features(text: str | None) -> set[str]:
    """The words of a text in lower case: runs of letters."""
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Weights of named features; the score of a text is the logistic function of their sum over those it has."""

    features: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        margin = np.array([self.weights[r].sum() for r in rows], dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _margins(rows: np.ndarray, which: np.ndarray, n: int, w: np.ndarray, b: float) -> np.ndarray:
    return np.bincount(which, weights=w[rows], minlength=n) + b


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float, steps: int = 400, rate: float = 0.2, decay: float = 2e-5, few: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk under the logistic loss, by Adam over the whole sample.

    Steps shrink to nothing, and weights are held the closer to zero the fewer positives there are.
    Without positives every text gets the prior as its score.
    """
    prior = min(max(prior, 1e-3), 0.999)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return w, b
    flat = [(np.array([i for r in rows for i in r], dtype=np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)) for rows in (positive, unlabelled)]
    decay += few / len(positive)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        (pi, pw, pn), (ui, uw, un) = flat
        gp, gu = _margins(pi, pw, pn, w, b), _margins(ui, uw, un, w, b)
        grad = lambda rows, which, g, scale: np.append(np.bincount(rows, weights=g[which], minlength=n_features), g.sum()) * scale
        plus = grad(pi, pw, -sigmoid(-gp), prior / pn)
        rest = grad(ui, uw, sigmoid(gu), 1 / un) - grad(pi, pw, sigmoid(gp), prior / pn)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        g = plus + rest if negative_risk >= 0 else -rest
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """A model from labels that aren't held out. Labels that are null, or of ids that are null or in no text, say nothing;
    an id with both labels counts as toxic; of rows with the same id the least text is learned from. Without positives, or
    with an empty table of either kind, the model knows the prior alone."""
    i = F.col(f"`{doc_id}`")
    known = labels.select(i.alias("i"), F.col(f"`{toxic}`").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    n, prior = known.agg(F.count("*"), F.avg(F.col("y").cast("double"))).first()
    if not n:
        return Model([], np.zeros(0), 0.0)
    # A cut at the hash that about ``most`` rows lie below keeps what each task sorts and sends in proportion.
    share = lambda most, rows: F.lit(min((1 << 63) - 1, int(((2 * (1.2 * most + 100) / max(1, rows)) - 1) * (1 << 63))))
    drawn = lambda df, most, mark, rows: df.select("i", F.lit(mark).alias("p"), F.xxhash64(F.lit("draw"), "i").alias("h")).where(F.col("h") <= share(most, rows)).orderBy("h", "i").limit(most)
    rows = docs.count()
    ids = drawn(known.where("y = 1"), positives, True, n * prior).union(drawn(docs.select(i.alias("i")).where("i IS NOT NULL").where(~held_out(F.col("i"))), unlabelled, False, 0.8 * rows))
    ids = ids.groupBy("i").agg(F.max("p").alias("positive"), F.max(~F.col("p")).alias("unlabelled"))
    # At most positives + unlabelled ids, hence a known bound.
    sample = docs.select(i.alias("i"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(ids), "i")
    if not sample.groupBy("i").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        sample = sample.groupBy("i").agg(F.min("t").alias("t"), F.first("positive").alias("positive"), F.first("unlabelled").alias("unlabelled"))

    def named(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b in slices(byte_sizes(columns[0]), 1 << 20):
            yield a, b, [pa.array([list(text_features(x)) for x in texts_of(columns[0].slice(a, b - a))], pa.list_(pa.string()))]

    made = arrow_mapped(sample, ["t"], [T.StructField("f", T.ArrayType(T.StringType()))], named).select("positive", "unlabelled", F.explode("f").alias("f"))
    counts = made.groupBy("f").agg(F.sum(F.col("positive").cast("long")).alias("np"), F.sum(F.col("unlabelled").cast("long")).alias("nu"))
    size = ids.agg(F.sum(F.col("positive").cast("double")).alias("a"), F.sum(F.col("unlabelled").cast("double")).alias("b")).first()
    if not size["a"] or not size["b"]:
        return Model([], np.zeros(0), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))))
    # How far the rate among positives is above the unlabelled one, in standard errors.
    rp, ru = F.col("np") / F.lit(size["a"]), (F.col("nu") + 1) / F.lit(size["b"] + 2)
    apart = (rp - ru) / F.sqrt(ru * (1 - ru) * F.lit(1 / size["a"] + 1 / size["b"]) + F.lit(1e-12))
    chosen = [r["f"] for r in counts.where(F.col("np") >= RARE + size["a"] * RARE_SHARE).withColumn("z", apart).where("z > 3").orderBy(F.desc("z"), "f").limit(features).collect()]
    at = {f: k for k, f in enumerate(sorted(chosen))}
    rows = present(sample, sorted(chosen), "t").select("positive", "unlabelled", "present").collect()
    w, b = fit_nnpu([r["present"] for r in rows if r["positive"]], [r["present"] for r in rows if r["unlabelled"]], len(at), prior)
    return Model(sorted(chosen), w, b)


def _finder(features: list[str], key: str):
    """From a text to the places of its features in ``features``, ascending."""
    at = worker_tool(f"toxicity-{key}", lambda: {f: k for k, f in enumerate(features)})
    return lambda text: sorted(at[w] for w in at.keys() & text_features(text))


def _key(features: list[str]) -> str:
    import zlib

    return f"{len(features)}-{zlib.crc32(' '.join(features).encode())}"


def present(docs: DataFrame, features: list[str], text: str = "text", made: str = "present") -> DataFrame:
    """``docs`` with the places of the features that each text has, ascending."""
    key = _key(features)

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        found = _finder(features, key)
        for a, b in slices(byte_sizes(columns[0]), 4 << 20):
            yield a, b, [pa.array([found(x) for x in texts_of(columns[0].slice(a, b - a))], pa.list_(pa.int32()))]

    return arrow_mapped(docs, [text], [T.StructField(made, T.ArrayType(T.IntegerType()))], make)


def scored(docs: DataFrame, model: Model, text: str = "text", made: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, 0 to 1; a null, empty or wordless text has the score of no features.

    One row for every input row, repeated ones included; an empty table gives an empty result; an input column called
    like the score is replaced. Nothing but the text enters a score.
    """
    key = _key(model.features)

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        found = _finder(model.features, key)
        for a, b in slices(byte_sizes(columns[0]), 4 << 20):
            yield a, b, [pa.array(model.scores([found(x) for x in texts_of(columns[0].slice(a, b - a))]), pa.float64())]

    return arrow_mapped(docs, [text], [T.StructField(made, T.DoubleType())], make)

"""Integrity rules: each rule is a query whose rows are its faults (rule, severity, item, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = ["rule", "severity", "item", "message"]


def faults(rows: DataFrame, rule: str, item: Column | str, when: Column | str | None = None, message: Column | str = "", severity: str = "error") -> DataFrame:
    """The rows for which ``when`` holds, as faults."""
    rows = rows if when is None else rows.where(when)
    item = F.col(item) if isinstance(item, str) else item
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), item.cast("string").alias("item"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return faults(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), rule, key, message=F.concat(F.col("n").cast("string"), F.lit(" rows")))


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str, rule: str, item: str | None = None) -> DataFrame:
    """Rows that name something which isn't there; null and empty names name nothing."""
    named = rows.where((F.col(key).isNotNull()) & (F.col(key).cast("string") != ""))
    return faults(named.join(target.select(F.col(target_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti"), rule, item or key, message=F.concat(F.lit("names "), F.col(key).cast("string")))


def not_finite(rows: DataFrame, item: str, fields: list[str], rule: str, infinite_allowed: tuple[str, ...] = ()) -> DataFrame:
    """Fields that are NaN or infinite, a row each; allowed ones may be plus infinity."""
    inf = F.lit(float("inf"))
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x"), F.lit(f in infinite_allowed).alias("ok")) for f in fields])
    each = rows.select(F.col(item).alias("__item"), F.explode(pairs).alias("p")).select("__item", "p.*")
    bad = F.isnan("x") | (F.col("x") == -inf) | ((F.col("x") == inf) & ~F.col("ok"))
    return faults(each, rule, "__item", bad, F.concat(F.col("f"), F.lit(" is not finite")))


def report(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)

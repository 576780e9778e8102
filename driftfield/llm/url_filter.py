"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

Every URL is expanded into the expressions that some rule could have written: first the suffixes of its host at label
boundaries, which meet the hosts of rules; where one does, the prefixes of its path that have a length which this host's
rules have. Both equi-joins compare the first 32 bits of a SHA-256 digest and nothing else; what lies under such a short
hash is then confirmed by the full digest, and the longest confirmed rule decides. A URL pays for its labels and for
path lengths of hosts that rules name, not for rules. Equal hosts and paths are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.shared import cut, lowered, packed, unpacked

#: Rule sets of up to so many rows are broadcast (about 200 bytes a rule); larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
#: The same for judged paths, which grow with the input.
BROADCAST_PATHS = 10_000
#: Hex digits of the digest that the joins compare.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of ``url``; both empty where it is null or has no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.when(rest.isNotNull(), url.substr(F.length(rest) + 4, F.length(url)))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per (``h``, ``p``) with the verdict ``v``. Rows without a host or verdict say nothing and go; where one
    expression has both verdicts, block holds. A null path is the empty one, which fits every path."""
    host, path = lowered(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    return rules.select(host.alias("h"), path.alias("p"), F.col("verdict").alias("v")).where("h <> '' AND v IN ('allow', 'block')").groupBy("h", "p").agg(F.max("v").alias("v"))


def _by_short(table: DataFrame, full: Column, *held: str) -> DataFrame:
    """What lies under each short hash: ``short`` and the array ``under`` of (full digest, held columns). Rows under one
    short hash that are not equal are chance collisions of 32 bits, hence few."""
    each = table.select(full.alias("full"), *held)
    out = each.groupBy(F.substring("full", 1, SHORT).alias("short")).agg(F.collect_list(F.struct("full", *held)).alias("under"))
    return F.broadcast(out) if table.count() <= BROADCAST_RULES else out


def _confirmed(probes: DataFrame, full: str, table: DataFrame, *held: str) -> DataFrame:
    """``probes`` joined on the short hash, and then those entries under it whose full digest is the probe's."""
    found = probes.join(table, F.substring(full, 1, SHORT) == F.col("short"))
    hit = F.get(F.filter("under", lambda x: x["full"] == F.col(full)), F.lit(0))
    return found.withColumn("__hit", hit).where("__hit IS NOT NULL").select(*probes.columns, *[F.col(f"__hit.{c}").alias(c) for c in held])


def judged_paths(paths: DataFrame, ready: DataFrame) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``v`` of the (``host``, ``path``) rows that some rule fits; ``paths`` has each once."""
    hosts = ready.groupBy("h").agg(F.sort_array(F.collect_set(F.length("p"))).alias("lengths"))
    hosts, rules = _by_short(hosts, F.sha2("h", 256), "lengths"), _by_short(ready, _digest(F.col("h"), F.col("p")), "h", "p", "v")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = paths.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix")).where("suffix <> ''").withColumn("full", F.sha2("suffix", 256))
    named = _confirmed(named, "full", hosts, "lengths")
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), n)))
    probes = named.select("host", "path", F.explode(prefixes).alias("full"))
    found = _confirmed(probes, "full", rules, "h", "p", "v")
    rule = F.struct((F.length("h") + F.length("p")).alias("a"), F.length("h").alias("b"), F.concat("h", "p").alias("rule"), F.col("v").alias("v"))
    return found.groupBy("host", "path").agg(F.max(rule).alias("best")).select("host", "path", "best.rule", "best.v")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (text of the longest fitting rule, else null) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins; of equally long
    ones (they can differ only in where the host ends) the one with the longer host. Null URLs and URLs without ``://``
    have an empty host and path and get ``default``, as have all that no rule fits. Repeated rows stay; an empty table
    gives an empty result; input columns called like a made one are replaced by it. Neither table's size is bounded:
    tables are broadcast only up to ``BROADCAST_RULES`` rules and ``BROADCAST_PATHS`` paths. A URL that very many rows have is
    judged once, and the join back splits the rows of a hot key (adaptive skew join).
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    base = pages.select(packed(pages), host.alias("host"), path.alias("path"))
    judged = cut(judged_paths(base.select("host", "path").distinct(), cut(prepared_rules(rules))))
    judged = judged.select(F.col("host").alias("jh"), F.col("path").alias("jp"), "rule", "v")
    judged = F.broadcast(judged) if judged.count() <= BROADCAST_PATHS else judged
    made = base.join(judged, (F.col("host") == F.col("jh")) & (F.col("path") == F.col("jp")), "left").withColumn("verdict", F.coalesce("v", F.lit(default)))
    return unpacked(made, pages.columns, ["host", "path", "rule", "verdict"])

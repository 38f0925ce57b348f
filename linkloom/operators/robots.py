"""robots.txt: rules for all agents, and what they forbid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls

PARTS, NOBODY = 8, 1 << 16  # parts of a site's links, and of links without a site
AGENT = r"(?i)User-agent\s*:\s*\*"
RULE = r"(?i)Disallow\s*:\s*(\S.*)$"


def rules(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, prefix), distinct: the Disallow lines that follow right after a line for all agents.

    A line that ends such a run is spent: it does not begin another. Patterns may stand anywhere in a line; line ends and
    trailing blanks do not count; a Disallow line without a path ends the run. Null hosts, null and empty bodies give none.
    """
    lines = F.transform(F.split(F.col(body), "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\s+$", "")))
    start = F.struct(F.lit(False).alias("run"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        found = state["run"] & line.rlike(RULE)
        return F.struct((found | (~state["run"] & line.rlike(AGENT))).alias("run"), F.when(found, F.concat(state["out"], F.array(F.regexp_extract(line, RULE, 1)))).otherwise(state["out"]).alias("out"))

    found = robots.where(F.col(host).isNotNull() & F.col(body).isNotNull())
    return found.select(F.lower(F.col(host)).alias("host"), F.explode(F.aggregate(lines, start, step)["out"]).alias("prefix")).distinct()


def path_of(url: Column) -> Column:
    """The path of a canonical address, / where it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, urls.ABSOLUTE, 3), F.lit("")), F.lit("/"))


def by_host(rules: DataFrame, match: str = "base_of") -> DataFrame:
    """(host, barred): the beginnings of paths that a site forbids, as many as its robots.txt has.

    base_of: all below the rule's directory, so that a rule without a last slash forbids the directory that holds it. prefix: paths that begin with the rule.
    """
    if match not in ("base_of", "prefix"):
        raise ValueError(f"match {match!r}")
    begin = urls.base_dir(F.col("prefix")) if match == "base_of" else F.col("prefix")
    return rules.groupBy("host").agg(F.collect_set(begin).alias("barred"))


def with_forbidden(links: DataFrame, target: str, rules: DataFrame, match: str = "base_of") -> DataFrame:
    """Adds ``forbidden``: is the canonical address barred by its site's rules? One join by host and a part of its links, as a site may have very many; null
    targets are not forbidden, and are spread over all parts.
    """
    kept = links.columns
    rows = links.withColumn("_host", F.coalesce(urls.host_of(F.col(target)), F.lit(""))).select("*", urls.fenced(path_of(F.col(target))).alias("_path"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*kept), F.when(F.col("_host") == "", F.lit(NOBODY)).otherwise(F.lit(PARTS))).cast("int"))
    barred = by_host(rules, match).select(F.col("host").alias("_host"), "barred", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    hit = F.exists("barred", lambda begin: F.startswith(F.col("_path"), begin))
    return rows.join(barred, ["_host", "_part"], "left").select(*kept, F.coalesce(hit, F.lit(False)).alias("forbidden"))

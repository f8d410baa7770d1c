"""URL filters: expressions of host suffix and path prefix, an equi-join on short hash prefixes, full digests, precedence.

Each distinct URL is expanded into the expressions a rule could have: its host's last n
labels for every number of labels that rules have, with every prefix of its path that is
as long as some rule's path. Expressions meet rules by the first eight hex digits of their
SHA-256; the full digest then confirms. The rule with the longest text wins; of rules with
equal text, a block wins. Without a rule, ``default`` holds.

Null URLs and URLs without ``://`` have an empty host and path and meet no rule that has a host.
Repeated rows each get their verdict. Rules with a null host or path are left out. Both tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.words import quoted
from feedloom.session import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules over this number meet the expressions by a shuffle.
BROADCAST_RULES = 100_000
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, keep: list[str] | None = None, default: str = "allow", url: str = "url") -> DataFrame:
    """The kept columns of every page with host, path, the winning rule (or null) and the verdict.

    A kept column that has the name of a result column gives way to it.
    """
    fresh = ("host", "path", "rule", "verdict")
    keep = [c for c in (keep or ["page_id"]) if c.lower() not in fresh]
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")
    )
    # Host labels are few and path lengths short: two small lists describe all rules.
    shape = listed.agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars"), F.count("*").alias("n")).first()
    digest = F.sha2("rule", 256)
    known = listed.groupBy("rule").agg(F.max("verdict").alias("verdict")).select("rule", "verdict", digest.alias("full"), F.substring(digest, 1, 8).alias("short"))

    rows = pages.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(quoted(url)), F.lit("")).alias("_url"))
    seen = rows.select("_url").distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    suffixes = F.array(*[F.substring_index("host", ".", -n) for n in sorted(shape["labels"])]).cast("array<string>")
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["chars"])]).cast("array<string>")
    ends = F.array_distinct(suffixes)
    starts = F.filter(prefixes, lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    expanded = seen.select("_url", F.explode(expressions).alias("expression")).withColumn("whole", F.sha2("expression", 256))
    known = F.broadcast(known) if shape["n"] <= BROADCAST_RULES else known
    met = expanded.join(known, (F.substring("whole", 1, 8) == F.col("short")) & (F.col("whole") == F.col("full")))
    won = met.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("won"))
    # As a table of its own, the verdicts leave the planner free to split a URL that many pages share.
    judged = rows.join(settle(won, "verdicts"), "_url", "left")
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )

"""URL filter by hashed expressions.

Each distinct (host, path) becomes the expressions a rule could fit: every suffix of the host at a dot, joined with every
prefix of the path at a slash (and at the lengths of rule paths that don't end in one). Expressions and rules meet in an
equi-join on the first 32 bits of their SHA-256; equal full digests confirm. Of the rules that fit, the longest wins, then the one
with the longer host, then block over allow. Suffixes and prefixes longer than any rule's are not made, so a long URL
costs no more than the rules allow.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and the default verdict. An empty host fits
no rule. Rows that repeat get the same answer each. Null rule paths count as empty; rules with a null or empty host are ignored.
Without rules every page gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DEFAULT = "allow"

#: The production rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty for null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER), F.regexp_extract(rest, pattern, 2)


def _digest(expression: Column) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [F.substring(digest, 1, 8).alias("short"), digest.alias("digest")]


def _expressions(host: Column, path: Column, longest_host: int, longest_path: int, lengths: list[int]) -> Column:
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    suffixes = F.filter(suffixes, lambda s: (s != "") & (F.length(s) <= longest_host))
    near = F.slice(steps, F.lit(1), F.least(F.size(steps), F.lit(longest_path + 1)))  # each step of a prefix takes a character
    cuts = F.filter(F.sequence(F.lit(0), F.size(near)), lambda k: (k > 0) & (k < F.size(steps)))
    slashed = F.transform(cuts, lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    slashed = F.filter(slashed, lambda p: F.length(p) <= longest_path)
    other = F.array(F.lit(""), *(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    prefixes = F.array_distinct(F.array_compact(F.concat(slashed, other)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the rule that wins, else null), verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''")
    sizes = rules.agg(
        F.max(F.length("rule_host")).alias("host"),
        F.max(F.length("rule_path")).alias("path"),
        F.array_sort(F.collect_set(F.when(~F.col("rule_path").endswith("/") & (F.col("rule_path") != ""), F.length("rule_path")))).alias("lengths"),  # at most one for each length of a path
    ).first()
    name = F.concat("rule_host", "rule_path")
    priority = F.struct(F.length(name), F.length("rule_host"), F.col("verdict") == "block", name.alias("rule"), F.col("verdict").alias("verdict"))
    listed = rules.select(*_digest(name), priority.alias("priority"))
    host, path = host_and_path(F.col(url_col).cast("string"))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    asked = judged.where("host <> ''").select("host", "path").distinct()
    each = asked.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), sizes.host or 0, sizes.path or 0, sizes.lengths or [])).alias("expression"))
    each = each.select("host", "path", *_digest(F.col("expression")))
    a, b = each.alias("a"), listed.alias("b")
    fits = a.join(b, F.col("a.short") == F.col("b.short")).where(F.col("a.digest") == F.col("b.digest"))
    won = fits.groupBy("host", "path").agg(F.max("priority").alias("won"))
    found = judged.join(won, ["host", "path"], "left")
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
fits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.n = f.n AND f.k = 1
"""

"""URL filters: pattern rules indexed by their rarest literal token; built-in functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits a host, with its subdomains, and paths that start with ``path``; the longest rule that fits decides."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/]*\.)?\Q{self.host}\E\Q{self.path}\E"

    @property
    def tokens(self) -> list[str]:
        # the last token of a path can go on in the url, unless something ends it
        return re.findall("[a-z0-9]+", self.host) + re.findall("[a-z0-9]+(?![a-z0-9]|$)", self.path.lower())


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url; ``tokens`` are whole tokens of every url it fits."""

    action: str
    name: str
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))


def words_rule(action: str, words: str) -> PatternRule:
    """A hyphenated word in the host or path."""
    return PatternRule(action, words, rf"://[^?#]*(?<![a-z0-9])\Q{words}\E(?![a-z0-9])", tuple(words.split("-")))


PATTERN_RULES = tuple(words_rule("block", w) for w in ("spam-farm", "cheap-pills", "free-casino", "adult-dating")) + (
    PatternRule("block", "session", r"[?&]sessionid=[0-9a-f]{16,}", ("sessionid",)),
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return _ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with ``token``: of their literal tokens the one in the fewest urls (of equal ones the first in order)."""
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    best = each.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("best"))
    return rules.join(best, "rule_id").select("rule_id", "rule", "action", "host_rule", "pattern", F.col("best.token").alias("token"))


def url_filter(df: DataFrame, url_col: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """The columns of ``df`` with host, path, rule and verdict.

    ``rule`` is the longest host rule that fits, else null. The verdict is that rule's action; without one, block if
    a blocking pattern and no allowing pattern fits, else allow. A null url, or one without ``://``, has an empty host
    and path and is allowed. Each different url is judged once, so repeated rows cost nothing and get equal verdicts.
    Columns of the result's names are replaced. Every rule needs a literal token.
    """
    spark = df.sparkSession
    rules = [(i, r.name, r.action, isinstance(r, HostRule), r.pattern, list(r.tokens)) for i, r in enumerate([*host_rules, *pattern_rules])]
    if any(not r[5] for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    table = spark.createDataFrame(rules, "rule_id int, rule string, action string, host_rule boolean, pattern string, tokens array<string>")
    host, path = url_parts(F.col("_url"))
    urls = df.select(F.col(url_col).cast("string").alias("_url")).distinct()
    lower = urls.withColumns({"_low": _ascii_lower(F.col("_url")), "_place": F.concat(host, path)})
    lower = lower.withColumn("tokens", F.array_distinct(F.regexp_extract_all("_low", F.lit("[a-z0-9]+"), F.lit(0))))
    index = rule_index(lower, table)
    candidates = lower.select("_url", "_low", "_place", F.explode("tokens").alias("token")).join(index, "token")
    fits = candidates.where(F.expr("IF(host_rule, _place, _low) RLIKE pattern"))
    won = fits.groupBy("_url").agg(
        F.max(F.when(F.col("host_rule"), F.struct(F.length("rule").alias("size"), "rule", "action"))).alias("best"),
        F.max(~F.col("host_rule") & (F.col("action") == "block")).alias("blocked"), F.max(~F.col("host_rule") & (F.col("action") == "allow")).alias("allowed"),
    )
    judged = won.select("_url", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")).alias("verdict"))
    rest = df.drop("host", "path", "rule", "verdict") if url_col not in ("host", "path", "rule", "verdict") else df
    out = rest.withColumn("_url", F.col(url_col).cast("string")).join(judged, "_url", "left")
    return out.withColumns({"host": host, "path": path, "verdict": F.coalesce("verdict", F.lit("allow"))}).select(*rest.columns, "host", "path", "rule", "verdict")


_PATTERNS_SQL = " OR ".join(
    [rf"regexp_matches(low, '://([^?#]*[^a-z0-9?#])?{r.name}([^a-z0-9]|$)')" for r in PATTERN_RULES[:-1]] + [r"regexp_matches(low, '[?&]sessionid=[0-9a-f]{16,}')"]
)
ORACLE = f"""
WITH p AS (
  SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN {_PATTERNS_SQL} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

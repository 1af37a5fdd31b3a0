"""URL filter: rules are found by their rarest literal token, then checked by pattern.

Every rule is a host and a path. Its literal tokens are the labels of its host and the closed
segments of its path; how often each of these tokens occurs in the urls is counted in one
aggregation, and the rule is filed under the rarest. A url's tokens then fetch the few rules filed
under them, and only those run their regular expression. The rules are a parameter (a list held by
the driver and sent as a literal); the urls are never shuffled or exploded for the judging.

Defined results: a null url, or one without ``://``, has an empty host and path and takes the
method's own verdict; repeated rows are judged alike; other columns stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import table

CHECKED = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UNRULED = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Of the host and path, joined by the path's own first slash or by nothing."""
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}(?=/|$){re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting url has: host labels, and segments between slashes."""
        closed = self.path.split("/")[1:-1]
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in closed if x]


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = url.contains("://")
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.when(has, ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)))
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def token_counts(parts: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of a rule occurs; as many rows as the rules have tokens."""
    known = sorted({t for r in rules for t in r.tokens()})
    hits = F.array_intersect("url_tokens", F.array(*[F.lit(t) for t in known]))
    counted = parts.select(F.explode(hits).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def judge(pages: DataFrame, rules: list[Rule], unruled: str = UNRULED) -> DataFrame:
    """page_id, host, path, the longest fitting rule (null if none) and its verdict."""
    rules = [r for r in dict.fromkeys(rules) if r.tokens()]
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "url_tokens", url_tokens(F.col("host"), F.col("path"))
    )
    if not rules:
        none = F.lit(None).cast("string").alias("rule")
        return parts.select("page_id", "host", "path", none, F.lit(unruled).alias("verdict"))
    seen = token_counts(parts, rules)
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens(), key=lambda t: (seen.get(t, 0), t))
        filed.setdefault(rarest, []).append(rule)
    index = F.create_map(
        *[
            part
            for token, found in filed.items()
            for part in (F.lit(token), F.array(*[as_literal(r) for r in found]))
        ]
    )
    fetched = F.flatten(
        F.transform(
            F.array_intersect("url_tokens", F.array(*[F.lit(t) for t in filed])),
            lambda token: F.element_at(index, token),
        )
    )
    whole = F.concat("host", "path")
    fitting = F.filter(
        fetched,
        lambda r: F.col("host").endswith(r["host"]) & F.rlike(whole, r["pattern"]),
    )
    longest = F.array_max(
        F.transform(
            fitting,
            lambda r: F.struct(
                F.length(r["rule"]).alias("size"), r["rule"].alias("rule"),
                r["verdict"].alias("verdict"),
            ),
        )
    )
    found = parts.withColumn("best", longest)
    return found.select(
        "page_id", "host", "path", F.col("best")["rule"].alias("rule"),
        F.coalesce(F.col("best")["verdict"], F.lit(unruled)).alias("verdict"),
    )


def as_literal(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.host).alias("host"), F.lit(rule.pattern).alias("pattern"),
        F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"),
    )


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), [Rule(*r) for r in CHECKED])


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT s.page_id, s.host, s.path, b.r.rule AS rule, coalesce(b.r.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (
  SELECT host, path,
    arg_max({'rule': rule_host || rule_path, 'verdict': rule_verdict},
      length(rule_host || rule_path)) AS r
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
) b ON s.host = b.host AND s.path = b.path
"""

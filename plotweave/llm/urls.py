"""URL filters: hash lookups of host-suffix and path-prefix expressions.

A url is expanded into every suffix of its host at a dot, times every prefix of its path that is as long as the
path of some rule. Expressions and rules meet by an equality join on the first ``PREFIX_HEX`` digits of their
SHA-256; the full digest confirms a meeting, and the longest confirmed rule decides. All steps are column
functions, and only distinct (host, path) pairs are expanded, so a url that holds a third of all rows costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table

PREFIX_HEX = 8

#: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules of a Python list; long lists come as a table with the same columns ``verdict``, ``host``, ``path``."""
    one = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    rows = F.array(*one) if one else F.expr("CAST(array() AS array<struct<verdict:string,host:string,path:string>>)")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins, and of
    two rules with the same text ``block`` wins. Null urls and urls without ``://`` have an empty host and path and
    fit no rule with a host. Repeated rows stay, other columns are ignored, an empty table gives an empty result,
    and rules with null fields are left out. The distinct path lengths of the rules are read to the driver: integers,
    no more of them than a path can have characters.
    """
    rules = rules.select("verdict", "host", "path").dropna()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    digest = F.sha2("expr", 256)
    listed = rules.select(
        "verdict", F.concat("host", "path").alias("rule"), F.concat("host", "path").alias("expr")
    ).groupBy("rule", "expr").agg(F.max("verdict").alias("verdict")).select(
        F.substring(digest, 1, PREFIX_HEX).alias("short"), digest.alias("full"), "rule", "verdict"
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    urls = rows.select("host", "path").distinct()
    asked = (
        urls.withColumn("suffix", F.explode(suffixes)).withColumn("n", F.explode(fitting))
        .withColumn("expr", F.concat("suffix", F.expr("substring(path, 1, n)")))
        .select("host", "path", F.substring(digest, 1, PREFIX_HEX).alias("short"), digest.alias("asked"))
    )
    hits = asked.join(listed, "short").filter(F.col("asked") == F.col("full"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best")
    ).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(v, h, p)}'" for v, h, p in longest)
    return f"""WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} END AS rule, {case(lambda v, h, p: v)} ELSE 'allow' END AS verdict FROM b"""


OP8_SQL = _sql()

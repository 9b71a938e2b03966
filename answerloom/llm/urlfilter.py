"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Each distinct URL is expanded into the pairs of those suffixes of its host (whole labels) that have as many labels as
some rule's host, and those prefixes of its path that are as long as some rule's path. An expression's SHA-256 is taken;
pages and rules meet in an equi-join on its first four bytes, as clients of a hash-prefix list do, and the full digest
then confirms the match. Of a URL's matching rules the longest host-plus-path wins; of equally long ones the longer
host, then ``block`` before ``allow``.

All of it is DataFrame functions. The number of expressions is at most (distinct label counts of rule hosts) x (distinct
lengths of rule paths), whatever the URL, each no longer than the URL; only expressions are shuffled, if at all: the
optimizer broadcasts the rules when they are small, and joins by sorting else. Verdicts are found once per distinct URL,
so a page or a host that repeats costs no more.

Edge cases: a null URL or one without ``://`` has an empty host and path, and matches nothing; an empty host matches
nothing. A URL without a rule gets ``default``. Very long URLs, of many thousand labels too, are judged whole. Rules'
hosts are lower-cased like those of URLs; rules with a null host or path are ignored; repeated rules count once; without rules, or pages, nothing is matched. Columns of the
input named like the outputs are replaced, all others kept. Repeated pages stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.common import Rows, ascii_lower

#: The query's rules: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest_of(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; a zero byte, which hosts can't hold, parts its two halves."""
    return F.unhex(F.sha2(F.concat(host, F.lit("\0"), path), 256))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the winning rule, or null) and ``verdict``."""
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
        .withColumn("r_digest", digest_of(F.col("r_host"), F.col("r_path")))
    )
    # a few numbers: at most as many as the longest path has characters and the longest host has labels
    n_labels = F.length("r_host") - F.length(F.replace("r_host", F.lit("."), F.lit(""))) + 1
    shapes = rules.agg(F.collect_set(F.length("r_path")).alias("lengths"), F.collect_set(n_labels).alias("labels")).first()
    urls = pages.select("url").where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''")
    has = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    given = lambda each: F.filter(F.array(*each or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    suffixes = given([F.when(has >= k, F.substring_index("host", ".", -k)) for k in sorted(shapes["labels"])])
    prefixes = given([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes["lengths"])])
    expressions = (
        urls.withColumn("e_path", F.explode(prefixes)).withColumn("e_host", F.explode(suffixes))
        .select("url", digest_of(F.col("e_host"), F.col("e_path")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 4))
    )
    matched = expressions.join(rules.withColumn("short", F.substring("r_digest", 1, 4)), "short").where(F.col("digest") == F.col("r_digest"))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"), "r_host", "r_path")
    best = matched.groupBy("url").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    rows = Rows(pages, ("host", "path", "rule", "verdict"))
    judged = pages.select(rows.row, "url").join(best, "url", "left")
    return rows.unpacked(
        judged,
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: DuckDB SQL for the query: every rule against every row, which its six rows allow.
ORACLE = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM urls LEFT JOIN LATERAL (
  SELECT r_host || r_path AS rule, r_verdict AS verdict FROM rules
  WHERE (host = r_host OR host LIKE '%.' || r_host) AND starts_with(path, r_path)
  ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, r_verdict DESC LIMIT 1) best ON true
"""

"""URL filter: host-suffix and path-prefix expressions, a hash-prefix equi-join, full-digest checks.

A rule is (host, path, verdict). It fits a URL whose host is the rule's host or a subdomain of it and
whose path starts with the rule's path; of the rules that fit, the longest (host and path together)
wins, then the one with the longer host, then ``block``. A URL that no rule fits gets ``default``.

Only expressions of shapes that occur among the rules (number of host labels, length of path) are
made, so a URL of any length yields at most as many expressions as there are shapes, and prefixes
need not end at a slash.

The join knows 32 bits of a digest; the whole digests are compared afterwards, where a URL's matches are
gathered. A URL is known by two hashes of itself, so that a lost executor changes nothing.

Defined cases: a null URL or one without ``://`` has an empty host and path; rules with a null host
are dropped, a null path is empty; repeated pages each get their row; an empty rule table gives every
page the default; other columns of ``pages`` are passed through whatever their names, but for host, path,
rule and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm._common import lower_ascii, read

#: Fixed values of the query: the rules, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

HOST_RE, PATH_RE = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def parse_url(pages: DataFrame) -> DataFrame:
    """Adds host and path, both empty for a null URL or one without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumns({
        "host": lower_ascii(F.regexp_extract(url, HOST_RE, 1)),
        "path": F.regexp_extract(url, PATH_RE, 1),
    })


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_bits: int = 32) -> DataFrame:
    """``pages`` with host, path, rule (its text, else null) and verdict."""
    rules = (
        rules.where("host is not null")
        .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .withColumns({"labels": F.size(F.split("host", r"\.")), "length": F.char_length("path")})
    )
    # Bounded by the variety of rule shapes (labels of a host name times path lengths), not by rows.
    shapes = rules.select("labels", "length").distinct().collect()
    expression = lambda host, path: F.concat(host, F.lit("\n"), path)
    # Only the first bits of the digest are joined on, as a client of a hash-prefix list would.
    short = lambda digest: F.conv(F.substring(digest, 1, prefix_bits // 4), 16, 10).cast("long")
    listed = rules.withColumn("digest", F.sha2(expression(F.col("host"), F.col("path")), 256))
    listed = listed.groupBy("digest").agg(
        F.concat(F.first("host"), F.first("path")).alias("rule"),
        F.char_length(F.first("host")).alias("host_length"),
        F.max("verdict").alias("rule_verdict"),  # block sorts after allow
    ).withColumn("short", short(F.col("digest")))

    row = F.struct(*[pages[c] for c in pages.columns]).alias("_row")
    pages, columns = parse_url(pages.select(row, pages["url"].alias("url"))), pages.columns
    pages = pages.withColumns({"_u": F.xxhash64("url"), "_v": F.hash("url")})
    labels = F.split("host", r"\.")
    made = F.array(*[
        F.when(
            (F.size(labels) >= s["labels"]) & (F.char_length("path") >= s["length"]),
            F.sha2(expression(F.substring_index("host", ".", -s["labels"]), F.substring(F.col("path"), 1, s["length"])), 256),
        )
        for s in shapes
    ]) if shapes else F.array().cast("array<string>")
    asked = pages.select("_u", "_v", F.explode(F.array_compact(made)).alias("asked")).withColumn("short", short(F.col("asked")))
    met = asked.join(listed, "short")  # of 32 bits; inside the aggregate the comparison cannot become a key of the join
    order = F.struct(F.char_length("rule"), "host_length", "rule", "rule_verdict")
    best = met.groupBy("_u", "_v").agg(F.max(F.when(F.col("asked") == F.col("digest"), order)).alias("_best")).where("_best is not null")
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c not in ("host", "path", "rule", "verdict")]
    return pages.join(best, ["_u", "_v"], "left").select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict")
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select p.page_id, p.host, p.path,
  (select r.host || r.path from rules r where (p.host = r.host or ends_with(p.host, '.' || r.host))
     and starts_with(p.path, r.path) order by length(r.host || r.path) desc limit 1) as rule,
  coalesce((select r.verdict from rules r where (p.host = r.host or ends_with(p.host, '.' || r.host))
     and starts_with(p.path, r.path) order by length(r.host || r.path) desc limit 1), 'allow') as verdict
from parsed p
"""

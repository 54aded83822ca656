"""URL filters by rules and by link-graph propagation; DataFrame functions only.

A rule, longest first, decides every url it fits. All other pages follow their host: hosts with more pages allowed than
blocked by rules are trusted seeds, those with more blocked are distrusted ones. Personalised PageRank carries trust
along links and distrust against them, over the distinct host edges found in the pages' html; a host is blocked if its
distrust exceeds ``threshold`` and its trust. Each round moves the mass that the one before brought, until all that can
still come, by the damping at most damping / (1 - damping) of what moved last, is below ``tolerance``.

The SQL stops after ROUNDS rounds and finds no links without a scheme: it gives these rows where the links end sooner.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed unless its (empty) host
is blocked by the graph, which no link reaches; a null html has no links; repeated rows count once a row as pages, once
in all as edges; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import persisted

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
#: Of the SQL.
ROUNDS = 8
TOLERANCE = 1e-6
THRESHOLD = 0.05
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?:[hH][tT][tT][pP][sS]?:|[\"'=(][\x09-\x20]*)//([^/?#\"'<>\x00-\x20]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits columns host and path, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_scores(judged: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = 400) -> DataFrame:
    """host, trust, distrust from pages with host, rule_verdict and html."""
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER))
    pages = judged.filter("host <> ''")
    edges = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(links)).alias("dst")).filter("src <> dst").distinct()
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    both = persisted(both)
    degree = both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    both = persisted(both.join(degree, ["kind", "src"]))
    lean = F.sum(F.when(F.col("rule_verdict") == "allow", 1).when(F.col("rule_verdict") == "block", -1).otherwise(0))
    seeds = pages.groupBy("host").agg(lean.alias("lean")).filter("lean <> 0")
    seeds = persisted(seeds.select(F.when(F.col("lean") > 0, "trust").otherwise("distrust").alias("kind"), "host", F.lit(1 - damping).alias("mass")))
    rank = seeds.withColumn("new", F.col("mass"))
    for k in range(rounds):
        flow = rank.filter("new > 0").withColumnRenamed("host", "src").join(both, ["kind", "src"])
        flow = flow.select("kind", F.col("dst").alias("host"), (F.col("new") * damping / F.col("degree")).alias("mass"))
        moved = rank.withColumn("new", F.lit(0.0)).union(flow.withColumn("new", F.col("mass")))
        rank = moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("new").alias("new"))
        if k % 4 == 3:
            rank = persisted(rank)
            if (rank.agg(F.sum("new")).first()[0] or 0.0) * damping / (1 - damping) < tolerance:
                break
    else:
        raise RuntimeError(f"mass still moves after {rounds} rounds")
    rank = rank.withColumn("mass", F.round("mass", 12))
    mass = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(mass("trust"), mass("distrust"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    host, path = split_url(F.col("url"))
    rule, verdict = match_rule(rules)
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = split.withColumns({"rule": rule, "rule_verdict": verdict})
    scores = host_scores(judged.select("host", "html", "rule_verdict"), damping, tolerance).withColumnRenamed("host", "of_host")
    bad = scores.select("of_host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    out = judged.drop("html").join(bad, F.col("host") == F.col("of_host"), "left")
    by_graph = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def _oracle() -> str:
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    cases = lambda out: " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{h + p if out == 'rule' else v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    rounds = [
        f"""r{k} AS (SELECT kind, host, round(sum(mass), 12) AS mass FROM (
  SELECT kind, host, mass FROM seeds UNION ALL
  SELECT e.kind, e.dst, r.mass * {DAMPING} / e.degree FROM r{k - 1} r JOIN edges e ON r.kind = e.kind AND r.host = e.src)
  GROUP BY kind, host)"""
        for k in range(1, ROUNDS + 1)
    ]
    return f"""
WITH split AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
judged AS (
  SELECT *, CASE {cases("rule")} END AS rule, CASE {cases("verdict")} END AS rule_verdict FROM parts),
links AS (
  SELECT DISTINCT host AS src, {lower("dst")} AS dst FROM (
    SELECT host, unnest(regexp_extract_all(html, '[hH][tT][tT][pP][sS]?://([^/?#"''<>\\x00-\\x20]+)', 1)) AS dst FROM judged WHERE host <> '')),
pairs AS (
  SELECT 'trust' AS kind, src, dst FROM links WHERE src <> dst UNION ALL SELECT 'distrust', dst, src FROM links WHERE src <> dst),
edges AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM pairs),
leaning AS (
  SELECT host, sum(CASE rule_verdict WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END) AS lean FROM judged WHERE host <> '' GROUP BY host),
seeds AS (SELECT CASE WHEN lean > 0 THEN 'trust' ELSE 'distrust' END AS kind, host, CAST({1 - DAMPING!r} AS DOUBLE) AS mass FROM leaning WHERE lean <> 0),
r0 AS (SELECT * FROM seeds),
{", ".join(rounds)},
scores AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.rule_verdict, CASE WHEN s.distrust >= {THRESHOLD} AND s.distrust > s.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON j.host = s.host
"""


ORACLE = _oracle()


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")

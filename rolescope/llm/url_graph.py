"""URL filters: rules first, then trust and distrust propagated over links between hosts.

Hosts of pages that a rule allows are trusted seeds, hosts of pages that a rule blocks are distrusted ones. Personalised
PageRank carries trust along host edges and distrust against them; a host whose distrust outweighs its trust is blocked,
and with it its pages that no rule judges. Scores are whole numbers, so sums do not depend on their order. Host edges are
distinct pairs: a page's links, and a subdomain with its parent domain both ways. DataFrame functions only.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; a null html has
no links; repeated rows each get their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.session import settle

#: verdict, host, path. Of the rules that fit, the longest decides.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    ordered = sorted(rules, key=lambda rule: -len(rule[1] + rule[2]))
    return F.coalesce(*[
        F.when(((host == name) | host.endswith("." + name)) & path.startswith(start),
               F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, name, start in ordered])


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Distinct (from_host, to_host), without loops; the parent of a domain needs a dot of its own."""
    linked = pages.select(F.col("__host").alias("from_host"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1)), host_of))).alias("to_host"))
    hosts = pages.select("__host").distinct()
    parent = F.regexp_extract("__host", r"^[^.]+\.([^.]+\..+)$", 1)
    up = hosts.select(F.col("__host").alias("from_host"), parent.alias("to_host"))
    down = up.select(F.col("to_host").alias("from_host"), F.col("from_host").alias("to_host"))
    return linked.unionByName(up).unionByName(down).where(
        (F.col("from_host") != "") & (F.col("to_host") != "") & (F.col("from_host") != F.col("to_host"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, damping: int, settle_every: int = 4) -> DataFrame:
    """(kind, host, score) after the rounds. edges: kind, from_host, to_host; seeds: kind, host, one row each."""
    degree = edges.groupBy("kind", "from_host").agg(F.count("*").alias("degree"))
    weighted = settle(edges.join(degree, ["kind", "from_host"]), "host-edges")
    base = seeds.withColumn("score", F.lit(SCALE * (100 - damping) // 100).cast("long"))
    scores = seeds.withColumn("score", F.lit(SCALE).cast("long"))
    for step in range(1, rounds + 1):
        passed = weighted.join(scores.withColumnRenamed("host", "from_host"), ["kind", "from_host"]).select(
            "kind", F.col("to_host").alias("host"), F.expr(f"(score * {damping}) div (100 * degree)").alias("score"))
        scores = passed.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % settle_every == 0:
            scores = settle(scores, "host-scores")
    return scores


def url_verdicts(pages: DataFrame, *, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",),
                 rules: tuple = RULES, rounds: int = 8, damping: int = 85, least: float = 0.05) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust``.

    A host is blocked when its distrust is above its trust and at least ``least`` of a seed's.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(*keep, host.alias("__host"), path.alias("__path"), rule_of(host, path, rules).alias("__rule"))
    links = host_edges(pages.select(host.alias("__host"), F.col(html).alias("__html")), url, F.col("__html"))
    links = settle(links, "host-links")
    edges = links.select(F.lit("trust").alias("kind"), "from_host", "to_host").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("to_host").alias("from_host"), F.col("from_host").alias("to_host")))
    seeds = judged.where(F.col("__rule").isNotNull() & (F.col("__host") != "")).select(
        F.when(F.col("__rule.verdict") == "allow", "trust").otherwise("distrust").alias("kind"),
        F.col("__host").alias("host")).distinct()
    scores = propagate(edges, seeds, rounds, damping)
    hosts = scores.groupBy(F.col("host").alias("__host")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0)).alias("distrust"))
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    blocked = (distrust > trust) & (distrust >= int(SCALE * least))
    return judged.join(hosts, "__host", "left").select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        trust.cast("long").alias("trust"), distrust.cast("long").alias("distrust"))


def verdict_sql(rounds: int = 8, damping: int = 85) -> str:
    """The same in SQL, one step after the other."""
    steps = "".join(f""",
r{step} AS (SELECT kind, host, sum(score)::BIGINT AS score FROM (
  SELECT kind, to_host AS host, (score * {damping}) // (100 * degree) AS score
  FROM weighted JOIN r{step - 1} ON weighted.kind = r{step - 1}.kind AND from_host = r{step - 1}.host
  UNION ALL SELECT kind, host, {SCALE * (100 - damping) // 100} FROM seeds) GROUP BY ALL)""".replace(
        "SELECT kind, to_host", "SELECT weighted.kind, to_host") for step in range(1, rounds + 1))
    return rf"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, '.' || host AS h, CASE
    WHEN suffix(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN suffix(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN suffix(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN suffix(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN suffix(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruling FROM p),
hrefs AS (
  SELECT host AS from_host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS url FROM p),
pairs AS (
  SELECT from_host, translate(regexp_extract(url[position('://' IN url) + 3:], '^[^/?#]*'), '{UPPER}', '{LOWER}') AS to_host
  FROM hrefs WHERE contains(url, '://')
  UNION SELECT host, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) FROM p
  UNION SELECT regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1), host FROM p),
links AS (SELECT DISTINCT * FROM pairs WHERE from_host <> '' AND to_host <> '' AND from_host <> to_host),
edges AS (SELECT 'trust' AS kind, from_host, to_host FROM links UNION ALL SELECT 'distrust', to_host, from_host FROM links),
weighted AS (SELECT *, count(*) OVER (PARTITION BY kind, from_host) AS degree FROM edges),
seeds AS (SELECT DISTINCT CASE ruling WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host FROM ruled
  WHERE rule IS NOT NULL AND host <> ''),
r0 AS (SELECT kind, host, {SCALE}::BIGINT AS score FROM seeds){steps},
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0)::BIGINT AS trust,
  coalesce(sum(score) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(ruling,
  CASE WHEN distrust > trust AND distrust >= {int(SCALE * 0.05)} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN scores ON ruled.host = scores.host
"""

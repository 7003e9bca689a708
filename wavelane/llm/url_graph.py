"""URL filter: rules on host and path, and for urls without a rule the trust of their host in the link graph. DataFrame operations only.

A rule (host, path, verdict) fits its host and all subdomains if the url's path begins with the rule's; the longest rule
string wins, then the longer host, then block. The rules seed the graph: a host's trust seed is the share of its pages that a
rule allows, its distrust seed the share that a rule blocks. Trust follows links (personalised PageRank from the trust seeds);
distrust runs against them (the same from the distrust seeds on reversed edges), so who links to blocked hosts is distrusted.
Edges are distinct host pairs from absolute links in the html, weighted by the number of links; a host's links to itself say
nothing and are left out. A host is blocked if its distrust reaches half of what a fully blocked host has of itself, and
exceeds its trust.

Cases: a null url, or one without ``://``, has an empty host and path; such pages have no edges and are allowed unless a rule
says otherwise. Null and empty html have no links. Repeated rows count as often as they come. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wavelane.runtime import write_through

Rule = tuple[str, str, str]  # host, path, verdict
DAMPING = 0.85
ROUNDS = 12
BROADCAST_HOSTS = 500_000
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: str) -> tuple[Column, Column]:
    value = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(value, _URL, 1), _UPPER, _LOWER), F.regexp_extract(value, _URL, 2)


def match_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pages (host, path, ...) with the winning rule string and its verdict, null without one. One narrow step per host depth."""
    spark = pages.sparkSession
    depths = sorted({host.count(".") + 1 for host, _, _ in rules})
    for depth in depths:
        part = [(h, p, v) for h, p, v in rules if h.count(".") + 1 == depth]
        table = spark.createDataFrame(part, "rule_host string, rule_path string, rule_verdict string").groupBy("rule_host").agg(
            F.collect_list(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
                                    F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"),
                                    F.col("rule_path").alias("path"))).alias(f"rules_{depth}"))
        table = F.broadcast(table) if len(part) <= BROADCAST_RULES else table
        pages = pages.withColumn("rule_host", F.substring_index("host", ".", -depth)).join(table, "rule_host", "left").drop("rule_host")
    fitting = [F.filter(F.coalesce(F.col(f"rules_{d}"), F.array()), lambda r: F.col("path").startswith(r["path"])) for d in depths]
    best = F.array_max(F.concat(*fitting)) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")
    return pages.withColumn("best", best).drop(*[f"rules_{d}" for d in depths]) \
        .withColumn("rule", F.col("best")["rule"]).withColumn("rule_verdict", F.col("best")["verdict"]).drop("best")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, w (share of the source's links) of links between hosts."""
    links = pages.where(F.col(html).isNotNull()).select(
        host_and_path(url)[0].alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("raw"))
    counted = links.select("src", F.translate("raw", _UPPER, _LOWER).alias("dst")).where("src <> dst AND src <> ''") \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    return counted


def _weighted(edges: DataFrame, source: str, target: str) -> DataFrame:
    total = edges.groupBy(source).agg(F.sum("links").alias("total"))
    return edges.join(total, source).select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("links") / F.col("total")).alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, rank after the given rounds of rank = (1 - damping) * seed + damping * incoming; edges (src, dst, w)."""
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("own"))
    ranks = start.select("host", F.col("own").alias("rank"))
    for k in range(rounds):
        flow = edges.join(ranks, edges["src"] == ranks["host"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("w") * damping).alias("own"))
        ranks = start.unionByName(flow).groupBy("host").agg(F.sum("own").alias("rank"))
        if k % 3 == 2:
            ranks = write_through(ranks)
    return ranks


def judge(pages: DataFrame, rules: list[Rule], damping: float = DAMPING, rounds: int = ROUNDS, key: str = "page_id", url: str = "url",
          html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust for every row."""
    host, path = host_and_path(url)
    ruled = match_rules(pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")), rules)
    share = lambda verdict: F.avg((F.coalesce("rule_verdict", F.lit("")) == verdict).cast("double"))
    seeds = write_through(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    edges = write_through(host_edges(pages, url, html))
    if edges.isEmpty():  # every rank is its own seed's
        ranks = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    else:
        trust = propagate(seeds.select("host", F.col("trust").alias("seed")), write_through(_weighted(edges, "src", "dst")), damping, rounds)
        distrust = propagate(seeds.select("host", F.col("distrust").alias("seed")), write_through(_weighted(edges, "dst", "src")), damping, rounds)
        ranks = write_through(seeds.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left")
                              .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left"))
    ranks = F.broadcast(ranks) if seeds.count() <= BROADCAST_HOSTS else ranks
    bad = (F.col("distrust") >= 0.5 * (1 - damping)) & (F.col("distrust") > F.col("trust"))
    return ruled.join(ranks, "host", "left").select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def twin(rules: list[Rule], damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """page_id, host, path, rule, verdict in DuckDB SQL over pages."""
    table = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)

    def ranks(name: str, source: str, target: str) -> str:
        steps = [f"{name}0 AS (SELECT host, {name} * {1 - damping} AS rank FROM seeds)"]
        for k in range(rounds):
            steps.append(f"""{name}{k + 1} AS (SELECT host, sum(rank) AS rank FROM (
                SELECT host, rank FROM {name}0 UNION ALL
                SELECT e.{target}, r.rank * e.links / t.n * {damping} FROM edges e JOIN {name}{k} r ON r.host = e.{source}
                JOIN (SELECT {source} AS host, sum(links) AS n FROM edges GROUP BY {source}) t ON t.host = e.{source}) GROUP BY host)""")
        return ",\n".join(steps)

    link = _LINK.replace("'", "''")
    return f"""WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {table}),
    split AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path, row_number() OVER () AS row FROM pages),
    fits AS (SELECT row, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict),
                 struct_pack(a := len(rule_host || rule_path), b := len(rule_host), c := rule_verdict)) AS best
             FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row),
    ruled AS (SELECT split.*, best.rule AS rule, best.verdict AS rule_verdict FROM split LEFT JOIN fits USING (row)),
    seeds AS (SELECT host, avg((coalesce(rule_verdict, '') = 'allow')::INT) AS trust, avg((coalesce(rule_verdict, '') = 'block')::INT) AS distrust
              FROM ruled WHERE host <> '' GROUP BY host),
    edges AS (SELECT src, dst, count(*) AS links FROM (
                SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM split)
              WHERE src <> dst AND src <> '' GROUP BY src, dst),
    {ranks("trust", "src", "dst")},
    {ranks("distrust", "dst", "src")}
    SELECT page_id, ruled.host, path, rule, coalesce(rule_verdict, CASE WHEN d.rank >= {0.5 * (1 - damping)} AND d.rank > t.rank
           THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled LEFT JOIN trust{rounds} t ON t.host = ruled.host LEFT JOIN distrust{rounds} d ON d.host = ruled.host"""

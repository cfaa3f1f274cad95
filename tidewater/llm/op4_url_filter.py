"""URL filter: explicit rules first, then trust and distrust propagated over the host graph, in DataFrame functions only.

Hosts that the rules allow are trusted seeds, hosts that they block are distrusted ones. Trust is personalised PageRank
from the trusted seeds along links; what flows into hosts without links returns to the seeds, which is the same as leaving
it out and scaling the rest, so a host's trust is given in multiples of the mean over the hosts that have pages. Distrust
flows against the links, from a blocked host to those that link to it: a blocked seed has 1, any other host the damped
mean of what it links to, that is the chance that a walk from it ends at a blocked host. Neither depends on how many hosts
there are or link to the same seed. A host is blocked if its distrust reaches ``threshold`` and its trust stays below
``trusted``; pages that no rule fits take their host's verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.workspace import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRUST, DISTRUST = 0, 1
UNIT = 10**9  # scores are whole billionths, so sums do not depend on their order
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last that fits is the longest
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """Links between different hosts: src, dst and the share of src's links; combined before the shuffle. Links without a
    scheme (``//host/path``) count, relative ones don't."""
    link = F.explode(F.regexp_extract_all(html, F.lit(LINK), 1))
    to = pages.where(F.col(html).contains("//")).select("host", link.alias("link")).select(F.col("host").alias("src"), host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
    edges = materialize(to.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n")))
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    return edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def arcs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Both sides' steps (side, a, b, share): trust from src to dst, distrust from dst to src, none of it into its seeds."""
    known = seeds.where(F.col("side") == DISTRUST).select(F.col("host").alias("src"))
    trust = edges.select(F.lit(TRUST).alias("side"), F.col("src").alias("a"), F.col("dst").alias("b"), "share")
    distrust = edges.join(known, "src", "left_anti").select(F.lit(DISTRUST).alias("side"), F.col("dst").alias("a"), F.col("src").alias("b"), "share")
    return materialize(trust.unionByName(distrust))


def bound(damping: float, tolerance: float) -> int:
    """Rounds after which a walk goes on with a probability of at most ``tolerance``."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def propagate(seeds: DataFrame, steps: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Scores by (side, host), as whole billionths: the seed's own plus damped shares of the neighbours' scores.

    At most ``tolerance`` of a seed's mass is still under way when the bound on rounds is reached. Scores never fall, so
    equal totals end the rounds before: of each four rounds, stored in the shared folder, the driver sees two numbers.
    """
    own = F.when(F.col("side") == TRUST, F.lit(round((1 - damping) * UNIT))).otherwise(F.lit(UNIT)).cast("long")
    start = seeds.select("side", "host", own.alias("score"))
    scores, seen, rounds = start, None, bound(damping, tolerance)
    for k in range(rounds):
        moved = scores.withColumnRenamed("host", "a").join(steps, ["side", "a"]).select("side", F.col("b").alias("host"), F.round(F.col("score") * F.col("share") * damping).cast("long").alias("score"))
        scores = moved.unionByName(start).groupBy("side", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3 or k == rounds - 1:
            scores = materialize(scores)
            state = scores.agg(F.count("*").alias("n"), F.sum("score").alias("total")).first()
            if state == seen:
                break
            seen = state
    return scores


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 1e-3, threshold: float = 0.5, trusted: float = 1.0,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Verdict of every row's url: page_id, host, path, rule, verdict, and its host's trust and distrust.

    A host is a seed by the majority of its judged pages, and a distrusted one only if they are at least half of all its
    pages; equal numbers make no seed. Of rules equally long the last by text counts. A null url, or one without ``://``,
    has empty host and path, fits no rule and is allowed. Null html has no links; repeated rows are judged each (and count
    in majorities); other columns are not read. Html is read in one pass and never shuffled; pages meet the scored hosts
    in a broadcast if those were counted to be at most BROADCAST_HOSTS, else in an outer join that adaptive execution may
    split.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("html"))
    judged = judged.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("fit.verdict") == "block").alias("blocked"))
    hosts = materialize(hosts)
    side = F.when(F.col("allowed") > F.col("blocked"), TRUST).when((F.col("blocked") > F.col("allowed")) & (2 * F.col("blocked") >= F.col("n")), DISTRUST)
    seeds = hosts.select(side.alias("side"), "host").where("side is not null")
    scores = propagate(seeds, arcs(host_edges(judged.select("host", "html"), "html"), seeds), damping, tolerance)
    score = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("score"))), F.lit(0).cast("long"))
    per_host = materialize(hosts.select("host").join(scores.groupBy("host").agg(score(TRUST).alias("t"), score(DISTRUST).alias("x")), "host"))
    n, total = hosts.count(), per_host.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    scored = per_host.select("host", (F.round(F.col("t") * F.lit(float(n)) / F.lit(float(max(total, 1))), 6)).alias("trust"), (F.col("x") / F.lit(float(UNIT))).alias("distrust"))
    if per_host.count() <= BROADCAST_HOSTS:
        scored = F.broadcast(scored)
    joined = judged.drop("html").join(scored, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= threshold) & (F.col("trust") < trusted)
    return joined.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "trust", "distrust",
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 1e-3, threshold: float = 0.5, trusted: float = 1.0) -> str:
    """DuckDB twin of :func:`filter_urls` over ``pages``: the rounds unrolled."""
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substring({0}, instr({0}, '://') + 3) ELSE '' END"
    host = lambda url: f"coalesce(translate(regexp_extract({rest.format(url)}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    path = f"coalesce(regexp_extract({rest.format('url')}, '^[^/?#]*([^?#]*)', 1), '')"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in longest) + " END"
    rounds = bound(damping, tolerance)
    steps = "".join(
        f""" s{k} AS MATERIALIZED (SELECT side, host, CAST(sum(score) AS BIGINT) AS score FROM (SELECT s.side, b AS host, CAST(round(score * share * {damping}) AS BIGINT) AS score FROM s{k - 1} s JOIN arc ON arc.side = s.side AND a = host
   UNION ALL FROM s0) GROUP BY 1, 2),\n"""
        for k in range(1, rounds + 1)
    )
    quoted = LINK.replace("'", "''")
    return rf"""
WITH h AS (SELECT page_id, html, {host("url")} AS host, {path} AS path FROM pages),
 j AS (SELECT *, {pick("text")} AS rule, {pick("verdict")} AS judged FROM h),
 n AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (judged = 'allow') AS a, count(*) FILTER (judged = 'block') AS b FROM j WHERE host <> '' GROUP BY 1),
 s0 AS MATERIALIZED (SELECT CASE WHEN a > b THEN {TRUST} ELSE {DISTRUST} END AS side, host, CASE WHEN a > b THEN {round((1 - damping) * UNIT)} ELSE {UNIT} END::BIGINT AS score FROM n WHERE a > b OR (b > a AND 2 * b >= n)),
 links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{quoted}', 1)) AS found FROM h),
 given AS (SELECT src, CASE WHEN starts_with(found, '//') THEN 'x:' || found ELSE found END AS link FROM links),
 one AS (SELECT src, {host("link")} AS dst FROM given),
 edge AS (SELECT src, dst, count(*) AS n FROM one WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
 share AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edge),
 arc AS MATERIALIZED (SELECT {TRUST} AS side, src AS a, dst AS b, share FROM share UNION ALL SELECT {DISTRUST}, dst, src, share FROM share WHERE src NOT IN (SELECT host FROM s0 WHERE side = {DISTRUST})),
{steps} p AS (SELECT host, coalesce(max(score) FILTER (side = {TRUST}), 0) AS t, coalesce(max(score) FILTER (side = {DISTRUST}), 0) AS x FROM s{rounds} WHERE host IN (SELECT host FROM n) GROUP BY 1),
 t AS (SELECT host, round(t::DOUBLE * (SELECT count(*) FROM n)::DOUBLE / (SELECT greatest(sum(t), 1) FROM p)::DOUBLE, 6) AS trust, x / {float(UNIT)} AS distrust FROM p)
SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN distrust >= {threshold} AND trust < {trusted} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust
FROM j LEFT JOIN t USING (host)
"""

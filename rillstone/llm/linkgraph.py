"""Operator 4: URL filtering by trust and distrust that spread over the graph of hosts.

Trust is a personalised PageRank from trusted hosts along the links; distrust the same from blocked hosts
against the links, so that it reaches those who link to them. Masses are integers, so that a result is the
same in whatever order partitions are summed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick, settle

#: Hosts that are trusted and blocked from the start, as patterns searched in the host.
TRUSTED, BLOCKED = r"\.(edu|gov|org)$", r"(casino|pills|spam|adult|bets|ads-)"
#: First labels under which a site serves the same content; such a host and its site are linked both ways.
ALIASES = ("www", "m", "blog")
#: Rounds in SQL, the share in percent that is passed on, all mass of a kind, rounds between checkpoints.
ROUNDS, DAMPING, MASS, SPAN = 10, 85, 10**15, 5
#: A host is rejected if its distrust is at least this many millionths of what one blocked host starts with and more than its trust.
DISTRUST = 100
#: Masses have settled when all of a kind's together change by no more than so many millionths of what one seed starts with, over SPAN rounds.
STILL = 1
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//(?:[^/?#@"'\s>]*@)?([^/:?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL, else an empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) from (host, html): number of pages of src that link to dst, and 1 between aliases and their sites."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), F.lower))).alias("dst"))
    stem = F.regexp_extract("src", rf"^(?:{'|'.join(ALIASES)})\.(.+\..+)$", 1)
    tied = pages.select(F.col("host").alias("src")).distinct().select("src", stem.alias("dst")).where("dst <> ''").select("src", "dst", F.lit(1).cast("long").alias("w"))
    counted = links.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    both = counted.unionByName(tied).unionByName(tied.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, count: dict[int, int], rounds: int | None = None) -> DataFrame:
    """(kind, host, mass) over edges (kind, src, dst, w) from ``count`` seeds (kind, host) of each kind, after ``rounds``
    rounds, else when masses have settled.

    What reaches a host without edges stays there for that round and isn't passed on. Changes fall with every round, but for
    the rounding of integers; where that alone is left, masses have settled too.
    """
    total = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    small = lambda c: F.col(c).cast("decimal(14, 0)").alias(c)  # noqa: E731  so that products are exact
    arcs = settle(edges.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", small("w"), small("all")))
    share = F.lit(0).cast("long")
    for kind, n in count.items():
        share = F.when(F.col("kind") == kind, F.lit(MASS // n).cast("long")).otherwise(share)
    start = settle(seeds.select("kind", "host", share.alias("mass")))
    back = start.select("kind", "host", F.expr(f"mass * {100 - DAMPING} div 100").alias("mass"))
    now = kept = start
    i, last = 0, None
    while rounds is None or i < rounds:
        i += 1
        sent = now.join(arcs, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.expr(f"(cast(mass AS decimal(18, 0)) * w * {DAMPING}) div (all * 100)").alias("mass"))
        now = sent.unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if i % SPAN:
            continue
        now = settle(now)
        if rounds is None:
            moves = now.unionByName(kept.select("kind", "host", (-F.col("mass")).alias("mass"))).groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("mass"))
            change = {r["kind"]: r["mass"] for r in moves.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
            if all(x * 10**6 <= STILL * (MASS // count[k]) or last is not None and x >= last.get(k, 0) for k, x in change.items()):
                break
            kept, last = now, change
    return now


def url_trust(pages: DataFrame, rounds: int | None = None, seeds: DataFrame | None = None, trusted: str = TRUSTED, blocked: str = BLOCKED, distrust: int = DISTRUST, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, host, trust, distrust, keep): one row for each page; masses in millionths of their kind's whole.

    Trusted and blocked hosts are those that the patterns find, or, if given, those of ``seeds`` (host, kind), kind being ``trusted`` or ``blocked``;
    other kinds, null hosts and hosts that no page or link has don't count, and one that is both is blocked.
    A page without an absolute URL (null, empty, relative) has host '' and isn't kept; it takes no part in the graph.
    A null html has no links. Links of a host to itself don't count, and a page counts once for each host it links to;
    repeated rows count as further pages. A blocked host is never trusted and never kept. Without seeds of a kind its masses are 0.
    A host whose distrust equals its trust is kept. Masses spread until they settle, or for ``rounds`` rounds; as SQL has no
    such loop, its ROUNDS rounds are the same only where masses settle within them. URLs and html of any length are read whole; other columns
    may have any names. An empty table gives no rows.
    """
    rows = pick(pages, page_id=id_column, url=url_column, html=html_column).select("page_id", host_of(F.col("url")).alias("host"), "html")
    edges = settle(host_edges(rows.select("host", "html")))
    hosts = settle(rows.select("host").where("host <> ''").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct())
    if seeds is None:
        known = hosts.select(F.when(F.col("host").rlike(blocked), 1).when(F.col("host").rlike(trusted), 0).alias("kind"), "host").where("kind is not null")
    else:
        named = pick(seeds, host="host", kind="kind").select(F.lower("host").alias("host"), F.when(F.col("kind") == "blocked", 1).when(F.col("kind") == "trusted", 0).alias("kind"))
        known = hosts.join(named.where("kind is not null").groupBy("host").agg(F.max("kind").alias("kind")), "host").select("kind", "host")
    seeds = settle(known)
    ways = edges.select(F.lit(0).alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    count = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}
    mass = spread(ways, seeds, count, rounds)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(F.lit(0))).alias(("trust", "distrust")[kind])
    # whole masses are compared: millionths of a mass that very many hosts share would be rounded off
    low = distrust * (MASS // 10**6) // count.get(1, 1)
    verdict = F.col("blocked") | (F.col("distrust") >= F.lit(low)) & (F.col("distrust") > F.col("trust"))
    masses = mass.select("kind", "host", "mass", F.lit(False).alias("blocked")).unionByName(seeds.where("kind = 1").select("kind", "host", F.lit(0).cast("long").alias("mass"), F.lit(True).alias("blocked")))
    scores = settle(masses.groupBy("host").agg(part(0), part(1), F.max("blocked").alias("blocked")).select("host", *(F.expr(f"{c} div {MASS // 10**6}").alias(c) for c in ("trust", "distrust")), verdict.alias("rejected")))
    judged = rows.select("page_id", "host").join(scores, "host", "left")
    return judged.select("page_id", "host", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust")), ((F.col("host") != "") & ~F.coalesce("rejected", F.lit(False))).alias("keep"))


def sql(rounds: int = ROUNDS) -> str:
    """The same with one table expression for each round."""
    q = lambda x: x.replace("'", "''")
    steps = ",\n".join(
        f"""r{i} AS MATERIALIZED (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
  SELECT a.kind, a.dst AS host, (mass::HUGEINT * w * {DAMPING} // (whole * 100))::BIGINT AS mass FROM r{i - 1} r JOIN arcs a ON r.kind = a.kind AND r.host = a.host
  UNION ALL SELECT kind, host, mass * {100 - DAMPING} // 100 FROM r0) GROUP BY kind, host)"""
        for i in range(1, rounds + 1)
    )
    return f"""
WITH rows AS MATERIALIZED (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{q(HOST)}', 1)) AS host, html FROM pages),
links AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{q(LINK)}', 1), lambda x: lower(x)))) AS dst FROM rows),
tied AS (SELECT src, regexp_extract(src, '^(?:{'|'.join(ALIASES)})\\.(.+\\..+)$', 1) AS dst, 1 AS w FROM (SELECT DISTINCT host AS src FROM rows)),
both_ways AS (SELECT src, dst, count(*) AS w FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst
  UNION ALL SELECT src, dst, w FROM tied WHERE dst <> '' UNION ALL SELECT dst, src, w FROM tied WHERE dst <> ''),
edges AS MATERIALIZED (SELECT src, dst, sum(w)::BIGINT AS w FROM both_ways GROUP BY src, dst),
hosts AS MATERIALIZED (SELECT host FROM rows WHERE host <> '' UNION SELECT src FROM edges UNION SELECT dst FROM edges),
seeds AS (SELECT CASE WHEN regexp_matches(host, '{q(BLOCKED)}') THEN 1 ELSE 0 END AS kind, host FROM hosts
  WHERE regexp_matches(host, '{q(BLOCKED)}') OR regexp_matches(host, '{q(TRUSTED)}')),
ways AS (SELECT 0 AS kind, src AS host, dst, w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges),
arcs AS MATERIALIZED (SELECT *, (sum(w) OVER (PARTITION BY kind, host))::BIGINT AS whole FROM ways),
r0 AS MATERIALIZED (SELECT kind, host, {MASS} // count(*) OVER (PARTITION BY kind) AS mass FROM seeds),
{steps},
scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0)::BIGINT AS t, coalesce(sum(mass) FILTER (kind = 1), 0)::BIGINT AS d FROM r{rounds} GROUP BY host),
low AS (SELECT {DISTRUST * (MASS // 10**6)} // greatest(count(*) FILTER (kind = 1), 1) AS least FROM seeds),
judged AS (SELECT page_id, rows.host, coalesce(t, 0) AS t, coalesce(d, 0) AS d FROM rows LEFT JOIN scores ON rows.host = scores.host)
SELECT page_id, host, t // {MASS // 10**6} AS trust, d // {MASS // 10**6} AS distrust,
  host <> '' AND NOT regexp_matches(host, '{q(BLOCKED)}') AND NOT (d >= least AND d > t) AS keep FROM judged, low
"""


SQL = sql()

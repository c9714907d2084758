"""URL filters: allow and block rules, and trust and distrust propagated over host links for what no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The target of an anchor; stylesheets and attributes such as data-href are no links.
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]*)"""
ABSOLUTE, SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Edges of one host in one group of a join.
EDGES = 10000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls; the rules become one CASE, longest first."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, way = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(way))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (src, dst, weight): pages of src that link to dst.

    Relative links stay on the page's host; fragments, empty targets and other schemes (mailto:, javascript:) lead nowhere.
    """
    same_page = lambda x: (x == "") | F.startswith(x, F.lit("#"))
    target = lambda x: (
        F.when(F.rlike(x, F.lit(ABSOLUTE)), host_of(x)).when(F.startswith(x, F.lit("//")), host_of(F.concat(F.lit("x:"), x))).when(same_page(x) | F.rlike(x, F.lit(SCHEME)), "").otherwise(F.col("host"))
    )
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), target))
    return pages.select(F.col("host").alias("src"), F.explode(links).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges -> (kind, at, to, part, out_salt, in_salt, at_in, to_out), saved.

    Trust goes along the links and distrust against them; `part` is an edge's share of its start's weight. A host's edges
    are dealt to groups of about EDGES, by `out_salt` for joins at their start and `in_salt` for joins at their end;
    to_out and at_in say into how many groups the edges from `to` and to `at` are dealt, 0 where there are none.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "weight"))
    both = saved(both, "ways")
    groups = F.ceil(F.count(F.lit(1)) / EDGES).cast("int")
    out = saved(both.groupBy("kind", "at").agg(F.sum("weight").alias("all"), groups.alias("out")), "out")
    into = saved(both.groupBy("kind", "to").agg(groups.alias("into")), "into")
    wide = both.join(out, ["kind", "at"]).join(into, ["kind", "to"])
    wide = wide.join(out.select("kind", F.col("at").alias("to"), F.col("out").alias("to_out")), ["kind", "to"], "left").join(into.select("kind", F.col("to").alias("at"), F.col("into").alias("at_in")), ["kind", "at"], "left")
    salts = [F.pmod(F.xxhash64("to"), F.col("out")).cast("int").alias("out_salt"), F.pmod(F.xxhash64("at"), F.col("into")).cast("int").alias("in_salt")]
    done = saved(wide.select("kind", "at", "to", (F.col("weight") / F.col("all")).alias("part"), *salts, F.coalesce("at_in", F.lit(0)).alias("at_in"), F.coalesce("to_out", F.lit(0)).alias("to_out")), "parts")
    forget(both, out, into)
    return done


def dealt(rows: DataFrame, groups: str, salt: str) -> DataFrame:
    """Each row once for each of its groups."""
    return rows.where(F.col(groups) > 0).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(groups) - 1)))


def survival(both: DataFrame, tolerance: float, damping: float) -> DataFrame:
    """both_ways() -> (kind, at, alive): the share of a walk's mass from `at` that does not end at a dead end.

    Hosts without an edge of the kind have no row; their share is 1 - damping. Where nothing dangles all are 1 and one
    round suffices.
    """
    alive, steps = saved(both.groupBy("kind", "at").agg(F.max("at_in").alias("at_in")).withColumn("alive", F.lit(1.0)), "alive"), 1
    while True:
        start = alive
        for _ in range(steps):
            end = dealt(alive, "at_in", "in_salt").select("kind", F.col("at").alias("to"), "in_salt", "alive")
            alive = both.join(end, ["kind", "to", "in_salt"], "left").groupBy("kind", "at").agg(F.max("at_in").alias("at_in"), (1 - damping + damping * F.sum(F.col("part") * F.coalesce("alive", F.lit(1 - damping)))).alias("alive"))
        alive = saved(alive, "alive")
        change = alive.join(start.select("kind", "at", F.col("alive").alias("before")), ["kind", "at"]).agg(F.max(F.abs(F.col("alive") - F.col("before")))).first()[0] or 0.0
        forget(start)
        if change * damping**steps / (1 - damping**steps) <= tolerance:
            return alive
        steps = 4


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, returned: bool = False) -> DataFrame:
    """hosts(host, trusted, blocked, pages) and edges -> the same with `trust` and `distrust`.

    Trust is a personalised PageRank from the trusted seeds along the links; distrust runs against the links from the
    blocked seeds, so that hosts linking to blocked ones take part of it. Rounds go on until what is still missing, by
    the contraction of the last rounds, is at most `tolerance` of all seeds; about 0.85 ** rounds is missing at worst.
    With `returned`, mass at a host without an edge of its kind goes back to the seeds of the host that it set out
    from: as that only scales a host's share of the walk, its seeds are divided by `survival`. Without, it is dropped.
    One row per host and one per linked pair of hosts; a hot host's edges are dealt to groups, see both_ways().
    """
    both = both_ways(edges)
    seeds = hosts.select(F.col("host").alias("at"), F.explode(F.create_map(F.lit("trust"), F.col("trusted").cast("double"), F.lit("distrust"), F.col("blocked").cast("double"))).alias("kind", "seed")).where("seed > 0").withColumn("restart", F.col("seed") * (1 - damping))
    if returned:
        seeds = seeds.join(survival(both, tolerance, damping), ["kind", "at"], "left").withColumn("restart", F.col("restart") / F.coalesce("alive", F.lit(1 - damping)))
    groups = both.groupBy("kind", "at").agg((F.max("out_salt") + 1).alias("groups"))
    seeds = saved(seeds.join(groups, ["kind", "at"], "left").select("kind", "at", "seed", "restart", F.coalesce("groups", F.lit(0)).alias("groups")), "seeds")
    mass, steps = seeds.agg(F.sum("seed")).first()[0] or 0.0, 1
    now = seeds.select("kind", "at", F.col("seed").alias("score"), "groups")
    restart = seeds.select("kind", "at", F.col("restart").alias("score"), "groups")
    while True:
        start = now
        for _ in range(steps):
            sent = dealt(now, "groups", "out_salt").join(both, ["kind", "at", "out_salt"]).select("kind", F.col("to").alias("at"), (F.col("score") * F.col("part") * damping).alias("score"), F.col("to_out").alias("groups"))
            now = sent.unionByName(restart).groupBy("kind", "at").agg(F.sum("score").alias("score"), F.max("groups").alias("groups"))
        now = saved(now, "scores")
        moved = now.unionByName(start.withColumn("score", -F.col("score"))).groupBy("kind", "at").agg(F.abs(F.sum("score")).alias("moved"))
        change = moved.agg(F.sum("moved")).first()[0] or 0.0
        forget(start)
        if change * damping**steps / (1 - damping**steps) <= tolerance * mass:
            break
        steps = 4
    scores = now.groupBy(F.col("at").alias("host")).agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    return hosts.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-9, returned: bool = False) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, host, path, rule, verdict, trust, distrust).

    Where no rule fits, a host is blocked if its distrust exceeds its trust, or its blocked pages its allowed ones, by
    `threshold` times its pages or more. `returned` says what becomes of mass at hosts without links, see propagate().
    Null urls and urls without :// have an empty host and path, fit no rule and are one host like any other; null or
    empty html has no links; repeated rows count and stay; an empty table gives no row; other columns are ignored.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "action": action})
    hosts = p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("action") == "allow").alias("trusted"), F.count_if(F.col("action") == "block").alias("blocked"))
    scored = propagate(hosts, host_edges(p), damping, tolerance, returned)
    excess = F.greatest(F.col("distrust") - F.col("trust"), F.col("blocked") - F.col("trusted"))
    # saved, so that a host with many pages is a join whose large partitions Spark splits
    scored = saved(scored.withColumn("bad", F.round(excess, 6) >= F.col("pages") * threshold).select("host", "bad", "trust", "distrust"), "hosts")
    verdict = F.coalesce("action", F.when(F.col("bad"), "block").otherwise("allow"))
    return p.drop("html").join(scored, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("trust", 4).alias("trust"), F.round("distrust", 4).alias("distrust"))


def _sql(rounds: int = 10) -> str:
    steps = "".join(
        f"""
r{k} AS (SELECT kind, node, sum(score) AS score FROM (
  SELECT kind, "to" AS node, score * part * 0.85 AS score FROM r{k - 1} JOIN ways USING (kind, node)
  UNION ALL SELECT kind, node, score * (1 - 0.85) FROM r0) GROUP BY ALL),"""
        for k in range(1, rounds + 1)
    )
    fits = "".join(
        f"""WHEN (host = '{t[: t.index("/")]}' OR ends_with(host, '.{t[: t.index("/")]}')) AND starts_with(path, '{t[t.index("/") :]}') THEN '{a} {t}' """
        for a, t in sorted(RULES, key=lambda r: -len(r[1]))
    )
    return rf"""
WITH p AS (
  SELECT *, substr(fit, 1, 5) AS action, substr(fit, 7) AS rule FROM (SELECT *, CASE {fits} END AS fit FROM (
    SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages))),
h AS (SELECT host, count(*) AS pages, count(*) FILTER (action = 'allow') AS trusted, count(*) FILTER (action = 'block') AS blocked FROM p GROUP BY host),
e AS (
  SELECT host AS src, CASE WHEN regexp_matches(x, '{ABSOLUTE}') THEN regexp_extract(x, '://([^/?#]*)', 1) WHEN starts_with(x, '//') THEN regexp_extract(x, '//([^/?#]*)', 1)
    WHEN x = '' OR starts_with(x, '#') OR regexp_matches(x, '{SCHEME}') THEN '' ELSE host END AS dst, page_id
  FROM (SELECT host, page_id, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS x FROM p)),
w AS (SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst, count(DISTINCT page_id) AS weight FROM e WHERE dst <> '' GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src AS node, dst AS "to", weight FROM w UNION ALL SELECT 'distrust', dst, src, weight FROM w),
ways AS (SELECT kind, node, "to", weight / sum(weight) OVER (PARTITION BY kind, node) AS part FROM both_ways),
r0 AS (SELECT 'trust' AS kind, host AS node, trusted::DOUBLE AS score FROM h WHERE trusted > 0 UNION ALL SELECT 'distrust', host, blocked::DOUBLE FROM h WHERE blocked > 0),{steps}
s AS (
  SELECT host, pages, blocked - trusted AS own, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
  FROM h LEFT JOIN r{rounds} ON node = host GROUP BY host, pages, own)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN round(greatest(distrust - trust, own), 6) >= pages * 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(trust, 4) AS trust, round(distrust, 4) AS distrust
FROM p JOIN s USING (host)
"""


SQL = _sql()

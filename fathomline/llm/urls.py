"""URL verdicts from rules and, where no rule fits, from trust that spreads over host links.

Trust starts at hosts with pages that rules allow and flows along links; distrust starts at
hosts with pages that rules block and flows against them. Both are personalised PageRanks
over one table of host links, in DataFrame functions only. A host is blocked if its distrust
exceeds its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import settle
from fathomline.sources.store import forget

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are matched as one literal list a row; longer lists belong in a table.
MOST_RULES = 1000
#: Mass that still moves after n rounds is at most DAMPING to the n, so SETTLED bounds the rounds.
DAMPING, SETTLED = 0.85, 1e-9
#: Rounds of the ranks that are written together.
AT_ONCE = 4

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(df: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """df with host, path, rule (pattern of the longest rule that fits, else null) and action."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    known = F.array(*(F.struct(F.lit(len(p)).alias("size"), F.lit(p).alias("rule"), F.lit(a).alias("action"), F.lit(p.partition("/")[0]).alias("host"), F.lit("/" + p.partition("/")[2]).alias("path")) for a, p in rules))
    fits = lambda r: (F.endswith(F.concat(F.lit("."), F.col("host")), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"])
    out = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    out = out.withColumn("__rule", F.array_max(F.filter(known, fits)))
    return out.withColumns({"rule": F.col("__rule.rule"), "action": F.col("__rule.action")}).drop("__rule")


def host_links(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, share): links between different hosts, share of the source's links."""
    targets = F.filter(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1), lambda x: x != "")
    found = df.select(host_of(F.col(url_col)).alias("src"), F.explode(targets).alias("url"))
    found = found.select("src", host_of(F.regexp_replace("url", "^//", "http://")).alias("dst"))
    counts = found.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").count()
    totals = counts.groupBy("src").agg(F.sum("count").alias("total"))
    return counts.join(totals, "src").select("src", "dst", (F.col("count") / F.col("total")).alias("share"))


def propagated(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked) over links (src, dst, share).

    Both ranks start with mass one on their seeds; distrust follows the links backwards,
    in equal parts to all that link to a host. What reaches a host without onward links
    goes no further.
    """
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    share = lambda c, t: F.col(c) / F.lit(float(t or 1))
    start = settle(seeds.select("host", share("allowed", total.a).alias("trust"), share("blocked", total.b).alias("distrust")).where("trust > 0 OR distrust > 0"))
    into = links.groupBy("dst").agg(F.count("*").alias("n"))
    back = links.join(into, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (1 / F.col("n")).alias("d"))
    edges = settle(links.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("share").alias("t"), F.lit(0.0).alias("d")).union(back))
    stay = start.select("host", *((F.col(c) * (1 - DAMPING)).alias(c) for c in ("trust", "distrust")))
    if edges.isEmpty():
        return stay

    def moved(now: DataFrame) -> DataFrame:
        sent = now.join(edges, now["host"] == edges["from"]).select(F.col("to").alias("host"), (F.col("trust") * F.col("t") * DAMPING).alias("trust"), (F.col("distrust") * F.col("d") * DAMPING).alias("distrust"))
        return stay.union(sent).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    now = settle(stay)
    for _ in range(math.ceil(math.log(SETTLED / 2) / math.log(DAMPING) / AT_ONCE)):
        then = now
        for _ in range(AT_ONCE):  # these joins share one shuffle of the edges
            then = moved(then)
        then = settle(then)
        change = F.abs(F.coalesce("a.trust", F.lit(0)) - F.coalesce("b.trust", F.lit(0))) + F.abs(F.coalesce("a.distrust", F.lit(0)) - F.coalesce("b.distrust", F.lit(0)))
        left = now.alias("a").join(then.alias("b"), F.col("a.host") == F.col("b.host"), "full").agg(F.sum(change).alias("c")).first().c
        forget(now)
        now = then
        if (left or 0) < SETTLED:
            break
    return now


def judged(df: DataFrame, url_col: str = "url", html_col: str = "html", rules: tuple = RULES) -> DataFrame:
    """df with host, path, rule, verdict, trust and distrust.

    A null url or one without :// has an empty host and path, fits no rule and is allowed, as
    is a host that neither rank reaches; null html has no links. Of fitting rules the longest
    pattern wins, and the later in the alphabet of equal ones. Repeated rows each count for
    their host; an empty table is fine; input columns of the new names are replaced.
    """
    rows = ruled(df, url_col, rules)
    seeds = rows.where("host <> '' AND action IS NOT NULL").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked"))
    ranks = propagated(settle(seeds), settle(host_links(df, url_col, html_col)))
    rows = rows.drop("trust", "distrust", "verdict").join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("action", method)).drop("action")


def op10_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))

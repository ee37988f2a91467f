"""URL filters with redirect equivalence, with DataFrame operations only.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's path; the
longest rule wins (of equally long ones, allow). Pages that redirect to or name as canonical another URL are its
aliases: components over these links carry a block from any member to every member that no rule of its own
allows. URLs without a rule and without a blocked alias are allowed.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and have no aliases. Null html gives
no links. Links are resolved against the page's URL; aliases are compared without fragment and dot
segments, with scheme and host in lower case. Repeated rows give repeated results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: host, path, verdict
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: So many rules are put into the plan as a literal; more are joined.
INLINE_RULES = 256

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its segments . and .. (those beyond the root go too)."""
    parts = F.split(path, "/")
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.least(F.size(done), F.lit(1))))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(kept, ends)).otherwise(path)


def node_of(url: Column) -> Column:
    """What aliases are compared by: no fragment, scheme and host in lower case, no dot segments."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    part = lambda i: F.regexp_extract(plain, r"(?s)^([^/?]*://[^/?]*)([^?]*)(.*)$", i)
    origin = F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(origin == "", plain).otherwise(F.concat(origin, without_dots(part(2)), part(3)))


def resolved(base: Column, to: Column) -> Column:
    """The URL that ``to`` means on a page of the URL ``base``; null if that is none with ``://``."""
    part = lambda i: F.regexp_extract(base, r"(?s)^([^/?#]*:)(//[^/?#]*)([^?#]*)", i)
    folder = F.regexp_replace(part(3), r"[^/]*$", "")
    whole = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(to.contains("://"), to))
        .when((part(1) == "") | (to == "") | F.startswith(to, F.lit("#")), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(part(1), to))
        .when(F.startswith(to, F.lit("/")), F.concat(part(1), part(2), to))
        .when(F.startswith(to, F.lit("?")), F.concat(part(1), part(2), part(3), to))
    )
    return whole.otherwise(F.concat(part(1), part(2), F.when(folder == "", "/").otherwise(folder), to))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's URL and the URLs that it redirects to or calls canonical, resolved against its own."""
    head = pages.where("url is not null and html is not null").select("url", "html")
    head = head.where(F.col("html").rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?\s*refresh"))
    tags = lambda tag: F.regexp_extract_all("html", F.lit(tag), F.lit(0))
    named = r"(?is)\srel\s*=\s*(\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']|canonical[\s/>])"
    canonical = F.filter(tags(r"(?is)<link\s[^>]*>"), lambda t: t.rlike(named))
    refresh = tags(r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?\s*refresh[^>]*>")
    to = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)),
    )
    found = head.select("url", F.explode(F.array_distinct(to)).alias("to"))
    links = found.select("url", resolved(F.col("url"), F.replace("to", F.lit("&amp;"), F.lit("&"))).alias("to")).where("to is not null")
    return links.select(node_of(F.replace("url", F.lit("&amp;"), F.lit("&"))).alias("a"), node_of(F.col("to")).alias("b")).where("a <> b")


def with_rules(urls: DataFrame, rules: DataFrame, inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` (with host and path) with rule and own, the verdict of the longest rule that fits."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").distinct()
    given = rules.limit(inline + 1).collect()
    if len(given) <= inline:
        if not given:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "own": F.lit(None).cast("string")})
        listed = F.array(*[
            F.struct(F.lit(len(r[0]) + len(r[1])).alias("n"), F.lit(int(r[2] == "allow")).alias("first"),
                     F.lit(r[0]).alias("host"), F.lit(r[1]).alias("path"), F.lit(r[2]).alias("verdict"))
            for r in given
        ])
        fits = lambda r: (
            ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"])))
            & F.startswith(F.col("path"), r["path"])
        )
        best = urls.withColumn("best", F.array_max(F.filter(listed, fits)))
        return best.withColumns({"rule": F.concat("best.host", "best.path"), "own": F.col("best.verdict")}).drop("best")
    # more rules: every host meets the rules of its suffixes once, then pages meet their host's rules
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(tails).alias("tail"))
    own_rules = rules.withColumnRenamed("host", "tail")
    known = hosts.join(own_rules, "tail").select("host", F.struct(
        (F.length("tail") + F.length("path")).alias("n"), (F.col("verdict") == "allow").cast("int").alias("first"),
        F.col("tail").alias("host"), F.col("path"), F.col("verdict")).alias("r"))
    pairs = urls.select("host", "path").distinct().join(known, "host").where(F.startswith(F.col("path"), F.col("r.path")))
    best = pairs.groupBy("host", "path").agg(F.max("r").alias("r"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("own"))
    return urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page; ``links`` default to those in the pages' html."""
    split = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = with_rules(split(pages.select("page_id", "url")), rules)
    links = materialize(page_links(pages) if links is None else links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")), "url-links")
    if links.isEmpty():
        return judged.withColumn("verdict", F.coalesce("own", F.lit("allow"))).drop("own")
    roots = connected_components(links)
    nodes = with_rules(split(roots.withColumnRenamed("node", "url")), rules)
    blocked = nodes.where("own = 'block'").select("root").distinct()
    aliases = roots.join(blocked, "root").select(F.col("node").alias("alias"), F.lit("block").alias("spread"))
    met = judged.join(aliases, node_of(F.col("url")) == F.col("alias"), "left")
    return met.withColumn("verdict", F.coalesce("own", "spread", F.lit("allow"))).drop("own", "alias", "spread")

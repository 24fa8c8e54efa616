"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

A listed URL with a path stands for itself; one without lists its host and all subdomains. So a page asks for its canonical URL
and for each parent of its host. What the filter lets through of these meets the list in an exact hash join, so the filter's
false positives change no verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import marked
from .shared import settle

#: (host, path, verdict): the rules as they were given.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\A.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """host and path without scheme, a leading ``www.`` or ``m.``, default ports, query, fragment and trailing slashes."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), ":(80|443)\\z", ""), "\\A(www|m)\\.", "")
    return F.concat(host, F.regexp_replace(url_path(url), "/+\\z", ""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host is the host or a parent domain and whose path starts the path; nulls if none."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def asked_urls(canonical: Column) -> Column:
    """array: a canonical URL, its host and the parents of its host; null for a null."""
    host = F.split(canonical, "/")[0]
    parts = F.split(host, "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.concat(F.array(canonical), parents))


def listed_among(rows: DataFrame, listed: DataFrame, url: str = "url", blocks: int | None = None) -> DataFrame:
    """The distinct canonical URLs of rows[url] that ``listed[url]``, canonical too, has or lists by their host: column url.

    Nulls match nothing; repeats on either side do not multiply.
    """
    asked = rows.where(F.col(url).isNotNull()).select(url).distinct().select(url, F.explode(asked_urls(F.col(url))).alias("key"))
    bad = listed.select(F.col(url).alias("key")).distinct()
    return marked(asked, bad, "key", blocks).where("maybe").join(bad, "key", "left_semi").select(url).distinct()


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple = RULES, blocks: int | None = None) -> DataFrame:
    """pages with host, path, rule, listed and verdict; ``listed`` has a column ``url`` of any URLs.

    A fitting rule decides; else a listed URL is blocked and any other allowed. A null URL, or one without
    ``://``, has empty host and path, fits no rule, is not listed and so allowed. Repeated rows and other columns stay,
    whatever their names; columns of the five names are replaced.
    """
    bad = settle(listed.select(canonical_url(F.col("url")).alias("url")).where("url <> ''").distinct())
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = pages.select(F.struct("*").alias("row"), F.col(url).alias("given"))
    own = own.select("row", url_host(F.col("given")).alias("host"), url_path(F.col("given")).alias("path"), F.nullif(canonical_url(F.col("given")), F.lit("")).alias("url"))
    own = own.withColumns({"rule": text, "ruled": verdict})
    hits = settle(listed_among(own, bad, "url", blocks)).withColumn("listed", F.lit(True))
    # only pages whose URL may be listed are shuffled to the hits
    asked = marked(own, hits, "url", blocks)
    clear = asked.where("not maybe").withColumn("listed", F.lit(False))
    rest = asked.where("maybe").join(hits.hint("shuffle_hash"), "url", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = clear.unionByName(rest.select(*clear.columns))
    out = out.withColumn("verdict", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")))
    names = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    return out.select(*names, "host", "path", "rule", "listed", "verdict")

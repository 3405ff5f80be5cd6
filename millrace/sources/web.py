"""Crawling as data: addresses, scopes, robots rules, the frontier, politeness, outcomes."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex


def _plain_path(path: Column) -> Column:
    """Without empty, . and .. segments; a .. that has nothing to go up from stays."""
    segments = F.split(path, "/")
    up = lambda done: (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
    step = lambda done, x: (
        F.when((x == "") | (x == "."), done).when((x == "..") & up(done), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    )
    body = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    folder = path.rlike(r"(?:/|/\.|/\.\.)$") & (body != "") & ~body.rlike(r"(?:^|/)\.\.$")
    return F.when(path.rlike(r"//|/\.\.?(?:/|$)"), F.concat(F.lit("/"), body, F.when(folder, "/").otherwise(""))).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, the host in ASCII, no default port, no fragment, a path without dot segments; null
    for other schemes and hosts that have no ASCII form."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(u, r"^(?i)(https?)://([^/?#:]+)(:\d+)?(/[^?]*)?(\?.*)?$", i)
    scheme = F.lower(part(1))
    host = F.when(part(2).rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), part(2))).otherwise(part(2))
    port = F.when((scheme == "http") & (part(3) == ":80") | (scheme == "https") & (part(3) == ":443"), "").otherwise(part(3))
    path = F.when(part(4) == "", "/").otherwise(_plain_path(part(4)))
    return F.when(scheme == "", F.lit(None)).otherwise(F.concat(scheme, F.lit("://"), F.lower(host), port, path, part(5)))


def resolved_url(base: Column, reference: Column) -> Column:
    """A reference of a page as an address: its own if it has a scheme, else by the page's. Blanks inside are encoded; without a
    page's address, or where that is none, the reference stays as it is."""
    ref = F.replace(F.trim(reference), F.lit(" "), F.lit("%20"))
    part = lambda i: F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?", i)
    scheme, host, path, asked = (part(i) for i in range(1, 5))
    own, rest = F.regexp_extract(ref, r"^[^?#]*", 0), F.regexp_extract(ref, r"[?#].*$", 0)
    folder = F.regexp_extract(path, r"^.*/", 0)
    below = F.concat(F.when(folder == "", "/").otherwise(folder), own)
    start = F.concat(scheme, F.lit(":"), host)
    joined = (
        F.when(own.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(own.startswith("/"), F.concat(start, _plain_path(own), rest))
        .when(own != "", F.concat(start, _plain_path(below), rest))
        .when(rest.startswith("?"), F.concat(start, path, rest))
        .otherwise(F.concat(start, path, asked, rest))
    )
    return F.when((F.coalesce(scheme, F.lit("")) == "") | ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).otherwise(joined)


def in_scope(url: Column, hosts: list[str], subdomains: bool = False, include: list[str] = (), exclude: list[str] = (), seed: str | Column | None = None) -> Column:
    """Whether an address has one of the hosts, the seed's where none is named, and passes the patterns."""
    name = lambda c: F.regexp_extract(c, r"^https?://([^/?#:]+)", 1)
    host = name(url)
    allowed = [F.lit(h.lower()) for h in hosts] or ([name(canonical_url(F.lit(seed) if isinstance(seed, str) else seed))] if seed is not None else [])
    ok = F.lit(False)
    for h in allowed:
        ok = ok | (host == h)
        if subdomains:
            ok = ok | host.endswith(F.concat(F.lit("."), h))
    if include:
        some = F.lit(False)
        for p in include:
            some = some | url.rlike(glob_to_regex(p))
        ok = ok & some
    for p in exclude:
        ok = ok & ~url.rlike(glob_to_regex(p))
    return F.coalesce(ok, F.lit(False))


def robots_rules(bodies: DataFrame, key: str, body: str, agent: str) -> DataFrame:
    """key, allow, prefix: the rules of groups for every agent or one whose name is part of ours. Of agent lines in a
    row the last decides."""
    lines = bodies.select(key, F.posexplode(F.split(F.col(body), r"\r?\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.select(key, "pos", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("field"), F.trim(F.regexp_replace(clean, r"^[^:]*:", "")).alias("value"))
    name = F.lower("value")
    applies = F.when(F.col("field") == "user-agent", (name == "*") | ((name != "") & F.lit(agent.lower()).contains(name)))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("on", F.last(applies, ignorenulls=True).over(upto))
    rows = rows.where(F.col("on") & F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return rows.select(key, (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix")).distinct()


def robots_allowed(paths: DataFrame, rules: DataFrame, key: str, path: str) -> DataFrame:
    """Each path with ``allowed``: the longest matching prefix decides, for allowing where they tie; without rules all
    is allowed. Rules join by host, so their number by host is what a path meets."""
    ids = paths.select(key, path).distinct()
    hit = ids.join(rules, key).where(F.col(path).startswith(F.col("prefix")))
    best = hit.groupBy(key, path).agg(F.max(F.when(F.col("allow"), F.length("prefix"))).alias("a"), F.max(F.when(~F.col("allow"), F.length("prefix"))).alias("d"))
    met = paths.join(best, [key, path], "left")
    return met.withColumn("allowed", F.coalesce("a", F.lit(0)) >= F.coalesce("d", F.lit(0))).drop("a", "d")


def next_frontier(links: DataFrame, seen: DataFrame, depth: int, most: int) -> DataFrame:
    """url, depth of addresses that are new, at most ``most`` of them, by address."""
    fresh = links.select("url").where("url is not null").distinct().join(seen.select("url"), "url", "left_anti")
    return fresh.orderBy("url").limit(most).withColumn("depth", F.lit(depth))


def expand_frontier(seeds: DataFrame, fetch_links, allowed, max_depth: int, max_pages: int) -> DataFrame:
    """url, depth of all addresses reached. ``fetch_links(urls)`` gives the links of pages, ``allowed(url)`` the scope;
    each depth is checkpointed, so lineage does not grow with the crawl."""
    seen = seeds.select(canonical_url(F.col("url")).alias("url")).where("url is not null").distinct().limit(max_pages).withColumn("depth", F.lit(0))
    seen = seen.checkpoint()
    level = seen
    for depth in range(1, max_depth + 1):
        left = max_pages - seen.count()
        if left <= 0:
            break
        links = fetch_links(level).select(canonical_url(F.col("url")).alias("url")).where(allowed(F.col("url")))
        level = next_frontier(links, seen, depth, left).checkpoint()
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level).checkpoint()
    return seen


def politeness_slots(urls: DataFrame, delay_ms: int, key: str) -> DataFrame:
    """Each address with the time after which its host may be asked; equal addresses go by their ``key``."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    return urls.withColumn("host", host).withColumn("wait_ms", (F.row_number().over(Window.partitionBy("host").orderBy(F.asc_nulls_last("url"), key)) - 1) * delay_ms)


def fetch_outcome(status: Column, size: Column, error: Column, most: int) -> Column:
    return F.when(error.isNotNull(), "FAILED").when(size > most, "TOO_LARGE").when(status.between(200, 299), "SUCCEEDED").otherwise("HTTP_ERROR")


def public_host(address: str) -> bool:
    """Whether a resolved address may be fetched: not private, loopback, link-local or otherwise special."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    return ip.is_global and not ip.is_multicast

"""Request classification by ordered rule tables, error-cache lookup,
sanity-check fan-out and traffic per mirror / class.

Static rule tables compile to CASE chains (O4).  Rule tables that arrive as
data use ``classify_by_table``: the ordered rules travel as one array and each
row takes the first that matches, in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.functions.rules import first_match, glob_regex

# Cache lifetime by file name, first match wins, default "off".
CACHE_RULES = [
    (r"\.(rpm|deb|tar\.zst|tar\.xz)$", "1M"),
    (r"\/by-hash\/(MD5Sum|SHA256)\/", "1M"),
    (r"\.(xml|sqlite).*$", "30m"),
    (r"\.(abs\.tar\.gz|db|db\.tar\.gz|files|files\.tar\.gz|links\.tar\.gz)$", "30m"),
    (r"(Index|Packages.*|Sources.*|Release.*|InRelease)$", "30m"),
]
CACHE_DEFAULT = "off"

# CDN behaviours in precedence order
# (path pattern, default TTL seconds, origin, viewer protocol policy); then the default behaviour.
CDN_BEHAVIOURS = [
    ("/debian/*", 86400, "load-balancer", "allow-all"),
    ("/debian-security/*", 86400, "load-balancer", "allow-all"),
    ("/ubuntu/*", 86400, "load-balancer", "allow-all"),
    ("/jobs", 300, "load-balancer", "redirect-to-https"),
    ("/rubygems/gems/*", 604800, "object-store", "redirect-to-https"),
    ("/rubygems/*", 3600, "object-store", "redirect-to-https"),
]
CDN_DEFAULT = ("default", 86400, "load-balancer", "redirect-to-https")

# Error caching (status, min TTL seconds, response code, response page).
ERROR_CACHE = [
    (500, 30, None, None),
    (502, 0, None, None),
    (503, 0, None, None),
    (404, 3600, 404, "/404.html"),
]

# HTTPS listener routes (priority, path patterns, target), then default.
HTTPS_ROUTES = [
    (6, ["/static/tunasync.json"], "redirect:/jobs"),
    (8, ["/static/status/isoinfo.json"], "redirect:/isoinfo.json"),
    (10, ["/", "/404.html", "/index.html", "/robots.txt", "/sitemap.xml"], "web-portal"),
    (15, ["/help/*", "/news/*", "/static/*", "/status/*"], "web-portal"),
    (20, ["/jobs"], "sync-manager"),
]
HTTPS_DEFAULT = "content-server"
# Plain-HTTP listener routes, then its default (redirect to port 443).
HTTP_ROUTES = [
    (20, ["/debian/*", "/debian-security/*", "/ubuntu/*"], "content-server"),
]
HTTP_DEFAULT = "redirect:https:443"


def cache_class(uri: Column) -> Column:
    """Cache lifetime of a request path."""
    return first_match(uri, CACHE_RULES, CACHE_DEFAULT)


def behaviour_rules() -> list[tuple[str, str]]:
    return [(glob_regex(p), p) for p, *_ in CDN_BEHAVIOURS]


def cdn_behaviour(uri: Column) -> Column:
    """struct(pattern, ttl, origin, viewer_protocol) of the first matching behaviour."""
    def pick(i: int) -> Column:
        return first_match(uri, [(glob_regex(b[0]), b[i]) for b in CDN_BEHAVIOURS], CDN_DEFAULT[i])
    return F.struct(pick(0).alias("pattern"), pick(1).cast("int").alias("ttl"),
                    pick(2).alias("origin"), pick(3).alias("viewer_protocol"))


def route_rules(routes) -> list[tuple[str, str]]:
    return [(glob_regex(p), target) for _, pats, target in sorted(routes, key=lambda r: r[0]) for p in pats]


def route_target(uri: Column, protocol: Column) -> Column:
    """C4: listener rule by priority; the plain-HTTP listener only serves the
    package paths and redirects everything else to HTTPS."""
    path = F.regexp_replace(uri, r"\?.*$", "")
    https = first_match(path, route_rules(HTTPS_ROUTES), HTTPS_DEFAULT)
    http = first_match(path, route_rules(HTTP_ROUTES), HTTP_DEFAULT)
    return F.when(protocol == "http", http).otherwise(https)


def error_cache_table(spark) -> DataFrame:
    return spark.createDataFrame(ERROR_CACHE, "status int, min_ttl int, response_code int, response_page string")


def with_error_cache(df: DataFrame) -> DataFrame:
    """Equi left join on ``status`` against the 4-row error table
    (broadcast: the table is fixed configuration, its size is bounded)."""
    return df.join(F.broadcast(error_cache_table(df.sparkSession)), "status", "left")


def mirror_segment(uri: Column) -> Column:
    """The first path segment (the mirror directory); '' when the path has
    no second slash (Q2's key without its slashes)."""
    key = uri.substr(F.lit(1), F.instr(uri.substr(F.lit(2), F.lit(1 << 30)), "/") + 1)
    return F.regexp_replace(key, "/", "")


def traffic_by_segment(log: DataFrame) -> DataFrame:
    """Pre-aggregate the log per mirror segment (map-side partial aggregate)."""
    return (log.groupBy(mirror_segment(F.col("uri")).alias("mirror"))
            .agg(F.count("*").alias("requests"), F.sum("bytes").alias("total_bytes")))


def traffic_per_mirror(traffic: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Traffic per segment joined with the catalog by name.  ``inner`` =
    traffic per mirror, ``left_anti`` from the catalog side = mirrors without
    traffic (use :func:`mirrors_without_traffic`), ``left_anti`` from the
    traffic side = traffic without mirror."""
    cat = F.broadcast(catalog.select(F.col("name").alias("mirror"), "provider", "interval"))
    if how == "left_anti":
        return traffic.join(cat, "mirror", "left_anti")
    return traffic.join(cat, "mirror", how)


def mirrors_without_traffic(catalog: DataFrame, traffic: DataFrame) -> DataFrame:
    return catalog.join(traffic.select(F.col("mirror").alias("name")), "name", "left_anti")


def sanity_checks(targets: DataFrame) -> DataFrame:
    """One check per (target, image), named ``MonitorProjectFor<name><image>``."""
    return targets.select("name", "repo", F.explode("images").alias("image")).withColumn(
        "check_name", F.concat(F.lit("MonitorProjectFor"), F.col("name"), F.col("image")))


LITERAL_RULES = 256  # so many branches at most make a chain


def classify_by_table(df: DataFrame, key: str, rules: DataFrame, out: str) -> DataFrame:
    """First-match classification with the rule table given as data (columns ``priority, pattern, value``); null patterns fit
    nothing, no match gives null.  Map-only in both forms: the log is scanned once, nothing is joined or shuffled.

    Up to LITERAL_RULES rules become a ``CASE`` chain of literal patterns, each compiled once per task.  Beyond that the
    ordered rules travel as one array (a scalar subquery) and each row takes the first that matches."""
    rules = rules.select("priority", "pattern", "value")
    few = rules.limit(LITERAL_RULES + 1).collect()
    if len(few) <= LITERAL_RULES:
        few.sort(key=lambda r: tuple((v is not None, v) for v in r))  # as sort_array: nulls first, ties by pattern and value
        chain = first_match(F.col(key), [(r.pattern, r.value) for r in few if r.pattern is not None], None)
        return df.withColumn(out, chain.cast(rules.schema["value"].dataType))
    ordered = rules.agg(F.sort_array(F.collect_list(F.struct("priority", "pattern", "value"))).alias("r")).scalar()
    fits = F.filter("__rules", lambda r: F.rlike(F.col(key), r["pattern"]))
    return df.withColumn("__rules", ordered).withColumn(out, F.try_element_at(fits, F.lit(1))["value"]).drop("__rules")

"""Query keys of the rule classification (C1-C7) over the access log."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelog.functions.rules import first_match_sql, glob_regex
from edgelog.operators import classify as C
from edgelog.plans.oracle import LOG_CTE
from edgelog.plans.registry import register
from edgelog.sources.catalog import mirror_catalog, mirror_values_sql
from edgelog.sources.fixture import access_log


def _agg(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("bytes").alias("total_bytes"))


AGG_SQL = "count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS total_bytes"


@register("traffic_by_cache_class", LOG_CTE + f"""
SELECT {first_match_sql('uri', C.CACHE_RULES, C.CACHE_DEFAULT)} AS cache_policy, {AGG_SQL}
FROM log GROUP BY 1""")
def traffic_by_cache_class(spark, sf):
    """C1 + C7: requests and bytes per cache lifetime class."""
    log = access_log(spark, sf)
    return _agg(log.withColumn("cache_policy", C.cache_class(F.col("uri"))), "cache_policy")


def _beh_sql(i):
    return first_match_sql("uri", [(glob_regex(b[0]), b[i]) for b in C.CDN_BEHAVIOURS], C.CDN_DEFAULT[i])


@register("traffic_by_behaviour", LOG_CTE + f"""
SELECT {_beh_sql(0)} AS pattern, CAST({_beh_sql(1)} AS INT) AS ttl, {_beh_sql(2)} AS origin,
       {_beh_sql(3)} AS viewer_protocol, {AGG_SQL}
FROM log GROUP BY 1, 2, 3, 4""")
def traffic_by_behaviour(spark, sf):
    """C2 + C7: traffic per CDN behaviour (TTL, origin, protocol policy)."""
    log = access_log(spark, sf).withColumn("b", C.cdn_behaviour(F.col("uri")))
    return _agg(log, "b.pattern", "b.ttl", "b.origin", "b.viewer_protocol")


ROUTE_SQL = (f"CASE WHEN request_protocol = 'http' THEN "
             f"{first_match_sql('regexp_replace(uri, chr(92) || \'?.*$\', \'\')', C.route_rules(C.HTTP_ROUTES), C.HTTP_DEFAULT)} "
             f"ELSE {first_match_sql('regexp_replace(uri, chr(92) || \'?.*$\', \'\')', C.route_rules(C.HTTPS_ROUTES), C.HTTPS_DEFAULT)} END")


@register("traffic_by_route", LOG_CTE + f"""
SELECT request_protocol, {ROUTE_SQL} AS route, {AGG_SQL} FROM log GROUP BY 1, 2""")
def traffic_by_route(spark, sf):
    """C4 + C7: traffic per listener route target and protocol."""
    log = access_log(spark, sf)
    return _agg(log.withColumn("route", C.route_target(F.col("uri"), F.col("request_protocol"))),
                "request_protocol", "route")


ERR_VALUES = ", ".join(f"({s}, {t}, {'NULL' if c is None else c}, {'NULL' if p is None else repr(p)})"
                       for s, t, c, p in C.ERROR_CACHE)


@register("error_cache", LOG_CTE + f"""
SELECT l.status, l.requests, e.min_ttl, e.response_code, e.response_page
FROM (SELECT status, count(*) AS requests FROM log GROUP BY status) l
LEFT JOIN (VALUES {ERR_VALUES}) AS e(status, min_ttl, response_code, response_page) ON l.status = e.status""")
def error_cache(spark, sf):
    """Requests per status with the error-caching rule that applies."""
    per_status = access_log(spark, sf).groupBy("status").agg(F.count("*").alias("requests"))
    return C.with_error_cache(per_status).select("status", "requests", "min_ttl", "response_code", "response_page")


SEGMENT_SQL = "replace(substr(uri, 1, strpos(substr(uri, 2), '/') + 1), '/', '')"
TRAFFIC_SQL = f", traffic AS (SELECT {SEGMENT_SQL} AS mirror, {AGG_SQL} FROM log GROUP BY 1)\n"


@register("traffic_by_mirror", LOG_CTE + TRAFFIC_SQL + f"""
SELECT t.mirror, m.provider, m."interval", t.requests, t.total_bytes
FROM traffic t JOIN {mirror_values_sql()} ON t.mirror = m.name""")
def traffic_by_mirror(spark, sf):
    """C6 (inner): traffic per configured mirror."""
    t = C.traffic_by_segment(access_log(spark, sf))
    return C.traffic_per_mirror(t, mirror_catalog(spark)).select(
        "mirror", "provider", "interval", "requests", "total_bytes")


@register("mirrors_without_traffic", LOG_CTE + TRAFFIC_SQL + f"""
SELECT m.name, m.provider, m."interval" FROM {mirror_values_sql()}
WHERE m.name NOT IN (SELECT mirror FROM traffic)""")
def mirrors_without_traffic(spark, sf):
    """C6 (anti, catalog side): configured mirrors nobody requested."""
    t = C.traffic_by_segment(access_log(spark, sf))
    return C.mirrors_without_traffic(mirror_catalog(spark), t).select("name", "provider", "interval")


@register("traffic_without_mirror", LOG_CTE + TRAFFIC_SQL + f"""
SELECT t.mirror, t.requests, t.total_bytes FROM traffic t
WHERE t.mirror NOT IN (SELECT name FROM {mirror_values_sql()})""")
def traffic_without_mirror(spark, sf):
    """C6 (anti, traffic side): requested top-level paths with no mirror."""
    t = C.traffic_by_segment(access_log(spark, sf))
    return C.traffic_per_mirror(t, mirror_catalog(spark), how="left_anti").select("mirror", "requests", "total_bytes")


@register("traffic_by_rule_table", LOG_CTE + f"""
SELECT {first_match_sql('uri', C.CACHE_RULES, C.CACHE_DEFAULT)} AS cache_policy, {AGG_SQL}
FROM log GROUP BY 1""")
def traffic_by_rule_table(spark, sf):
    """C1 with the rule table supplied as data (one ordered array, first match in the scan)."""
    rules = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(C.CACHE_RULES)],
                                  "priority int, pattern string, value string")
    log = C.classify_by_table(access_log(spark, sf), "uri", rules, "cache_policy")
    return _agg(log.withColumn("cache_policy", F.coalesce("cache_policy", F.lit(C.CACHE_DEFAULT))), "cache_policy")

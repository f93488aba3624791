"""Deterministic edge access log derived from the driver tables.

Every ``events`` row becomes one request; ``view``/``purchase`` events become
package downloads whose file name comes from the ``part`` row keyed by
``event_id mod |part|``.  The same text exists as DuckDB SQL in
``edgelog.plans.oracle`` so results can be checked engine against engine.

Scale notes: ``events`` is the fact side; ``part`` is joined on a computed key
that is unique per event (no skew).  Catalyst/AQE choose broadcast only when
the measured size of ``part`` is under ``spark.sql.autoBroadcastJoinThreshold``;
otherwise this is a sort-merge join on ``p_partkey``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.schema import ALL_COLUMNS
from edgelog.sources.tables import table


def _case(key: Column, mapping: list[tuple[int, str]], default: str) -> Column:
    expr = None
    for k, v in mapping:
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


# Fixed values of the fixture log (must equal the oracle SQL text).
MIRROR_DIRS = [(0, "/debian"), (1, "/ubuntu"), (2, "/rubygems"), (3, "/alpine"),
               (4, "/archlinux"), (5, "/centos"), (6, "/static")]
FILE_TAILS = [(0, "/pool/a.deb"), (1, "/by-hash/SHA256/ab"), (2, "/dists/Packages.gz"),
              (3, "/repodata/primary.xml.gz"), (4, "/core.db"), (5, "/gems/x.gem"),
              (6, "/tunasync.json"), (7, "/jobs")]
LOCATIONS = [(0, "PEK50"), (1, "ZHY50")]


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 37-column access log (33 data fields + year/month/day/hour)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_part = p.select(F.count("*")).scalar()
    j = e.join(p, p.p_partkey == (e.event_id % n_part), "left")

    uid, eid, et = F.col("user_id"), F.col("event_id"), F.col("event_type")
    h = F.md5(F.col("p_name"))
    pkg_file = F.concat(
        F.lit("/pypi/web/packages/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"),
        F.expr("substr(md5(p_name), 5)"), F.lit("/"),
        F.when(F.col("p_partkey") % 2 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
         .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))),
        F.lit("-1."), (eid % 4).cast("string"), F.lit(".whl"))
    mirror_path = F.concat(_case(uid % 8, MIRROR_DIRS, ""), _case(eid % 9, FILE_TAILS, "/"))
    status = (F.when(et == "error", F.when(eid % 3 == 0, 404).when(eid % 3 == 1, 500).otherwise(403))
               .when(et == "signup", 302).when(et == "click", 206).otherwise(200)).cast("int")
    result_type = F.when(et == "error", "Error").when(eid % 4 == 0, "Miss").otherwise("Hit")
    nbytes = F.floor(F.col("value") * 1000).cast("bigint")

    cols = {
        "date": F.col("ts").cast("date"),
        "time": F.date_format("ts", "HH:mm:ss"),
        "location": _case(uid % 3, LOCATIONS, "NRT12"),
        "bytes": nbytes,
        "request_ip": F.concat(F.lit("10.0."), (uid % 256).cast("string"), F.lit("."), (eid % 256).cast("string")),
        "method": F.when(eid % 10 == 0, "HEAD").otherwise("GET"),
        "host": F.lit("cdn.example.com"),
        "uri": F.when(et.isin("view", "purchase"), pkg_file).otherwise(mirror_path),
        "status": status,
        "referrer": F.lit("-"),
        "user_agent": F.concat(F.lit("agent/"), (uid % 7).cast("string")),
        "query_string": F.lit("-"),
        "cookie": F.lit("-"),
        "result_type": result_type,
        "result_id": F.md5(eid.cast("string")),
        "host_header": F.lit("mirror.example.com"),
        "request_protocol": F.when(uid % 5 == 0, "http").otherwise("https"),
        "request_bytes": (200 + eid % 300).cast("bigint"),
        "time_taken": ((eid % 16) * 0.25).cast("float"),
        "xforwarded_for": F.lit("-"),
        "ssl_protocol": F.lit("TLSv1.3"),
        "ssl_cipher": F.lit("TLS_AES_128_GCM_SHA256"),
        "response_result_type": result_type,
        "http_version": F.lit("HTTP/2.0"),
        "fle_status": F.lit("-"),
        "fle_encrypted_fields": F.lit(None).cast("int"),
        "c_port": (1024 + uid % 60000).cast("int"),
        "time_to_first_byte": ((eid % 8) * 0.125).cast("float"),
        "x_edge_detailed_result_type": F.lit("-"),
        "sc_content_type": F.lit("application/octet-stream"),
        "sc_content_len": nbytes,
        "sc_range_start": F.lit(None).cast("bigint"),
        "sc_range_end": F.lit(None).cast("bigint"),
        "year": F.date_format("ts", "yyyy"),
        "month": F.date_format("ts", "MM"),
        "day": F.date_format("ts", "dd"),
        "hour": F.date_format("ts", "HH"),
    }
    return j.select(*[cols[c].alias(c) for c in ALL_COLUMNS])

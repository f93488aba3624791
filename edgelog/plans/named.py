"""Q1-Q4: the four parameterised monthly traffic queries, and S5 (result sink).

The texts are Spark SQL over a DataFrame bound as ``{log}`` with named
parameter markers ``:year`` / ``:month`` (never string-pasted).  Differences
from the original dialect, all with the same rows:
- ``position(p in uri) = 1`` is written ``startswith(uri, p)`` so the prefix
  reaches Parquet as a pushed ``StringStartsWith`` filter;
- 1-based array access uses ``try_element_at`` (ANSI mode would raise before
  the arity filter runs; filter order is not guaranteed);
- ties under LIMIT are broken by the grouping key ascending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMED_QUERIES: dict[str, str] = {
    "monthly_requests_per_day": """
        SELECT concat(year, '-', month, '-', day) AS day,
               count(*) AS total_requests, sum(bytes) AS total_bytes
        FROM {log}
        WHERE year = :year AND month = :month AND status < 400
        GROUP BY concat(year, '-', month, '-', day)
        ORDER BY day""",
    "monthly_requests_stats_per_path": """
        SELECT substr(uri, 1, instr(substr(uri, 2), '/') + 1) AS uriwithprefix,
               count(*) AS total_requests, sum(bytes) AS total_bytes
        FROM {log}
        WHERE year = :year AND month = :month AND status < 400
        GROUP BY substr(uri, 1, instr(substr(uri, 2), '/') + 1)
        ORDER BY total_requests DESC, uriwithprefix
        LIMIT 100""",
    "monthly_pypi_stats_per_day": """
        SELECT concat(year, '-', month, '-', day) AS day,
               count(*) AS total_requests, sum(bytes) AS total_bytes
        FROM {log}
        WHERE year = :year AND month = :month AND status < 400
          AND startswith(uri, '/pypi/web')
        GROUP BY year, month, day
        ORDER BY day""",
    "monthly_pypi_package_download_ranking": """
        SELECT try_element_at(split(try_element_at(split(uri, '/'), 8), '-'), 1) AS packageName,
               count(*) AS download_count
        FROM {log}
        WHERE year = :year AND month = :month AND status < 400
          AND startswith(uri, '/pypi/web/packages/')
          AND size(split(uri, '/')) = 8
        GROUP BY try_element_at(split(try_element_at(split(uri, '/'), 8), '-'), 1)
        ORDER BY download_count DESC, packageName
        LIMIT 50""",
}


def run_named(spark: SparkSession, name: str, log: DataFrame, year: str, month: str) -> DataFrame:
    """Run one named query over ``log`` (the combined view or any DataFrame
    with its columns) for one month."""
    return spark.sql(NAMED_QUERIES[name], args={"year": year, "month": month}, log=log)


def save_result(result: DataFrame, results_root: str, query_name: str, fmt: str = "csv") -> str:
    """Every result lands under one results location, one folder per query."""
    path = f"{results_root.rstrip('/')}/{query_name}"
    w = result.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def main(argv: list[str] | None = None) -> str:
    """Run one named query for a month over a lake's combined view and
    write the result under the results location (S5).

    ``python -m edgelog.plans.named monthly_requests_per_day --lake ROOT --year 2024 --month 01
    --results RESULTS [--now 2024-01-30T22:20]``"""
    import argparse
    import datetime as dt

    from edgelog.plans.lake import Lake
    from edgelog.session import get_session

    ap = argparse.ArgumentParser(description=main.__doc__)
    ap.add_argument("query", choices=sorted(NAMED_QUERIES))
    ap.add_argument("--lake", required=True)
    ap.add_argument("--year", required=True)
    ap.add_argument("--month", required=True)
    ap.add_argument("--results", required=True)
    ap.add_argument("--now", default=None, help="UTC wall time, ISO format (default: now)")
    ap.add_argument("--format", default="csv")
    a = ap.parse_args(argv)
    now = dt.datetime.fromisoformat(a.now) if a.now else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark = get_session(app_name=f"edgelog-{a.query}")
    result = run_named(spark, a.query, Lake(a.lake, now).view(spark), a.year, a.month)
    path = save_result(result, a.results, a.query, a.format)
    print(path)
    return path


if __name__ == "__main__":
    main()

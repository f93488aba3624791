"""DuckDB texts of the same computations (the correctness oracle).

``LOG_CTE`` is the fixture access log in DuckDB's dialect; the Spark twin is
``edgelog.sources.fixture.access_log``.
"""

LOG_SELECT = """
SELECT CAST(e.ts AS DATE) AS "date", strftime(e.ts, '%H:%M:%S') AS "time",
 CASE e.user_id%3 WHEN 0 THEN 'PEK50' WHEN 1 THEN 'ZHY50' ELSE 'NRT12' END AS location,
 CAST(floor(e.value*1000) AS BIGINT) AS bytes,
 '10.0.'||(e.user_id%256)||'.'||(e.event_id%256) AS request_ip,
 CASE WHEN e.event_id%10=0 THEN 'HEAD' ELSE 'GET' END AS method, 'cdn.example.com' AS host,
 CASE WHEN e.event_type IN ('view','purchase') THEN '/pypi/web/packages/'||substr(md5(p.p_name),1,2)||'/'||substr(md5(p.p_name),3,2)||'/'||substr(md5(p.p_name),5)||'/'||CASE WHEN p.p_partkey%2=0 THEN replace(p.p_name,' ','-') ELSE replace(p.p_name,' ','_') END||'-1.'||(e.event_id%4)||'.whl'
  ELSE CASE e.user_id%8 WHEN 0 THEN '/debian' WHEN 1 THEN '/ubuntu' WHEN 2 THEN '/rubygems' WHEN 3 THEN '/alpine' WHEN 4 THEN '/archlinux' WHEN 5 THEN '/centos' WHEN 6 THEN '/static' ELSE '' END
   || CASE e.event_id%9 WHEN 0 THEN '/pool/a.deb' WHEN 1 THEN '/by-hash/SHA256/ab' WHEN 2 THEN '/dists/Packages.gz' WHEN 3 THEN '/repodata/primary.xml.gz' WHEN 4 THEN '/core.db' WHEN 5 THEN '/gems/x.gem' WHEN 6 THEN '/tunasync.json' WHEN 7 THEN '/jobs' ELSE '/' END END AS uri,
 CAST(CASE e.event_type WHEN 'error' THEN CASE e.event_id%3 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 403 END WHEN 'signup' THEN 302 WHEN 'click' THEN 206 ELSE 200 END AS INT) AS status,
 '-' AS referrer, 'agent/'||(e.user_id%7) AS user_agent, '-' AS query_string, '-' AS cookie,
 CASE WHEN e.event_type='error' THEN 'Error' WHEN e.event_id%4=0 THEN 'Miss' ELSE 'Hit' END AS result_type,
 md5(CAST(e.event_id AS STRING)) AS result_id, 'mirror.example.com' AS host_header,
 CASE WHEN e.user_id%5=0 THEN 'http' ELSE 'https' END AS request_protocol,
 CAST(200+e.event_id%300 AS BIGINT) AS request_bytes, CAST((e.event_id%16)*0.25 AS FLOAT) AS time_taken,
 '-' AS xforwarded_for, 'TLSv1.3' AS ssl_protocol, 'TLS_AES_128_GCM_SHA256' AS ssl_cipher,
 CASE WHEN e.event_type='error' THEN 'Error' WHEN e.event_id%4=0 THEN 'Miss' ELSE 'Hit' END AS response_result_type,
 'HTTP/2.0' AS http_version, '-' AS fle_status, CAST(NULL AS INT) AS fle_encrypted_fields,
 CAST(1024+e.user_id%60000 AS INT) AS c_port, CAST((e.event_id%8)*0.125 AS FLOAT) AS time_to_first_byte,
 '-' AS x_edge_detailed_result_type, 'application/octet-stream' AS sc_content_type,
 CAST(floor(e.value*1000) AS BIGINT) AS sc_content_len, CAST(NULL AS BIGINT) AS sc_range_start, CAST(NULL AS BIGINT) AS sc_range_end,
 strftime(e.ts,'%Y') AS year, strftime(e.ts,'%m') AS month, strftime(e.ts,'%d') AS day, strftime(e.ts,'%H') AS hour
FROM events e LEFT JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part)
"""

LOG_CTE = f"WITH log AS ({LOG_SELECT})\n"

DATA_COLS = ("\"date\", \"time\", location, bytes, request_ip, method, host, uri, status, referrer, user_agent, "
             "query_string, cookie, result_type, {rid}, host_header, request_protocol, request_bytes, time_taken, "
             "xforwarded_for, ssl_protocol, ssl_cipher, response_result_type, http_version, fle_status, "
             "fle_encrypted_fields, c_port, time_to_first_byte, x_edge_detailed_result_type, sc_content_type, "
             "sc_content_len, sc_range_start, sc_range_end, year, month, day, hour")

Q1 = """SELECT year||'-'||month||'-'||day AS day, count(*) AS total_requests, CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM log WHERE year = '2024' AND month = '01' AND status < 400
GROUP BY year||'-'||month||'-'||day ORDER BY day"""

Q2 = """SELECT substr(uri, 1, strpos(substr(uri, 2), '/') + 1) AS uriwithprefix, count(*) AS total_requests,
 CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM log WHERE year = '2024' AND month = '01' AND status < 400
GROUP BY substr(uri, 1, strpos(substr(uri, 2), '/') + 1)
ORDER BY total_requests DESC, uriwithprefix LIMIT 100"""

Q3 = """SELECT year||'-'||month||'-'||day AS day, count(*) AS total_requests, CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM log WHERE year = '2024' AND month = '01' AND status < 400 AND position('/pypi/web' in uri) = 1
GROUP BY year, month, day ORDER BY day"""

Q4 = """SELECT string_split(string_split(uri, '/')[8], '-')[1] AS "packageName", count(*) AS download_count
FROM log WHERE year = '2024' AND month = '01' AND status < 400
 AND position('/pypi/web/packages/' in uri) = 1 AND len(string_split(uri, '/')) = 8
GROUP BY string_split(string_split(uri, '/')[8], '-')[1]
ORDER BY download_count DESC, "packageName" LIMIT 50"""

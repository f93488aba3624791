"""DuckDB texts for the queries that SQL can express."""

from __future__ import annotations

_OP9 = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
wins AS (SELECT n, win, list(DISTINCT item) AS items FROM bw GROUP BY n, win),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, items FROM dw JOIN wins USING (n, win)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, unnest(items) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

_LINK = r"""(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_OP7 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q, v AS c WHERE q.vec_id % 20 = 0 AND q.r <> c.r),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 20
"""


def _op3() -> str:
    """Six times four unrolled rounds; four take place if a fortieth of the mass or more still moves, and 0.85**24 is less.
    Constants are written out, not taken from the operator."""
    rounds = ""
    for i in range(24):
        if i % 4 == 0:
            rounds += f"\ng{i // 4} AS MATERIALIZED (SELECT coalesce(sum(m), 0) > 0 AND sum(m) * 40 >= (SELECT sum(s) FROM seeds) AS go FROM m{i}),"
        rounds += f"""
m{i + 1} AS MATERIALIZED (SELECT host, kind, CAST(sum(m) AS BIGINT) AS m, CAST(sum(done) AS BIGINT) AS done FROM (
  SELECT b AS host, kind, CAST(m AS HUGEINT) * n * 85 // (total * 100) AS m, 0 AS done
  FROM m{i} JOIN moves ON moves.a = m{i}.host AND moves.k = m{i}.kind WHERE (SELECT go FROM g{i // 4})
  UNION ALL SELECT host, kind, CASE WHEN go THEN 0 ELSE m END, CASE WHEN go THEN done + m * 15 // 100 ELSE done END FROM m{i}, g{i // 4})
  GROUP BY host, kind),"""
    return rf"""
WITH rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
pg AS (SELECT page_id, html, {_LOW.format("regexp_extract(x, '^([^/?#]*)', 1)")} AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM pg) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
lk AS (SELECT host AS src, {_LOW.format("unnest(regexp_extract_all(html, '" + _LINK + "', 1))")} AS dst FROM pg WHERE host <> ''),
names AS (SELECT h, sum(n) AS n FROM (SELECT dst AS h, 1 AS n FROM lk WHERE dst <> '' UNION ALL SELECT host, 1 FROM pg WHERE host <> '') GROUP BY h),
chain AS (SELECT s, sum(n) AS n FROM (SELECT n, array_to_string(l[i:], '.') AS s FROM (
  SELECT l, n, unnest(range(1, len(l) + 1)) AS i FROM (SELECT string_split(h, '.') AS l, n FROM names))) GROUP BY s),
up AS (SELECT s AS src, regexp_replace(s, '^[^.]*\.', '') AS dst, n FROM chain WHERE instr(s, '.') > 0),
par AS (SELECT src, dst, n FROM up WHERE instr(dst, '.') > 0 UNION ALL SELECT dst, src, n FROM up WHERE instr(dst, '.') > 0),
edges AS (SELECT src, dst, CAST(sum(n) AS BIGINT) AS n FROM (SELECT src, dst, 1 AS n FROM lk UNION ALL SELECT src, dst, n FROM par) WHERE src <> dst GROUP BY src, dst),
moves AS MATERIALIZED (SELECT src AS a, dst AS b, 't' AS k, n, sum(n) OVER (PARTITION BY src) AS total FROM edges
  UNION ALL SELECT dst, src, 'd', n, sum(n) OVER (PARTITION BY dst) FROM edges),
hosts AS (SELECT host, count(*) AS n FROM pg WHERE host <> '' GROUP BY host),
ev AS (SELECT host, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM pg JOIN best USING (host, path) GROUP BY host),
w AS (SELECT host, CASE WHEN good > bad THEN 't' ELSE 'd' END AS kind, abs(good - bad) * 1000000000000 // n AS w
  FROM ev JOIN hosts USING (host) WHERE good <> bad),
seeds AS MATERIALIZED (SELECT host, kind, CAST(CAST(w AS HUGEINT) * 1000000000000000 // sum(w) OVER (PARTITION BY kind) AS BIGINT) AS s FROM w),
m0 AS MATERIALIZED (SELECT host, kind, s AS m, CAST(0 AS BIGINT) AS done FROM seeds),{rounds}
sc AS (SELECT host, CAST(coalesce(sum(m + done) FILTER (kind = 't'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(m + done) FILTER (kind = 'd'), 0) AS BIGINT) AS distrust FROM m24 GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >
    3000000000000000 // (10 * greatest((SELECT count(*) FROM hosts), 1)) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN host = '' THEN 0 ELSE coalesce(trust, 0) END AS trust, CASE WHEN host = '' THEN 0 ELSE coalesce(distrust, 0) END AS distrust
FROM pg LEFT JOIN best USING (host, path) LEFT JOIN sc USING (host)
"""


_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_OP12 = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINE}),
s AS (
  SELECT a.vec_id AS anchor_id, a.r AS ar, c.vec_id, c.label = a.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v AS a, v AS c WHERE a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS pr FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.pr <= 5)
SELECT * FROM n WHERE rank <= 10
"""


def _op13(rounds: int = 10) -> str:
    """Every round as two tables: the nearest centroid of each vector, and the centroids that follow from it."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_FINE})""", """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS k, v AS c
  FROM v QUALIFY k < 8)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS near FROM (
    SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i})
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
      SELECT near.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY k) USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, near.k AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON near.k = k
"""


ORACLES: dict[str, str] = {"op3_link_graph": _op3(), "op7_dual_tree": _OP7, "op9_winnowing": _OP9, "op12_four_russians": _OP12,
                           "op13_ptolemaic": _op13()}

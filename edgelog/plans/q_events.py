"""Query keys of event filtering and notification shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelog.operators import notify as N
from edgelog.operators.alarms import AlarmSpec, alarm_transitions
from edgelog.operators.classify import sanity_checks as fan_out
from edgelog.operators.metrics import bucket_start
from edgelog.plans.registry import register
from edgelog.sources.catalog import PROD_SANITY_TARGETS, sanity_targets
from edgelog.sources.eventsrc import ACCOUNT, envelopes, messages_of, raw_events
from edgelog.sources.tables import table

CHECKS = [(name, repo, image, f"MonitorProjectFor{name}{image}")
          for name, repo, images, _ in PROD_SANITY_TARGETS for image in images]
CHECKS_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', '{r}', '{im}', '{c}')" for i, (n, r, im, c) in enumerate(CHECKS)) \
    + ") AS c(idx, name, repo, image, check_name)"

ALERTS_SQL = f"""WITH alerts AS (
  SELECT e.event_id, 'repo-sanity' AS type, c.name AS "sanityTarget", c.image AS "sanityProjectImage",
         c.check_name AS "sanityProjectName", 'FAILED' AS "sanityBuildStatus", '{ACCOUNT}' AS account,
         'arn:aws:codebuild:us-east-1:{ACCOUNT}:build/' || c.check_name || ':' || e.event_id AS "sanityBuildId", c.repo
  FROM events e JOIN {CHECKS_SQL} ON e.event_id % {len(CHECKS)} = c.idx
  WHERE e.event_type = 'error' AND e.event_id % 3 = 0 AND e.event_id % 16 <> 9)
"""


def _raw(spark, sf):
    return raw_events(table(spark, sf, "events"))


def _alerts(spark, sf):
    return N.failed_checks(_raw(spark, sf), sanity_targets(spark))


@register("failed_check_alerts", ALERTS_SQL + "SELECT * FROM alerts")
def failed_check_alerts(spark, sf):
    """Failed sanity builds -> alert records."""
    return _alerts(spark, sf)


@register("resync_commands", ALERTS_SQL + "SELECT event_id, 'start' AS cmd, 'sync-worker' AS worker_id, repo AS mirror_id FROM alerts")
def resync_commands(spark, sf):
    """Re-sync command per failed check."""
    return N.resync_commands(_alerts(spark, sf))


@register("sanity_checks", ALERTS_SQL + f"""
SELECT c.check_name, c.name, c.repo, c.image, count(a.event_id) AS failures
FROM {CHECKS_SQL} LEFT JOIN alerts a ON a."sanityProjectName" = c.check_name
GROUP BY ALL""")
def sanity_checks(spark, sf):
    """C5 + N1: every (target, image) check with its failure count."""
    failures = _alerts(spark, sf).groupBy(F.col("sanityProjectName").alias("check_name")).agg(
        F.count("*").alias("failures"))
    checks = fan_out(sanity_targets(spark)).select("check_name", "name", "repo", "image")
    return checks.join(failures, "check_name", "left").select(
        "check_name", "name", "repo", "image", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))


STATES_SQL = "['FAILED', 'ABORTED', 'SUCCEEDED', 'TIMED_OUT', 'RUNNING'][e.event_id % 5 + 1]"


# The commands of every sanity target as literal values (name, step, command).
_COMMANDS_SQL = r"""(VALUES
  ('Ubuntu', 1, 'sed -E -i "s/(archive.ubuntu.com|security.ubuntu.com)/mirror.example.org/" /etc/apt/sources.list'),
  ('Ubuntu', 2, 'apt update'),
  ('Debian', 1, 'sed -E -i "s/(deb.debian.org|security.debian.org)/mirror.example.org/" /etc/apt/sources.list'),
  ('Debian', 2, 'apt update'),
  ('CentOS', 1, 'sed -i ''s/mirrorlist/#mirrorlist/;s/#baseurl=http:\/\/mirror.centos.org/baseurl=https:\/\/mirror.example.org/'' /etc/yum.repos.d/CentOS-*.repo'),
  ('CentOS', 2, 'yum makecache'),
  ('Fedora', 1, 'sed -i ''s/metalink/#metalink/;s/#baseurl=http:\/\/download.example\/pub\/fedora\/linux/baseurl=https:\/\/mirror.example.org\/fedora/'' /etc/yum.repos.d/fedora{,-updates,-modular,-updates-modular}.repo'),
  ('Fedora', 2, 'yum makecache'),
  ('Alpine', 1, 'sed -i ''s/dl-cdn.alpinelinux.org/mirror.example.org/g'' /etc/apk/repositories'),
  ('Alpine', 2, 'apk update'),
  ('ELRepo', 1, 'sed -i ''s/mirrorlist/#mirrorlist/;s/#baseurl=http:\/\/mirror.centos.org/baseurl=https:\/\/mirror.example.org/'' /etc/yum.repos.d/CentOS-*.repo'),
  ('ELRepo', 2, 'rpm --import https://www.elrepo.org/RPM-GPG-KEY-elrepo.org'),
  ('ELRepo', 3, 'yum install -y https://www.elrepo.org/elrepo-release-7.el7.elrepo.noarch.rpm'),
  ('ELRepo', 4, 'sed -i ''s/mirrorlist/#mirrorlist/;s/elrepo.org\/linux/mirror.example.org\/elrepo/'' /etc/yum.repos.d/elrepo.repo'),
  ('ELRepo', 5, 'yum makecache')) AS t(name, step, command)"""


@register("failed_check_commands", ALERTS_SQL + f"""
SELECT a."sanityProjectName" AS check_name, a."sanityProjectImage" AS image, t.step, t.command, count(*) AS failures
FROM alerts a JOIN {_COMMANDS_SQL} ON t.name = a."sanityTarget" GROUP BY ALL""")
def failed_check_commands(spark, sf):
    """S9 + N1: the commands that every failed check ran, in order, with the check's failures."""
    failures = _alerts(spark, sf).groupBy(F.col("sanityTarget").alias("name"), F.col("sanityProjectName").alias("check_name"),
                                          F.col("sanityProjectImage").alias("image")).agg(F.count("*").alias("failures"))
    commands = sanity_targets(spark).select("name", F.posexplode("commands").alias("at", "command"))
    return failures.join(F.broadcast(commands), "name").select(  # 15 rows of configuration
        "check_name", "image", (F.col("at") + 1).alias("step"), "command", "failures")


@register("pipeline_outcomes", f"""
SELECT e.event_id, 'pipeline' AS type, 'exec-' || e.event_id AS execution, '{ACCOUNT}' AS account,
  CASE WHEN e.event_id % 2 = 0 THEN '{{"commit":"' || substr(md5(CAST(e.event_id AS VARCHAR)), 1, 7) || '"}}' ELSE '{{}}' END AS input,
  CASE WHEN e.event_id % 7 = 0 THEN '{{"Error":"States.Timeout"}}' ELSE '{{"ok":true}}' END AS output,
  {STATES_SQL} AS result
FROM events e WHERE e.event_type = 'signup' AND e.event_id % 4 <> 3 AND e.event_id % 5 < 4""")
def pipeline_outcomes(spark, sf):
    """N3 + P9: finished executions of the deployment pipeline."""
    return N.pipeline_outcomes(_raw(spark, sf))


@register("scale_events", """
SELECT event_id, 'Service service/mirrors/content-server is scaled from ' || (event_id % 16 + 1) || ' to '
       || ((event_id + user_id) % 16 + 1) AS message
FROM events WHERE event_type = 'click'""")
def scale_events(spark, sf):
    """Scaling activity text."""
    return N.scale_events(_raw(spark, sf))


@register("cert_events", f"""
SELECT event_id, 'certificate' AS type, 'mirrors.example.com' AS "certificateDomain",
  CASE WHEN event_id % 2 = 1 THEN 'prod' END AS stage,
  CASE WHEN event_id % 2 = 1 THEN 'id-' || event_id END AS "iamCertId",
  CASE WHEN event_id % 2 = 1 THEN 'cert-' || event_id END AS "iamCertName",
  'CertificateRenewal' AS "certificateProjectName",
  CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS "certificateBuildStatus",
  'arn:aws:codebuild:us-east-1:{ACCOUNT}:build/CertificateRenewal:' || event_id AS "certificateBuildId",
  '{ACCOUNT}' AS account
FROM events WHERE event_type = 'purchase' AND event_id % 8 < 6 AND event_id % 16 NOT IN (4, 5)""")
def cert_events(spark, sf):
    """Certificate build events with array-indexed JSON paths."""
    return N.cert_events(_raw(spark, sf))


def topic_messages(spark, sf):
    """Everything published to the notification topic, as delivered
    envelopes unwrapped again (S7)."""
    ev = table(spark, sf, "events")
    raw = raw_events(ev)
    counts = (ev.groupBy(F.col("event_type").alias("metric"), bucket_start(F.col("ts"), "1 hour").alias("bucket"))
              .agg(F.count("*").alias("value")))
    end = ev.agg(F.max("ts").alias("ts")).select(bucket_start(F.col("ts"), "1 hour")).scalar()  # the evaluation clock: one narrow column
    trans = alarm_transitions(counts, ["metric"], AlarmSpec("hourly-events", "1 hour", ">=", 5, 3, "BREACHING"), end)
    alarms = N.alarm_messages(trans, F.concat(F.lit("HourlyEvents-"), F.col("metric")), "Hourly event volume", ACCOUNT)
    msgs = alarms.unionByName(N.publish(raw, sanity_targets(spark)))
    return messages_of(envelopes(msgs))


SUMMARY_SQL = ALERTS_SQL + f""",
hourly AS (SELECT event_type AS metric, date_trunc('hour', ts) AS bucket, count(*) AS value FROM events GROUP BY ALL),
spans AS (SELECT metric, min(bucket) AS first FROM hourly GROUP BY metric),
grid AS (SELECT metric, unnest(generate_series(first, (SELECT max(bucket) FROM hourly), INTERVAL 1 HOUR)) AS bucket FROM spans),
filled AS (SELECT g.metric, g.bucket, h.value FROM grid g LEFT JOIN hourly h USING (metric, bucket)),
evald AS (SELECT metric, bucket, sum(CAST(CASE WHEN value IS NULL THEN TRUE ELSE value >= 5 END AS INT))
            OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS breaches FROM filled),
stated AS (SELECT metric, bucket, CASE WHEN breaches = 3 THEN 'ALARM' ELSE 'OK' END AS state FROM evald),
trans AS (SELECT state, coalesce(lag(state) OVER (PARTITION BY metric ORDER BY bucket), 'OK') AS previous FROM stated),
execs AS (SELECT event_id, {STATES_SQL} AS result, event_id % 7 = 0 AS timed_out
          FROM events e WHERE event_type = 'signup' AND event_id % 4 <> 3),
kinds AS (
  SELECT 'alarm' AS kind, 'CloudWatch Alarm' AS username, CASE WHEN state = 'ALARM' THEN ':scream:' ELSE ':relaxed:' END AS icon_emoji
  FROM trans WHERE state <> previous
  UNION ALL SELECT 'repo-sanity', 'Repo Sanity Testing', ':scream:' FROM alerts
  UNION ALL SELECT 'approval', 'Pipeline', ':question:' FROM execs WHERE result = 'RUNNING'
  UNION ALL SELECT 'pipeline', 'Pipeline', CASE WHEN result = 'FAILED' THEN ':thumbsdown:'
      WHEN result IN ('TIMED_OUT', 'ABORTED') THEN ':point_right:' WHEN timed_out THEN ':open_mouth:' ELSE ':clap:' END
    FROM execs WHERE result <> 'RUNNING'
  UNION ALL SELECT 'dead-letter', NULL, NULL FROM events\n    WHERE event_type = 'click' OR (event_type = 'purchase' AND event_id % 2 = 0 AND event_id % 8 < 6 AND event_id % 16 NOT IN (4, 5)))
SELECT kind, username, icon_emoji, count(*) AS messages FROM kinds GROUP BY ALL"""


def _sql_text(template: str) -> str:
    """A Python text with {placeholders} as a DuckDB concatenation; newlines become chr(10)."""
    import re
    parts = []
    for piece in re.split(r"(\{[^}]+\})", template):
        if not piece:
            continue
        if piece.startswith("{"):
            parts.append(f"({piece[1:-1]})")
        else:
            for j, line in enumerate(piece.split("\n")):
                if j:
                    parts.append("chr(10)")
                if line:
                    parts.append("'" + line.replace("'", "''") + "'")
    return " || ".join(parts)


_ALARM_URL = ("https://us-east-1.console.aws.amazon.com/cloudwatch/home?region=us-east-1#alarmsV2:alarm/{name}"
              "?~(alarmStateFilter~'ALARM)")
NOTIFICATIONS_SQL = SUMMARY_SQL.split(",\nkinds AS (")[0].replace(
    "trans AS (SELECT state, coalesce(lag(state)", "trans AS (SELECT metric, bucket, state, coalesce(lag(state)") + f""",
named AS (SELECT *, 'HourlyEvents-' || metric AS name FROM trans WHERE state <> previous),
execs2 AS (SELECT e.event_id, x.result, x.timed_out,
                  CASE WHEN e.event_id % 2 = 0 THEN substr(md5(CAST(e.event_id AS VARCHAR)), 1, 7) END AS commit_id
           FROM events e JOIN execs x USING (event_id))
SELECT 'alarm-' || name || '-' || strftime(bucket, '%Y%m%d%H%M') AS msg_id, 'alarm' AS kind, 'mirrors' AS channel,
  'CloudWatch Alarm' AS username,
  {_sql_text("{name}\nHourly event volume\nAccount: " + ACCOUNT + "\nThreshold crossed: state changed from {previous} to {state} at {CAST(bucket AS VARCHAR)}\n<" + _ALARM_URL + "|AlarmState>")} AS text,
  CASE WHEN state = 'ALARM' THEN ':scream:' ELSE ':relaxed:' END AS icon_emoji
FROM named
UNION ALL
SELECT 'sanity-' || event_id, 'repo-sanity', 'mirrors', 'Repo Sanity Testing',
  {_sql_text("Sanity testing for '{\"sanityTarget\"}' '{\"sanityProjectImage\"}' failed!\n{\"sanityProjectName\"} got FAILED\nAccount: " + ACCOUNT + "\nCheck build {\"sanityBuildId\"} for detail info.")},
  ':scream:'
FROM alerts
UNION ALL
SELECT 'approval-' || event_id, 'approval', 'mirrors', 'Pipeline',
  {_sql_text("Mirrors pipeline 'DeployPipeline' is going to next stage 'prod' on commit '{coalesce(commit_id, 'None')}'.\n\nCheck stage 'uat' via https://mirrors.example.com,\n\nNOTE: below actions are one-time actions and the operation can NOT be revoked. \nAlso below actions will be expired in 60 minutes.\n\n<https://mirrors.example.com/approve?execution=exec-{event_id}|Click to Approve>\n\n<https://mirrors.example.com/reject?execution=exec-{event_id}|Click to Reject>\n")},
  ':question:'
FROM execs2 WHERE result = 'RUNNING'
UNION ALL
SELECT 'pipeline-' || event_id, 'pipeline', 'mirrors', 'Pipeline',
  {_sql_text("Mirrors pipeline execution 'exec-{event_id}' on commit '{coalesce(commit_id, 'unknown')}' is {CASE WHEN result NOT IN ('FAILED', 'TIMED_OUT', 'ABORTED') AND timed_out THEN 'approval timeout' ELSE result END} in account " + ACCOUNT + ".\n")},
  CASE WHEN result = 'FAILED' THEN ':thumbsdown:' WHEN result IN ('TIMED_OUT', 'ABORTED') THEN ':point_right:'
       WHEN timed_out THEN ':open_mouth:' ELSE ':clap:' END
FROM execs2 WHERE result <> 'RUNNING'"""


@register("notifications", NOTIFICATIONS_SQL)
def notifications(spark, sf):
    """Chat records for every accepted message."""
    return N.notifications(N.shape_notifications(topic_messages(spark, sf)))


@register("notifications_cn_region", NOTIFICATIONS_SQL.replace(
    "https://us-east-1.console.aws.amazon.com/cloudwatch/home?region=us-east-1",
    "https://cn-north-1.console.amazonaws.cn/cloudwatch/home?region=cn-north-1"))
def notifications_cn_region(spark, sf):
    """The same records from a China region, whose console has another host."""
    return N.notifications(N.shape_notifications(topic_messages(spark, sf), region="cn-north-1"))


DEAD_LETTERS_SQL = f"""
SELECT 'scale-' || event_id AS msg_id, 'Service service/mirrors/content-server is scaled from ' || (event_id % 16 + 1)
       || ' to ' || ((event_id + user_id) % 16 + 1) AS message
FROM events WHERE event_type = 'click'
UNION ALL
SELECT 'cert-' || event_id, '{{"type":"certificate","certificateDomain":"mirrors.example.com",'
       || '"certificateProjectName":"CertificateRenewal","certificateBuildStatus":"FAILED",'
       || '"certificateBuildId":"arn:aws:codebuild:us-east-1:{ACCOUNT}:build/CertificateRenewal:' || event_id
       || '","account":"{ACCOUNT}"}}'
FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0 AND event_id % 8 < 6 AND event_id % 16 NOT IN (4, 5)"""


@register("dead_letters", DEAD_LETTERS_SQL)
def dead_letters(spark, sf):
    """Messages no branch accepts."""
    return N.dead_letters(N.shape_notifications(topic_messages(spark, sf)))


@register("notification_summary", SUMMARY_SQL)
def notification_summary(spark, sf):
    """N6 + N7 per class: messages, users and icons."""
    shaped = N.shape_notifications(topic_messages(spark, sf))
    return shaped.groupBy(F.coalesce("kind", F.lit("dead-letter")).alias("kind"), "username", "icon_emoji").agg(
        F.count("*").alias("messages"))

"""Event rules (filter + projection), message publishing and the
notification shaping of topic messages into chat records, with dead letters.

Events and messages are parsed once each with ``from_json`` against a fixed
schema; every rule is a condition plus a projection over the parsed struct.
A message that is not a JSON object parses to NULL fields and falls through to
the dead-letter table instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelog.operators.classify import sanity_checks
from edgelog.sources.eventsrc import CERT_PROJECT, PIPELINE_ARN

# Pipeline outcome states that notify, and chat defaults.
OUTCOME_STATES = ["FAILED", "ABORTED", "SUCCEEDED", "TIMED_OUT"]
DEFAULT_CHANNEL = "mirrors"
DEFAULT_USERNAME = "CloudWatch Alarm"
DEFAULT_ICON = ":scream:"
SITE_NAME = "Mirrors"


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


EVENT_SCHEMA = T.StructType(_s("source", "detail-type", "account") + [T.StructField("detail", T.StructType(
    _s("project-name", "build-status", "build-id", "stateMachineArn", "name", "status", "input", "output",
       "resourceId", "oldDesiredCapacity", "newDesiredCapacity")
    + [T.StructField("additional-information", T.StructType([T.StructField(
        "exported-environment-variables", T.ArrayType(T.StructType(_s("name", "value"))))]))]))])

MESSAGE_SCHEMA = T.StructType(_s(
    "AlarmName", "AlarmDescription", "AWSAccountId", "NewStateValue", "NewStateReason", "type",
    "sanityTarget", "sanityProjectImage", "sanityProjectName", "sanityBuildStatus", "account", "sanityBuildId",
    "state", "stateMachineName", "nextStage", "commit", "stage", "domain", "timeout", "approveAction",
    "rejectAction", "execution", "input", "output", "result"))


def parse_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``e``: the event body parsed once."""
    return raw.withColumn("e", F.from_json(F.col(body), EVENT_SCHEMA))


def _e(path: str) -> Column:
    """A field of the parsed event by its dotted path (one column reference)."""
    return F.col("e." + ".".join(f"`{part}`" for part in path.split(".")))


# ---- rules: condition + projection over the parsed event ----------------------

def build_cond() -> Column:
    """A build's change of state (phase changes have another detail type)."""
    return (_e("source") == "aws.codebuild") & (_e("detail-type") == "CodeBuild Build State Change")


def failed_check_cond() -> Column:
    return build_cond() & (_e("detail.build-status") == "FAILED")


def failed_check_fields() -> list[Column]:
    """N1 projection; needs the fan-out columns ``name`` and ``image`` joined in."""
    return [F.lit("repo-sanity").alias("type"), F.col("name").alias("sanityTarget"),
            F.col("image").alias("sanityProjectImage"), _e("detail.project-name").alias("sanityProjectName"),
            _e("detail.build-status").alias("sanityBuildStatus"), _e("account").alias("account"),
            _e("detail.build-id").alias("sanityBuildId")]


def outcome_cond(pipeline_arn: str = PIPELINE_ARN) -> Column:
    """Source, detail type, state machine and status set."""
    return ((_e("source") == "aws.states") & (_e("detail-type") == "Step Functions Execution Status Change")
            & (_e("detail.stateMachineArn") == pipeline_arn) & _e("detail.status").isin(*OUTCOME_STATES))


def outcome_fields() -> list[Column]:
    return [F.lit("pipeline").alias("type"), _e("detail.name").alias("execution"), _e("account").alias("account"),
            _e("detail.input").alias("input"), _e("detail.output").alias("output"),
            _e("detail.status").alias("result")]


def scale_cond() -> Column:
    return _e("source") == "aws.application-autoscaling"


def scale_text() -> Column:
    return F.format_string("Service %s is scaled from %s to %s", _e("detail.resourceId"),
                           _e("detail.oldDesiredCapacity"), _e("detail.newDesiredCapacity"))


def cert_cond() -> Column:
    return (build_cond() & (_e("detail.project-name") == CERT_PROJECT)
            & _e("detail.build-status").isin("FAILED", "SUCCEEDED"))


def cert_failure_fields(domain: str) -> list[Column]:
    """The six fields of a certificate failure message."""
    return [F.lit("certificate").alias("type"), F.lit(domain).alias("certificateDomain"),
            _e("detail.project-name").alias("certificateProjectName"),
            _e("detail.build-status").alias("certificateBuildStatus"),
            _e("detail.build-id").alias("certificateBuildId"), _e("account").alias("account")]


def cert_fields(domain: str, stage: str) -> list[Column]:
    """Failure fields plus, for a successful build, the stage and the exported
    certificate id (array index 1) and name (index 0)."""
    ok = _e("detail.build-status") == "SUCCEEDED"
    env = _e("detail.additional-information.exported-environment-variables")
    base = cert_failure_fields(domain)
    return base[:2] + [F.when(ok, F.lit(stage)).alias("stage"),
                       F.when(ok, env.getItem(1).getField("value")).alias("iamCertId"),
                       F.when(ok, env.getItem(0).getField("value")).alias("iamCertName")] + base[2:]


def approval_cond(pipeline_arn: str = PIPELINE_ARN) -> Column:
    return ((_e("source") == "aws.states") & (_e("detail.stateMachineArn") == pipeline_arn)
            & (_e("detail.status") == "RUNNING"))


def approval_fields(domain: str, timeout_min: int) -> list[Column]:
    ex = _e("detail.name")
    return [F.lit("pipeline").alias("type"), F.lit("approval").alias("state"),
            F.lit("DeployPipeline").alias("stateMachineName"), F.lit("prod").alias("nextStage"),
            F.from_json(_e("detail.input"), "commit string").getField("commit").alias("commit"),
            F.lit("uat").alias("stage"), F.lit(domain).alias("domain"), F.lit(str(timeout_min)).alias("timeout"),
            F.concat(F.lit(f"https://{domain}/approve?execution="), ex).alias("approveAction"),
            F.concat(F.lit(f"https://{domain}/reject?execution="), ex).alias("rejectAction")]


def _checks(targets: DataFrame) -> DataFrame:
    # the check fan-out is configuration (targets x images): bounded, broadcast
    return F.broadcast(sanity_checks(targets).select("check_name", "name", "repo", "image"))


# ---- standalone rule outputs --------------------------------------------------

def failed_checks(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """Failed sanity builds -> alert records (check name joined back to
    its target and image through the fan-out C5)."""
    ev = parse_events(raw).where(failed_check_cond())
    j = ev.join(_checks(targets), _e("detail.project-name") == F.col("check_name"), "inner")
    return j.select("event_id", *failed_check_fields(), "repo")


def resync_commands(alerts: DataFrame, worker_id: str = "sync-worker") -> DataFrame:
    """One start command per failed check for its mirror."""
    return alerts.select("event_id", F.lit("start").alias("cmd"), F.lit(worker_id).alias("worker_id"),
                         F.col("repo").alias("mirror_id"))


def pipeline_outcomes(raw: DataFrame, pipeline_arn: str = PIPELINE_ARN) -> DataFrame:
    """N3 (with the P9 set-membership filter)."""
    return parse_events(raw).where(outcome_cond(pipeline_arn)).select("event_id", *outcome_fields())


def scale_events(raw: DataFrame) -> DataFrame:
    """Scaling activity -> plain text message."""
    return parse_events(raw).where(scale_cond()).select("event_id", scale_text().alias("message"))


def cert_events(raw: DataFrame, domain: str = "mirrors.example.com", stage: str = "prod") -> DataFrame:
    """Certificate builds; failures keep 6 fields, successes add the
    exported certificate id ([1]) and name ([0])."""
    return parse_events(raw).where(cert_cond()).select("event_id", *cert_fields(domain, stage))


# ---- publishing: everything sent to the notification topic --------------------

def publish(raw: DataFrame, targets: DataFrame, domain: str = "mirrors.example.com",
            timeout_min: int = 60) -> DataFrame:
    """(msg_id, message) for every topic message the event rules produce, in
    ONE pass over the events: each rule contributes a candidate (NULL when it
    does not match) and the non-NULL candidates are exploded.  The certificate
    rule publishes failures only (successes go to a different target)."""
    ev = parse_events(raw).join(_checks(targets), _e("detail.project-name") == F.col("check_name"), "left")
    eid = F.col("event_id").cast("string")

    def cand(cond: Column, prefix: str, message: Column) -> Column:
        return F.when(cond, F.struct(F.concat(F.lit(prefix), eid).alias("msg_id"), message.alias("message")))

    cert_failed = cert_cond() & (_e("detail.build-status") == "FAILED")
    candidates = F.array(
        cand(failed_check_cond() & F.col("check_name").isNotNull(), "sanity-",
             F.to_json(F.struct(*failed_check_fields()))),
        cand(approval_cond(), "approval-", F.to_json(F.struct(*approval_fields(domain, timeout_min)))),
        cand(outcome_cond(), "pipeline-", F.to_json(F.struct(*outcome_fields()))),
        cand(scale_cond(), "scale-", scale_text()),
        cand(cert_failed, "cert-", F.to_json(F.struct(*cert_failure_fields(domain)))),
    )
    out = ev.select(F.explode(candidates).alias("m")).where(F.col("m").isNotNull())
    return out.select("m.msg_id", "m.message")


def alarm_messages(trans: DataFrame, alarm_name: Column, description: str, account: str) -> DataFrame:
    """Alarm state-change messages from W3 transitions."""
    reason = F.format_string("Threshold crossed: state changed from %s to %s at %s",
                             F.col("previous"), F.col("state"), F.col("bucket").cast("string"))
    return trans.select(
        F.concat(F.lit("alarm-"), alarm_name, F.lit("-"), F.date_format("bucket", "yyyyMMddHHmm")).alias("msg_id"),
        F.to_json(F.struct(alarm_name.alias("AlarmName"), F.lit(description).alias("AlarmDescription"),
                           F.lit(account).alias("AWSAccountId"), F.col("state").alias("NewStateValue"),
                           reason.alias("NewStateReason"))).alias("message"))


# ---- N6 / N7 ---------------------------------------------------------------

def shape_notifications(messages: DataFrame, region: str = "us-east-1", channel: str = DEFAULT_CHANNEL,
                        username: str = DEFAULT_USERNAME, icon: str = DEFAULT_ICON,
                        site: str = SITE_NAME) -> DataFrame:
    """Classify each message and build (channel, username, text, icon_emoji);
    ``kind`` is NULL for messages no branch accepts (N7)."""
    m = "message"
    parsed = F.from_json(F.col(m), MESSAGE_SCHEMA)

    def g(k: str) -> Column:
        return F.col(f"_m.`{k}`")

    def t(k: str) -> Column:
        """A field inside a text: an absent one prints as ``None``."""
        return F.coalesce(g(k), F.lit("None"))

    title = g("AlarmName")
    mtype = g("type")
    is_alarm = title.isNotNull()
    is_sanity = ~is_alarm & (mtype == "repo-sanity")
    is_approval = ~is_alarm & (mtype == "pipeline") & (g("state") == "approval")
    is_outcome = ~is_alarm & (mtype == "pipeline") & ~F.coalesce(g("state") == "approval", F.lit(False))
    kind = (F.when(is_alarm, "alarm").when(is_sanity, "repo-sanity").when(is_approval, "approval")
             .when(is_outcome, "pipeline"))

    host = "amazonaws.cn" if region.startswith("cn-") else "aws.amazon.com"   # N6a
    log_url = F.concat(F.lit(f"https://{region}.console.{host}/cloudwatch/home?region={region}#alarmsV2:alarm/"),
                       title, F.lit("?~(alarmStateFilter~'ALARM)"))
    alarm_text = F.format_string("%s\n%s\nAccount: %s\n%s\n<%s|AlarmState>", title, t("AlarmDescription"),
                                 t("AWSAccountId"), t("NewStateReason"), log_url)
    sanity_text = F.format_string(
        "Sanity testing for '%s' '%s' failed!\n%s got %s\nAccount: %s\nCheck build %s for detail info.",
        t("sanityTarget"), t("sanityProjectImage"), t("sanityProjectName"), t("sanityBuildStatus"),
        t("account"), t("sanityBuildId"))
    approval_text = F.format_string(
        site + " pipeline '%s' is going to next stage '%s' on commit '%s'.\n\n"
        "Check stage '%s' via https://%s,\n\n"
        "NOTE: below actions are one-time actions and the operation can NOT be revoked. \n"
        "Also below actions will be expired in %s minutes.\n\n"
        "<%s|Click to Approve>\n\n<%s|Click to Reject>\n",
        t("stateMachineName"), t("nextStage"), t("commit"), t("stage"), t("domain"), t("timeout"),
        t("approveAction"), t("rejectAction"))
    result = g("result")
    timed_out = F.from_json(g("output"), "Error string").getField("Error") == "States.Timeout"
    approval_timeout = F.coalesce(~result.isin("FAILED", "TIMED_OUT", "ABORTED"), F.lit(True)) & F.coalesce(timed_out, F.lit(False))
    emoji = (F.when(result == "FAILED", ":thumbsdown:")                              # N6b
              .when(result.isin("TIMED_OUT", "ABORTED"), ":point_right:")
              .when(approval_timeout, ":open_mouth:").otherwise(":clap:"))
    commit = F.coalesce(F.from_json(g("input"), "commit string").getField("commit"), F.lit("unknown"))  # N6c
    outcome_text = F.format_string(site + " pipeline execution '%s' on commit '%s' is %s in account %s.\n",
                                   t("execution"), commit,
                                   F.when(approval_timeout, "approval timeout").otherwise(t("result")), t("account"))
    k = F.col("kind")
    return messages.withColumn("_m", parsed).withColumn("kind", kind).select(
        "msg_id", "kind",
        F.when(k.isNotNull(), F.lit(channel)).alias("channel"),
        F.when(k == "alarm", username).when(k == "repo-sanity", "Repo Sanity Testing")
         .when(k.isin("approval", "pipeline"), "Pipeline").alias("username"),
        F.when(k == "alarm", alarm_text).when(k == "repo-sanity", sanity_text)
         .when(k == "approval", approval_text).when(k == "pipeline", outcome_text).alias("text"),
        F.when(k == "alarm", F.when(g("NewStateValue") == "ALARM", icon).otherwise(":relaxed:"))
         .when(k == "repo-sanity", icon).when(k == "approval", ":question:").when(k == "pipeline", emoji)
         .alias("icon_emoji"),
        m)


def notifications(shaped: DataFrame) -> DataFrame:
    return shaped.where(F.col("kind").isNotNull()).drop("message")


def dead_letters(shaped: DataFrame) -> DataFrame:
    """Messages no branch accepts (not JSON, plain strings, unknown type)."""
    return shaped.where(F.col("kind").isNull()).select("msg_id", "message")

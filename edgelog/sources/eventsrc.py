"""S7 and the raw operational events.

``raw_events`` turns every ``events`` row into one JSON event of a kind fixed
by its ``event_type`` (build state change, execution status change, scaling
activity, certificate build, unrelated health event).  ``envelopes`` wraps
message strings as ``{"Records":[{"Sns":{"Message": ...}}]}`` and
``messages_of`` unwraps them again (S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelog.sources.catalog import PROD_SANITY_TARGETS

# Fixed values of the generated events.
ACCOUNT = "123456789012"
PIPELINE_ARN = "arn:aws:states:us-east-1:123456789012:stateMachine:DeployPipeline"
OTHER_ARN = "arn:aws:states:us-east-1:123456789012:stateMachine:Other"
BUILD_STATES = ["FAILED", "SUCCEEDED", "IN_PROGRESS"]
EXECUTION_STATES = ["FAILED", "ABORTED", "SUCCEEDED", "TIMED_OUT", "RUNNING"]
CERT_PROJECT = "CertificateRenewal"
SCALED_RESOURCE = "service/mirrors/content-server"


def check_names() -> list[str]:
    """Project names of the production sanity checks (target x image)."""
    return [f"MonitorProjectFor{name}{image}" for name, _, images, _ in PROD_SANITY_TARGETS for image in images]


def _array_sql(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def raw_body_sql() -> str:
    """The JSON body of each generated event as ONE Spark SQL expression over
    (event_id, event_type, user_id): parsed once per plan, evaluated in codegen."""
    checks, n = _array_sql(check_names()), len(check_names())
    project = f"element_at({checks}, CAST(event_id % {n} + 1 AS INT))"
    eid = "CAST(event_id AS STRING)"

    def env(source: str, detail_type: str, detail: str, phase: str = "false") -> str:
        return (f"to_json(named_struct('source', '{source}', 'detail-type', "
                f"CASE WHEN {phase} THEN 'CodeBuild Build Phase Change' ELSE '{detail_type}' END, "
                f"'account', '{ACCOUNT}', 'detail', {detail}))")

    build = (f"named_struct('project-name', {project}, "
             f"'build-status', element_at({_array_sql(BUILD_STATES)}, CAST(event_id % 3 + 1 AS INT)), "
             f"'build-id', concat('arn:aws:codebuild:us-east-1:{ACCOUNT}:build/', {project}, ':', {eid}))")
    execution = (f"named_struct('stateMachineArn', CASE WHEN event_id % 4 != 3 THEN '{PIPELINE_ARN}' "
                 f"ELSE '{OTHER_ARN}' END, 'name', concat('exec-', {eid}), "
                 f"'status', element_at({_array_sql(EXECUTION_STATES)}, CAST(event_id % 5 + 1 AS INT)), "
                 f"'input', CASE WHEN event_id % 2 = 0 THEN concat('{{\"commit\":\"', substring(md5({eid}), 1, 7), "
                 f"'\"}}') ELSE '{{}}' END, "
                 f"'output', CASE WHEN event_id % 7 = 0 THEN '{{\"Error\":\"States.Timeout\"}}' ELSE '{{\"ok\":true}}' END)")
    scaling = (f"named_struct('resourceId', '{SCALED_RESOURCE}', "
               f"'oldDesiredCapacity', CAST(event_id % 16 + 1 AS STRING), "
               f"'newDesiredCapacity', CAST((event_id + user_id) % 16 + 1 AS STRING))")
    cert = (f"named_struct('project-name', '{CERT_PROJECT}', "
            f"'build-status', CASE WHEN event_id % 8 = 6 THEN 'IN_PROGRESS' WHEN event_id % 8 = 7 THEN 'STOPPED' "
            f"WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END, "
            f"'build-id', concat('arn:aws:codebuild:us-east-1:{ACCOUNT}:build/{CERT_PROJECT}:', {eid}), "
            f"'additional-information', named_struct('exported-environment-variables', array("
            f"named_struct('name', 'CERT_NAME', 'value', concat('cert-', {eid})), "
            f"named_struct('name', 'CERT_ID', 'value', concat('id-', {eid})))))")
    return ("CASE event_type "
            f"WHEN 'error' THEN {env('aws.codebuild', 'CodeBuild Build State Change', build, 'event_id % 16 = 9')} "
            f"WHEN 'signup' THEN {env('aws.states', 'Step Functions Execution Status Change', execution)} "
            f"WHEN 'click' THEN {env('aws.application-autoscaling', 'Application Auto Scaling Scaling Activity State Change', scaling)} "
            f"WHEN 'purchase' THEN {env('aws.codebuild', 'CodeBuild Build State Change', cert, 'event_id % 16 in (4, 5)')} "
            f"ELSE {env('aws.health', 'AWS Health Event', "named_struct('eventTypeCode', 'MAINTENANCE')")} END")


def raw_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, body) - one JSON operational event per ``events`` row."""
    return events.selectExpr("event_id", "ts", f"{raw_body_sql()} AS body")


ENVELOPE_SCHEMA = T.StructType([T.StructField("Records", T.ArrayType(T.StructType([
    T.StructField("Sns", T.StructType([T.StructField("Message", T.StringType())]))])))])


def envelopes(messages: DataFrame, msg_col: str = "message") -> DataFrame:
    """Wrap each message string into a topic-delivery envelope."""
    rec = F.struct(F.struct(F.col(msg_col).alias("Message")).alias("Sns"))
    return messages.select("msg_id", F.to_json(F.struct(F.array(rec).alias("Records"))).alias("envelope"))


def messages_of(envs: DataFrame, col: str = "envelope") -> DataFrame:
    """``explode(Records)`` -> ``Sns.Message`` (one row per record)."""
    parsed = envs.select("msg_id", F.from_json(F.col(col), ENVELOPE_SCHEMA).alias("e"))
    return parsed.select("msg_id", F.posexplode("e.Records").alias("record", "r")).select(
        "msg_id", "record", F.col("r.Sns.Message").alias("message"))

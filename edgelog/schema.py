"""Fixed schemas of the edge access log (33 positional TSV fields, 4 string
partition keys) and of the combined view (adds ``file``, renames ``result_id``)."""

from pyspark.sql import types as T

# Field names and types of the access-log table, in file order.
ACCESS_LOG_FIELDS = [
    ("date", T.DateType()),
    ("time", T.StringType()),
    ("location", T.StringType()),
    ("bytes", T.LongType()),
    ("request_ip", T.StringType()),
    ("method", T.StringType()),
    ("host", T.StringType()),
    ("uri", T.StringType()),
    ("status", T.IntegerType()),
    ("referrer", T.StringType()),
    ("user_agent", T.StringType()),
    ("query_string", T.StringType()),
    ("cookie", T.StringType()),
    ("result_type", T.StringType()),
    ("result_id", T.StringType()),
    ("host_header", T.StringType()),
    ("request_protocol", T.StringType()),
    ("request_bytes", T.LongType()),
    ("time_taken", T.FloatType()),
    ("xforwarded_for", T.StringType()),
    ("ssl_protocol", T.StringType()),
    ("ssl_cipher", T.StringType()),
    ("response_result_type", T.StringType()),
    ("http_version", T.StringType()),
    ("fle_status", T.StringType()),
    ("fle_encrypted_fields", T.IntegerType()),
    ("c_port", T.IntegerType()),
    ("time_to_first_byte", T.FloatType()),
    ("x_edge_detailed_result_type", T.StringType()),
    ("sc_content_type", T.StringType()),
    ("sc_content_len", T.LongType()),
    ("sc_range_start", T.LongType()),
    ("sc_range_end", T.LongType()),
]
PARTITION_KEYS = ["year", "month", "day", "hour"]

DATA_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in ACCESS_LOG_FIELDS])
FULL_SCHEMA = T.StructType(DATA_SCHEMA.fields + [T.StructField(k, T.StringType(), True) for k in PARTITION_KEYS])
DATA_COLUMNS = [n for n, _ in ACCESS_LOG_FIELDS]
ALL_COLUMNS = DATA_COLUMNS + PARTITION_KEYS
# The combined view calls field 15 ``request_id`` and appends ``file``.
VIEW_COLUMNS = [("request_id" if c == "result_id" else c) for c in ALL_COLUMNS]

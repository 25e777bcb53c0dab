"""Schemas of raw records and of the normalized access-log table."""

from pyspark.sql import types as T

RAW_JSON_FIELDS = (
    "time", "remote_addr", "request", "status", "body_bytes_sent", "request_time",
    "user_agent", "referer", "country", "host", "server_name", "handler", "port",
    "ssl_protocol", "ssl_cipher", "remote_user",
)

# Every JSON value is read as text, so a record never fails on a value's type.
RAW_JSON = T.StructType(
    [T.StructField(name, T.StringType()) for name in RAW_JSON_FIELDS]
    + [T.StructField("_corrupt_record", T.StringType())]
)

UA = T.StructType([
    T.StructField("browser", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("device", T.StringType()),
])

HIT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_defaulted", T.BooleanType()),
    T.StructField("ip", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("response_time", T.DoubleType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("ua", UA),
    T.StructField("is_bot", T.BooleanType()),
    T.StructField("country", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("handler", T.StringType()),
    T.StructField("port", T.StringType()),
    T.StructField("ssl_protocol", T.StringType()),
    T.StructField("ssl_cipher", T.StringType()),
    T.StructField("referer", T.StringType()),
    T.StructField("remote_user", T.StringType()),
])

HIT_COLUMNS = tuple(HIT.fieldNames())

"""The record type and the fixed tables of the log formats."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("type", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("ts_iso", T.StringType()),
        T.StructField("line_no", T.LongType()), T.StructField("ip", T.StringType()), T.StructField("ident", T.StringType()),
        T.StructField("user", T.StringType()), T.StructField("method", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("path", T.StringType()), T.StructField("proto", T.StringType()), T.StructField("status", T.IntegerType()),
        T.StructField("bytes", T.LongType()), T.StructField("referer", T.StringType()), T.StructField("ua", T.StringType()),
        T.StructField("duration_ms", T.LongType()), T.StructField("host", T.StringType()), T.StructField("program", T.StringType()),
        T.StructField("pid", T.IntegerType()), T.StructField("pri", T.IntegerType()), T.StructField("facility", T.StringType()),
        T.StructField("level", T.StringType()), T.StructField("message", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("raw", T.StringType()),
    ]
)

# Syslog severities by PRI % 8 and facilities by PRI / 8.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
FACILITIES = (
    "kernel", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "clock", "authpriv", "ftp",
    "ntp", "audit", "alert", "clock2", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

# Other spellings of levels.
LEVEL_SYNONYMS = {"err": "error", "crit": "critical", "fatal": "critical", "emerg": "emergency", "panic": "emergency", "warn": "warning", "trace": "debug", "notif": "notice"}
ERROR_LEVELS = ("error", "critical", "alert", "emergency")

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

# JSON keys of each field, the first that is present and not null counts.
JSON_KEYS = {
    "epoch": ("timestamp_ms", "ts_ms", "ts_epoch", "unix_time", "epoch"),
    "time": ("@timestamp", "timestamp", "datetime", "time", "ts", "date"),
    "message": ("msg", "message", "event", "text"),
    "ip": ("client_ip", "remote_addr", "client", "src_ip", "src", "ip"),
    "url": ("url", "request", "uri", "endpoint", "target", "path"),
    "status": ("status_code", "resp_status", "response_status", "status", "code"),
    "bytes": ("body_bytes_sent", "content_length", "size", "bytes"),
    "ua": ("user_agent", "agent", "ua"),
    "method": ("http_method", "verb", "method"),
    "user": ("auth_user", "username", "user"),
    "duration_ms": ("duration_ms", "dur_ms", "elapsed_ms"),
    "duration_s": ("request_time", "latency", "duration", "elapsed", "dur"),
    "level": ("severity", "lvl", "level"),
    "host": ("host",),
}

EXPORT_FIELDS = ("ts_iso", "type", "ip", "ident", "user", "method", "url", "status", "bytes", "referer", "ua", "host", "program", "pid", "facility", "level", "message", "duration_ms")
JSON_FIELDS = (
    "ts_iso", "type", "line_no", "ip", "ident", "user", "method", "url", "path", "proto", "status", "bytes", "referer", "ua",
    "duration_ms", "host", "program", "pid", "pri", "facility", "level", "message",
)

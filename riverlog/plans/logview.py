"""A log from the events table: as records, and as raw lines in six grammars for the parsers to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import url_path

AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.example.com/bot.html)",
    "curl/8.4.0",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0",
    "python-requests/2.31.0",
)
REFERERS = tuple(f"https://ref{i}.example.com/" for i in range(6))
REQUESTS = {"view": ("GET", 200), "click": ("GET", 304), "purchase": ("POST", 201), "signup": ("POST", 404), "error": ("GET", 500)}


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of events: one a row, all fields set by fixed rules."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("ts is not null")
    kind, user = F.col("event_type"), F.col("user_id")
    method, status = (F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in REQUESTS.items()]) for i in (0, 1))
    rows = e.select(
        "event_id", "user_id", "event_type", _pick(("combined", "common", "error", "syslog", "syslog", "json"), F.col("event_id") % 6).alias("type"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") + 1).alias("line_no"),
        F.concat_ws(".", F.lit("10.0"), F.floor(user / 256), user % 256).alias("ip"), F.when(user % 3 != 0, F.concat(F.lit("u"), user % 10)).alias("user"),
        method.alias("method"), status.cast("int").alias("status"), F.concat(F.lit("/"), kind, F.lit("?k="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))).alias("url"),
        F.floor(F.col("value") * 100).alias("bytes"), F.floor("value").alias("duration_ms"), F.concat(F.lit("web0"), user % 4).alias("host"),
        _pick(REFERERS, user % 7).alias("referer"), _pick(AGENTS, user % 8).alias("ua"), F.when(kind == "error", "error").otherwise("info").alias("level"),
        F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("facility"), F.lit(None).cast("string").alias("raw"),
    )
    return rows.withColumn("path", url_path(F.col("url")))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value): the records as text, each in the grammar of event_id % 6, with blank and foreign lines at fixed numbers."""
    r = log_view(spark, sf_dir)
    c, when = F.col, lambda form: F.date_format("ts", form)
    access = F.concat(c("ip"), F.lit(" - "), F.coalesce("user", F.lit("-")), F.lit(" ["), when("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), c("method"), F.lit(" "), c("url"), F.lit(' HTTP/1.1" '), c("status"), F.lit(" "), c("bytes"))
    combined = F.concat(access, F.lit(' "'), F.coalesce("referer", F.lit("-")), F.lit('" "'), c("ua"), F.lit('" '), c("duration_ms"))
    message = F.concat(c("event_type"), F.lit(" from "), c("ip"))
    error = F.concat(F.lit("["), when("EEE MMM dd HH:mm:ss yyyy"), F.lit("] ["), c("level"), F.lit("] [client "), c("ip"), F.lit("] "), c("event_type"))
    tail = F.concat(F.lit(" "), c("host"), F.lit(" app["), c("user_id"), F.lit("]: "), message)
    bsd = F.concat(F.when(c("level") == "error", "<27>").otherwise("<30>"), when("MMM dd HH:mm:ss"), tail)
    iso = F.concat(when("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z"), tail)
    json = F.to_json(F.struct(F.unix_timestamp("ts").alias("ts_epoch"), c("ip").alias("remote_addr"), c("status").cast("string").alias("status_code"), c("url"), F.lower("method").alias("verb"), c("bytes").alias("size"), c("ua").alias("agent"), c("user").alias("username"), (c("duration_ms") / 1000).alias("latency"), c("level").alias("lvl"), c("event_type").alias("msg"), c("user_id").alias("uid")))
    lines = [combined, access, error, bsd, iso, json]
    text = F.coalesce(*[F.when(c("event_id") % 6 == i, x) for i, x in enumerate(lines)])
    text = F.when(c("event_id") % 101 == 100, "  ").when(c("event_id") % 97 == 96, F.concat(F.lit("no log line "), c("event_id"))).otherwise(text)
    return r.select("line_no", text.alias("value"))

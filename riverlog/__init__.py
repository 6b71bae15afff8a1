"""Log analytics on Spark: parse, filter, summarise, bucket, score and follow server logs."""

__version__ = "0.1.0"

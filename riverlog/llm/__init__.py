"""Training-data operators on Spark: mixing, deduplication, search, archives, privacy and quality.

Nothing outside this folder imports it; ``__spark_entry__`` registers its queries when it is present.
"""

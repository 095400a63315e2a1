"""Column functions: pure Spark expressions (no Python UDFs) for dates,
calendar buckets, text rules and guarded ratios."""

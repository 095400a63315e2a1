"""salescope: Spark-native sales, lead and marketing analytics.

Every public operator takes DataFrames (plus plan-time arguments such as
filters, ``as_of`` or a time grouping) and returns a DataFrame.  All work is
expressed with built-in Spark expressions so Catalyst can push filters into
the Parquet scan, prune columns and run partial aggregation on the executors.
"""

__version__ = "0.1.0"

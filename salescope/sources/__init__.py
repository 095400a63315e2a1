"""Sources and sinks: business tables over the driver's Parquet data,
delimited-file ingestion and result writers."""

"""Sources and sinks: CSV, Parquet store, the legacy column file."""

"""Sources and sinks: parquet tables, markdown bulletins, JSON, profiles."""

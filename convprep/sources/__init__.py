"""Sources and sinks: chat exports, records, CSV sets, parquet stages."""

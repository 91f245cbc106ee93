"""Sources (driver tables, statement CSVs, statement text) and sinks."""

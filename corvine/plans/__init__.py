"""Named queries: what each computes over the parquet tables, beside the SQL with the same rows."""

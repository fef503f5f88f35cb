"""Store analytics on Spark: exports in, typed tables, business questions out."""

"""Call-log analytics on Spark: ingest, clean, locate, flag and report hotline calls."""

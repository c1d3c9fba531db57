"""Page-level document libraries on Spark: ingest, index, search, cite."""

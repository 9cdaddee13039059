"""Sources: parquet directories, SQLite files, benchmark JSON, derived corpora."""

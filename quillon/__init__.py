"""A Spark-first engine for coded text corpora."""

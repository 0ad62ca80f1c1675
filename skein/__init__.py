"""skein: a Spark-first vector search and corpus preparation engine."""

"""Code-corpus and execution-trace graph analytics as Spark DataFrame jobs."""

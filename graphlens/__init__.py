"""graphlens: code-graph questions and service reports as Spark DataFrame jobs."""

"""Statistical profiling, deterministic data synthesis and training-data operations on Spark."""

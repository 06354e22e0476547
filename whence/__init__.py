"""whence: causal analytics over event tables, written as Spark jobs."""

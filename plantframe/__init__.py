"""Industrial-telemetry analytics on Spark DataFrames."""

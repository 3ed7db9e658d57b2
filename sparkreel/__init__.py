"""Frame, stream and sample analytics expressed as Spark DataFrames."""

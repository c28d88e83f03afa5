"""lectern: text-corpus analytics expressed with Spark DataFrames, SQL, ML and Structured Streaming."""

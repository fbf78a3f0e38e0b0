"""Text statistics, matching and decoding of token sequences on Spark DataFrames."""

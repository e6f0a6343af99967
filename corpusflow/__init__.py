"""Text-corpus and retrieval analytics expressed on Spark DataFrames."""

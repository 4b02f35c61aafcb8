"""Training-data operators for large text corpora, built on Spark DataFrames."""

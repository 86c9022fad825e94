"""Evidence analytics over record and source-code corpora, on Spark DataFrames."""

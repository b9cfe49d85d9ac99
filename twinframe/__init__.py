"""twinframe: content-duplicate analytics over trees of named items, on Spark DataFrames."""

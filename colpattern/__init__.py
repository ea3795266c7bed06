"""colpattern: columns described by their patterns, on Spark DataFrames."""

"""Source-line analytics over collections of files, as Spark DataFrames."""

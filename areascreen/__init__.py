"""areascreen: screening and ranking of places (or any candidates) on Spark DataFrames."""

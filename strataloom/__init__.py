"""Analytics over collections of source files and text, on Spark DataFrames."""

"""quillon: lexical audit and content analytics on Spark DataFrames."""

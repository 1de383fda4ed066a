"""Document-structure and translation-quality analytics as Spark DataFrames."""

"""Training-data operators: quality, URL and language-model corpus work on
Spark DataFrames. Nothing else in the library imports this subpackage."""

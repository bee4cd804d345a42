"""A small relational engine on Spark DataFrames: strict tables, a narrow SELECT, integer indexes, EXPLAIN."""

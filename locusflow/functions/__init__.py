"""Column functions: sequences, regions, names and table cells, all of Spark's own expressions."""

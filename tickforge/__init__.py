"""Order-book event analytics on Spark: DataFrame operators, sources, statistics and training-data tools."""

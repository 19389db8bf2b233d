"""A Spark-native SQL engine: a small SQL dialect with exact semantics over DataFrames, and versioned tables with snapshot isolation."""

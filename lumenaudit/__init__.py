"""Dataset audit on Spark: metrics, similarity, labels, quality and repair over DataFrames."""

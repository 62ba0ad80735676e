"""Panel (per-station) time series on Spark: DataFrame in, DataFrame out."""

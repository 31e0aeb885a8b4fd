"""Analytics of two-party calls on Spark: segments, interval algebra, features, scoring."""

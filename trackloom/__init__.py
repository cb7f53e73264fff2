"""trackloom: Spark-native analytics for densely sampled one-dimensional tracks."""

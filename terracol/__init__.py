"""terracol: Spark-native analytics over pixel, cell, point and road tables."""

"""Spark-native point-in-time panels, nowcasting and training-data operators."""
